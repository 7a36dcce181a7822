"""Signals with known answers, file formats, and streaming coalescing."""

import datetime
import os

import numpy as np
import pytest

from sonorant.functions import calls, dsp
from sonorant.sources import audio
from sonorant.streaming import events


def test_transforms_of_known_signals():
    rate = 8000
    x = np.sin(2 * np.pi * 1000 * np.arange(4096) / rate)
    s = dsp.stft(x, 256, 128, 256)
    assert (s.argmax(axis=1) == 32).all()
    assert np.allclose(dsp.hann(8).sum(), 4)
    m = dsp.mel_matrix(20, 129, rate, 125, 3800)
    assert (m >= 0).all() and not m[0].any()
    with pytest.raises(ValueError):
        dsp.mel_matrix(20, 129, rate, 125, 5000)
    assert np.allclose(dsp.rms(np.full(8192, 0.5))[4:-4], 0.5)
    assert np.allclose(dsp.envelope(x)[200:-200], 1, atol=0.05)
    assert dsp.framed(np.arange(5), 6, 2).shape == (0, 6) and dsp.framed(np.arange(10), 4, 3).shape == (3, 4)
    assert abs(np.nanmean(dsp.pitch(np.sin(2 * np.pi * 200 * np.arange(8192) / rate), rate)) - 200) < 3
    assert len(dsp.resample(x, 8000, 4000)) == 2048 and np.allclose(dsp.gaussian(np.ones(30)), 1)
    assert dsp.harmonic_energies(x[:100], rate, 500.0).tolist() == [[0.0] * 12]


def test_pools_with_given_weights():
    x, d = np.random.default_rng(0).normal(size=(5, 8)), 8
    out = dsp.attention_pool(x, np.zeros((3 * d, d)), np.zeros(3 * d), np.eye(d), np.ones(d))
    assert np.allclose(out, 1)
    assert np.allclose(dsp.scored_pool(x, np.zeros(d), 0.0), x.mean(axis=0))


def test_files_features_and_errors(spark, tmp_path):
    rate = 16000
    t = np.arange(rate) / rate
    bursts = np.sin(2 * np.pi * 300 * t) * (np.sin(2 * np.pi * 3 * t) > 0)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_00001_1.wav").write_bytes(audio.encode(bursts, rate))
    (tmp_path / "sub" / "a_00001_2.WAV").write_bytes(b"not a wave")
    (tmp_path / "other.txt").write_text("x")
    (tmp_path / "a_00001_1.TextGrid").write_text('item [1]:\n name = "Calls"\n intervals [1]:\n xmin = 0.1\n xmax = 0.4\n text = "c"\n intervals [2]:\n xmin = 0.4\n xmax = 0.4\n text = "c"\n intervals [3]:\n xmin = 0.5\n xmax = 0.6\n text = ""\n')
    found = audio.files(spark, str(tmp_path))
    assert found.count() == 2
    rec = audio.recordings(found).cache()
    by = {r["filename"]: r for r in rec.collect()}
    assert abs(by["a_00001_1.wav"]["duration"] - 1) < 1e-9 and by["a_00001_2.WAV"]["error"] and by["a_00001_2.WAV"]["duration"] == 0
    good = rec.where("error IS NULL")
    assert calls.peak_counts(good).first()["n"] == 3
    f = calls.call_features(good).first()
    assert f["error"] is None and abs(f["mean_f0"] - 300) < 10 and 0.8 < sum(f[f"avg_rel_h{k}"] for k in range(1, 13)) < 1  # silent frames have no share
    table = calls.call_table(calls.call_features(rec)).collect()
    assert len(table) == 1 and len(table[0]) == 1 + 17 + 6 and table[0]["harmonic_pc1"] == f["avg_rel_h1"]
    meta = {r["filename"]: r for r in audio.metadata(found).collect()}
    assert (meta["a_00001_1.wav"]["num_frames"], meta["a_00001_1.wav"]["sr"], meta["a_00001_1.wav"]["duration"]) == (rate, rate, 1.0) and meta["a_00001_2.WAV"]["error"]
    assert sorted(r["n"] for r in audio.by_time(found).collect()) == [1, 2]
    assert len(calls.mfcc_features(good).first()["mean"]) == 13
    e = calls.embedded(rec, lambda x, rate: np.stack([x[:4], x[4:8]])).collect()
    assert sorted(r["error"] is None for r in e) == [False, True]
    grids = audio.files(spark, str(tmp_path), [".textgrid"])
    assert [tuple(r) for r in audio.tier_events(grids, "calls", "call").collect()] == [("a_00001_1.wav", 0.1, 0.4, "call"), ("a_00001_1.wav", 0.5, 0.6, "call")]
    assert audio.pairs(found, grids).count() == 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1234567, 1.0, "c")], audio.ANNOTATIONS)
    audio.write_csv(df, str(tmp_path / "x"), digits=3)
    assert audio.read_csv(spark, str(tmp_path / "x"), audio.ANNOTATIONS).first()["onset"] == 0.123


def test_streaming_sessions_coalesce_like_the_batch_rule(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0), at(10)), ("a", at(1), at(2)), ("a", at(11), at(12)), ("a", at(40), at(41)), ("a", at(9000), at(9001))]
    schema = "k string, onset timestamp, offset timestamp"
    src = os.path.join(tmp_path, "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = events.coalesced(spark.readStream.schema(schema).parquet(src), "k", 1.0)
    q = out.writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", os.path.join(tmp_path, "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["onset"], r["offset"], r["n"]) for r in spark.table("merged").collect())
    assert got == [(at(0), at(12), 3), (at(40), at(41), 1)]


def test_deltas_resizing_and_byte_windows():
    line = np.tile(np.arange(30.0), (2, 1))
    assert np.allclose(dsp.delta(line)[:, 5:-5], 1) and np.allclose(dsp.delta(line**2, order=2)[:, 5:-5], 2)
    assert np.allclose(dsp.resized(np.ones((7, 3)), 20), 1)
    ramp = dsp.resized(np.arange(10.0)[:, None] * np.ones((1, 2)), 40)
    assert (np.diff(ramp[4:-4, 0]) > 0).all()
    w = dsp.byte_windows(np.random.default_rng(0).random((3, 500)))
    assert w.shape == (3, 3, 224) and w.max() == 255 and w.min() == 0
    assert dsp.byte_windows(np.ones((3, 10))).shape == (1, 3, 224)


def test_harmonics_and_call_records_equal_plain_loops():
    rng = np.random.default_rng(2)
    rate, f0 = 8000, 431.7
    x = rng.normal(size=2048 + 512 * 3)
    got = dsp.harmonic_energies(x, rate, f0)
    assert len(got) == 3  # the frame that ends with the signal does not count
    for t, row in enumerate(got):
        spectrum = np.abs(np.fft.rfft(x[512 * t : 512 * t + 2048] * np.hanning(2048)))
        hertz = np.fft.rfftfreq(2048, 1 / rate)
        assert np.allclose(row, [0.0 if f0 * h > hertz[-1] else spectrum[np.abs(hertz - f0 * h).argmin()] for h in range(1, 13)])
    shares = got / got.sum(axis=1, keepdims=True)
    assert np.allclose(dsp.trends(shares), [np.polyfit(range(3), shares[:, h], 1)[0] for h in range(12)])
    quiet = calls.call_record(np.zeros(4000), rate, 75, 600)
    assert quiet["mean_f0"] == 0 and np.isclose(quiet["f0_peak_location"], np.log(1e-12)) and quiet["avg_rel_h1"] == 0
    t = np.arange(16000) / rate
    tone = np.sin(2 * np.pi * 300 * t) * (1 + 0.5 * np.sin(2 * np.pi * 4 * t))
    a, b = (calls.call_record(tone, rate, 75, 600, raw) for raw in (False, True))
    assert np.isclose(a["call_length"], np.log(2 + 1e-12)) and b["call_length"] == 2 and a["amplitude_wobble_frequency"] == b["amplitude_wobble_frequency"] == 8
    loud = dsp.envelope(tone)
    assert np.isclose(b["amplitude_moment_3"], ((loud - loud.mean()) ** 3).mean()) and np.isclose(b["amplitude_wobble_magnitude"], np.abs(np.fft.rfft(loud)).max())


def test_filterbanks_decibels_and_patches():
    rate = 16000
    x = np.sin(2 * np.pi * 1000 * np.arange(rate) / rate)
    for window, hop, frames in ((0.025, 0.010, 98), (0.010, 0.005, 199)):
        f = dsp.fbank(x, rate, 40, window, hop)
        size = int(rate * window)
        frame = x[:size] - x[:size].mean()
        frame = np.r_[frame[0] * 0.03, frame[1:] - 0.97 * frame[:-1]] * np.hanning(size)
        fft = 1 << (size - 1).bit_length()
        power = np.abs(np.fft.rfft(frame, fft)) ** 2
        scale = lambda hertz: 1127 * np.log(1 + hertz / 700)
        edges = np.linspace(scale(20), scale(rate / 2), 42)
        want = []
        for k in range(40):
            total = 0.0
            for i in range(fft // 2):
                m = scale(i * rate / fft)
                if edges[k] < m < edges[k + 2]:
                    total += power[i] * min((m - edges[k]) / (edges[k + 1] - edges[k]), (edges[k + 2] - m) / (edges[k + 2] - edges[k + 1]))
            want.append(np.log(max(total, 1.1920929e-07)))
        assert f.shape == (frames, 40) and np.allclose(f[0], want)
    assert dsp.fbank(x[:10], rate).shape == (0, 128)
    db = dsp.decibels(dsp.mel_power(x, rate, 64))
    assert db.max() == 0 and db.min() >= -80 and dsp.mel_slaney(1000) == 15
    w = dsp.normalised_windows(np.zeros((100, 4)), 1024)
    assert w.shape == (1, 1024, 4) and np.allclose(w, 4.2677393 / 4.5689974) and dsp.normalised_windows(np.zeros((1600, 4))).shape == (2, 1024, 4)
    assert dsp.examples(np.random.default_rng(0).normal(size=3 * rate), rate).shape == (3, 96, 64)


def test_pieces_clips_and_exports(spark, tmp_path):
    rate = 1000
    x = np.r_[np.ones(2000), np.zeros(12_000), np.ones(1000), np.zeros(3000)].astype(np.float32)
    assert dsp.loud_pieces(x, rate) == [(0, 2500), (13_500, 18_000)] and dsp.loud_pieces(np.zeros(20_000), rate) == [] and dsp.loud_pieces(np.zeros(0), rate) == []
    rec = spark.createDataFrame([("a.wav", rate, x.tolist()), ("b.wav", None, None)], "filename string, sr int, samples array<float>")
    cut = audio.pieces(rec)
    assert [(r["filename"], r["seg"], len(r["samples"])) for r in cut.collect()] == [("a.wav", 1, 2500), ("a.wav", 2, 4500)]
    clips = audio.training_clips(rec, 8000, 4000).collect()
    assert [(r["clip"], r["start"], len(r["samples"])) for r in clips] == [(0, 0.0, 8000), (1, 4.0, 8000), (2, 8.0, 8000)]
    assert sorted(r["target"] for r in audio.export(cut, str(tmp_path / "out")).collect()) == ["a_1.wav", "a_2.wav"]
    assert audio.decode((tmp_path / "out" / "a_1.wav").read_bytes())[0] == rate
    log = str(tmp_path / "log")
    for name in ("b", "a"):
        audio.write_csv(spark.createDataFrame([(name, 1.0)], "file string, s double"), log, order=["file"], append=True)
    assert audio.read_csv(spark, log, "file string, s double").count() == 2
    audio.write_lines(spark.createDataFrame([(3, 1.5)], "files int, seconds double"), str(tmp_path / "sum"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "sum")).collect()) == ["files: 3", "seconds: 1.5"]
    wide = audio.matrix(spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, prob double"))
    assert [tuple(r) for r in wide.collect()] == [("a", 0.5)]


def test_many_small_files_and_a_large_one(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"s_{i:05d}_1.wav").write_bytes(audio.encode(np.zeros(80), 8000))
    (tmp_path / "large.wav").write_bytes(audio.encode(np.zeros(8_000_000), 8000))
    rec = audio.recordings(audio.files(spark, str(tmp_path)))
    assert rec.selectExpr("count(*)", "round(sum(duration), 6)", "sum(size(samples))").first() == (601, 1006.0, 8_048_000)


def test_a_stream_that_runs_when_called(spark, tmp_path):
    schema = "k string, onset timestamp, offset timestamp"
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    for rows in ([("a", at(0), at(10)), ("a", at(9000), at(9001))], [("a", at(9002), at(9003)), ("a", at(20_000), at(20_001))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = events.over_new_files(spark, src, schema, lambda df: events.coalesced(df, "k", 2.0), out, log).orderBy("onset").collect()
    assert [(r["onset"], r["offset"], r["n"]) for r in got] == [(at(0), at(10), 1), (at(9000), at(9003), 2)]
