"""Gate, band-pass and pitch tracks on signals with known answers."""

import numpy as np
import pytest

from sonorant.functions import calls, tracks

RATE = 22_050


def harmonics(f, seconds=0.6, n=10, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * f * h * t + h) / h for h in range(1, n + 1) if f * h < rate / 2)


def test_an_open_mask_changes_nothing_and_noise_goes_down():
    rng = np.random.default_rng(0)
    for n in (1, 700, 1024, 30_001):
        x = rng.normal(0, 1, n)
        assert np.abs(tracks.gated(x, RATE, most=0.0) - x).max() < 1e-9
    noise, tone = 0.05 * rng.normal(0, 1, 3 * RATE), np.zeros(3 * RATE)
    tone[RATE : 2 * RATE] = np.sin(2 * np.pi * 1000 * np.arange(RATE) / RATE)
    for profile in (None, noise[:RATE]):
        y = tracks.gated(noise + tone, RATE, noise=profile)
        assert np.std(y[: RATE // 2]) < 0.4 * np.std(noise[: RATE // 2])
        assert 0.8 < np.std(y[RATE + 5000 : 2 * RATE - 5000]) / np.std(tone[RATE + 5000 : 2 * RATE - 5000]) < 1.1
    assert len(tracks.gated(np.zeros(0), RATE)) == 0


def test_band_pass_has_its_response_and_blocks_equal_the_recursion():
    sections = tracks.band_pass(100, 5000, RATE)
    def gain(f):
        z = np.exp(2j * np.pi * f / RATE)
        return abs(np.prod([np.polyval(b, z) / np.polyval(a, z) for b, a in sections]))
    assert len(sections) == 4 and all(np.abs(np.roots(a)).max() < 1 for _, a in sections)
    assert np.isclose(gain(100), 2**-0.5) and np.isclose(gain(5000), 2**-0.5) and gain(20) < 2e-3 and gain(10_500) < 1e-3 and np.isclose(gain(700), 1, atol=1e-3)
    x = np.random.default_rng(1).normal(0, 1, 1000)
    want = x
    for b, a in sections:
        y = np.zeros(len(want))
        for n in range(len(want)):
            y[n] = sum(b[k] * want[n - k] for k in range(3) if n >= k) - sum(a[k] * y[n - k] for k in (1, 2) if n >= k)
        want = y
    assert np.allclose(tracks.filtered(x, sections, 64), want) and np.allclose(tracks.filtered(x, sections), want)
    with pytest.raises(ValueError, match="edges"):
        tracks.band_pass(100, 20_000, RATE)


@pytest.mark.parametrize("f", [110.0, 237.0, 440.0, 571.0])
def test_tracks_find_harmonic_stacks(f):
    quiet = np.zeros(RATE // 2)
    x = np.r_[quiet, harmonics(f), quiet] + 1e-4 * np.random.default_rng(0).normal(0, 1, RATE // 2 * 2 + int(0.6 * RATE))
    for track in (tracks.pitch_path(x, RATE), tracks.swipe(x, RATE)):
        voiced = track[track > 0]
        middle = track[int(len(track) * 0.4) : int(len(track) * 0.6)]
        assert (middle > 0).all() and np.abs(middle / f - 1).max() < 0.01
        assert 0.25 < len(voiced) / len(track) < 0.55 and np.abs(np.median(voiced) / f - 1) < 0.01
    assert (tracks.pitch_path(quiet, RATE) == 0).all() and (tracks.swipe(quiet, RATE) == 0).all()
    assert len(tracks.pitch_path(np.zeros(10), RATE)) == 0


def test_the_path_does_not_jump_an_octave():
    rng = np.random.default_rng(2)
    t = np.arange(RATE) / RATE
    x = np.sin(2 * np.pi * 200 * t) + 0.6 * np.sin(2 * np.pi * 400 * t) + 0.35 * rng.normal(0, 1, RATE)
    x[9000:9700] = np.sin(2 * np.pi * 400 * t[9000:9700])  # a moment in which the octave is the better candidate
    track = tracks.pitch_path(x, RATE)
    assert np.abs(track[track > 0] / 200 - 1).max() < 0.06 and (track > 0).mean() > 0.9


def test_a_gliding_tone_is_followed():
    t = np.arange(RATE) / RATE
    x = np.sin(2 * np.pi * (300 * t + 100 * t**2))
    for track, hop in ((tracks.pitch_path(x, RATE), int(0.75 / 75 * RATE)), (tracks.swipe(x, RATE), 256)):
        at = np.arange(len(track)) * hop / RATE + (1.5 / 75 if hop != 256 else 0)
        inner = (at > 0.1) & (at < 0.9)
        assert np.abs(track[inner] / (300 + 200 * at[inner]) - 1).max() < 0.02


def test_records_and_the_processing_log(spark):
    x = harmonics(330.0).tolist()
    df = spark.createDataFrame([("a.wav", RATE, x), ("b.wav", 8000, x), ("c.wav", RATE, [0.0] * 3000), ("d.wav", None, x)], "filename string, sr int, samples array<float>")
    rows = {r["filename"]: r for r in calls.swipe_features(df).collect()}
    assert abs(rows["a.wav"]["mean_f0"] - 330) < 3 and rows["a.wav"]["error"] is None and rows["a.wav"]["avg_rel_h1"] > rows["a.wav"]["avg_rel_h3"] > 0
    assert "22050" in rows["b.wav"]["error"] and rows["c.wav"]["mean_f0"] == 0 == rows["c.wav"]["avg_rel_h1"]
    log = {r["filename"]: r for r in calls.denoised(df, spark.createDataFrame([("b.wav",)], "filename string")).collect()}
    assert [log[f]["status"] for f in ("a.wav", "b.wav", "c.wav", "d.wav")] == ["success", "skipped", "success", "error"]
    assert len(log["a.wav"]["samples"]) == len(x) and log["a.wav"]["duration_sec"] > 0 and log["b.wav"]["samples"] is None and log["d.wav"]["error"]
