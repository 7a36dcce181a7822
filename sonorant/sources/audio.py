"""Recordings: directory scans, PCM-WAV decoding, metadata, clips, annotation tiers, CSV contracts."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp, text
from ..operators.relational import ranked

#: File endings that are converted to WAV (fixed values).
AUDIO = [".mp3", ".flac", ".m4a", ".ogg", ".aac", ".wma", ".aiff", ".alac", ".amr"]
#: Bytes of samples in one arrow batch, about.
BATCH = 64 << 20

ANNOTATIONS = "filename string, onset double, offset double, event_label string"
SOFT_CLUSTERS = "filename string, probs array<double>"


def files(spark: SparkSession, root: str, endings: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """``(path, modificationTime, length, content, relative, stem)`` of files with one of ``endings`` (any case).

    The endings are a glob, so other files are never opened; contents are read only if they are asked for.
    """
    anycase = lambda e: "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    glob = "{" + ",".join(map(anycase, endings or [".wav"])) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    inside = F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1].rstrip("/")) + "/", "")
    return found.withColumn("relative", inside).withColumn("stem", text.stem(F.col("path")))


def by_time(found: DataFrame) -> DataFrame:
    """Files numbered from 1 in the order of their times, then paths."""
    return ranked(found.select("path", "modificationTime", "stem"), F.col("modificationTime"), F.col("path"))


def metadata(found: DataFrame) -> DataFrame:
    """``(filename, num_frames, sr, duration, error)`` from the headers alone: no sample is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = {"filename": path.rsplit("/", 1)[-1], "duration": 0.0}
                try:
                    with wave.open(pa.BufferReader(content.as_buffer())) as w:
                        row |= {"num_frames": w.getnframes(), "sr": w.getframerate(), "duration": w.getnframes() / w.getframerate()}
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, fields)

    fields = pa.schema([("filename", pa.string()), ("num_frames", pa.int64()), ("sr", pa.int32()), ("duration", pa.float64()), ("error", pa.string())])
    return found.select("path", "content").mapInArrow(run, "filename string, num_frames bigint, sr int, duration double, error string")


def decode(content: bytes, downmix: str = "mean") -> tuple[int, np.ndarray]:
    """Rate and samples in [-1, 1] of a PCM-WAV file; channels averaged or the first taken."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels)
    return rate, (x.mean(axis=1) if downmix == "mean" else x[:, 0])


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit PCM-WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def recordings(found: DataFrame, downmix: str = "mean") -> DataFrame:
    """``(filename, sr, samples, duration, error)``; an unreadable file has a null rate, duration 0 and an error."""

    def batch_of(rows: list[tuple], samples: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, samples)], dtype=np.int32)
        values = np.concatenate(samples) if samples else np.zeros(0, np.float32)
        names, rates, durations, errors = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(rates, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(durations, pa.float64()), pa.array(errors, pa.string())],
            ["filename", "sr", "samples", "duration", "error"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, samples, size = [], [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rate, x = decode(content.as_py(), downmix)
                    rows.append((name, rate, len(x) / rate, None))
                    samples.append(x.astype(np.float32))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((name, None, 0.0, f"{type(e).__name__}: {e}"))
                    samples.append(np.zeros(0, np.float32))
                size += samples[-1].nbytes
                if size > BATCH:
                    yield batch_of(rows, samples)
                    rows, samples, size = [], [], 0
            if rows:
                yield batch_of(rows, samples)

    return found.select("path", "content").mapInArrow(run, "filename string, sr int, samples array<float>, duration double, error string")


def pieces(audio: DataFrame, least: float = 10.0, floor: float = -60.0, keep: float = 0.5) -> DataFrame:
    """``(filename, seg, sr, samples)``: recordings split at long silences; pieces count from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column(2)[i].values
                rate, x = batch.column(1)[i].as_py(), np.zeros(0) if x is None else x.to_numpy(zero_copy_only=False)
                found = dsp.loud_pieces(x, rate, least, floor, keep) if rate else []
                if found:
                    cut = [pa.array(x[a:b], pa.float32()) for a, b in found]
                    ends = pa.array(np.cumsum([0, *map(len, cut)], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(found)), pa.array(range(1, len(found) + 1), pa.int64()), pa.array([rate] * len(found), pa.int32()), pa.ListArray.from_arrays(ends, pa.concat_arrays(cut))],
                        ["filename", "seg", "sr", "samples"],
                    )

    return audio.select("filename", "sr", "samples").mapInArrow(run, "filename string, seg bigint, sr int, samples array<float>")


def training_clips(audio: DataFrame, size: int = 64_000, hop: int = 12_800) -> DataFrame:
    """``(filename, sr, clip, start, samples)``: whole clips of ``size`` samples every ``hop``, the rest dropped; ``start`` in seconds."""
    starts = F.sequence(F.lit(0), F.floor((F.size("samples") - size) / hop).cast("int"))
    rows = audio.where(F.size("samples") >= size).select("filename", "sr", "samples", F.explode(starts).alias("clip"))
    return rows.select("filename", "sr", "clip", (F.col("clip") * hop / F.col("sr")).alias("start"), F.slice("samples", F.col("clip") * hop + 1, F.lit(size)).alias("samples"))


def export(clips: DataFrame, root: str) -> DataFrame:
    """Write each clip ``(filename, seg, sr, samples)`` as ``<stem>_<seg>.wav`` under ``root``, a place that executors share; returns ``(target, bytes)``.

    Runs when the result is read. A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        place, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
        place.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for name, seg, rate, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                target = f"{name.rsplit('.', 1)[0]}_{seg}.wav"
                data = encode(samples.values.to_numpy(zero_copy_only=False), rate)
                with place.open_output_stream(f"{base.rstrip('/')}/{target}") as out:
                    out.write(data)
                done.append((target, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["target", "bytes"])

    return clips.select("filename", "seg", "sr", "samples").mapInArrow(run, "target string, bytes bigint")


def clips(audio: DataFrame, segments: DataFrame, hop: int = 320) -> DataFrame:
    """``(filename, seg, sr, samples)``: each segment's slice of its recording."""
    both = audio.join(segments, "filename")
    return both.select("filename", "seg", "sr", F.slice("samples", (F.col("start_f") * hop + 1).cast("int"), ((F.col("end_f") - F.col("start_f")) * hop).cast("int")).alias("samples"))


def tiers(content: str) -> list[dict]:
    """Tiers of a TextGrid in its long text form: name and intervals (minTime, maxTime, mark)."""
    out: list[dict] = []
    for part in re.split(r"item \[\d+\]:", content)[1:]:
        name = re.search(r'name = "((?:[^"]|"")*)"', part)
        cells = re.findall(r'xmin = ([-\d.eE+]+)\s+xmax = ([-\d.eE+]+)\s+text = "((?:[^"]|"")*)"', part)
        out.append({"name": name[1] if name else "", "intervals": [{"minTime": float(a), "maxTime": float(b), "mark": m.replace('""', '"')} for a, b, m in cells]})
    return out


def tier_events(found: DataFrame, wanted: str, label: str) -> DataFrame:
    """Annotations: positive-length intervals, with a mark or without, of the tier named ``wanted`` (any case)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (stem + ".wav", i["minTime"], i["maxTime"], label)
                for stem, content in zip(pdf["stem"], pdf["content"], strict=True)
                for t in tiers(bytes(content).decode("utf-8", "replace")) if t["name"].lower() == wanted.lower()
                for i in t["intervals"] if i["maxTime"] > i["minTime"]
            ]
            yield pd.DataFrame(rows, columns=["filename", "onset", "offset", "event_label"])

    return found.select("stem", "content").mapInPandas(run, ANNOTATIONS)


def pairs(audio: DataFrame, grids: DataFrame) -> DataFrame:
    """Recordings and annotation files of equal stem."""
    return audio.select("stem", F.col("path").alias("audio")).join(grids.select("stem", F.col("path").alias("grid")), "stem")


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """CSV with a header and a declared schema."""
    return spark.read.schema(schema).option("enforceSchema", "false").csv(paths, header=True)


def write_csv(df: DataFrame, path: str, digits: int | None = None, order: list[str] | None = None, append: bool = False) -> None:
    """CSV with a header; doubles in fixed precision if ``digits`` is given.

    With ``order`` the files, read by name, hold the rows in that order. ``append`` adds files and never touches older ones, as a log does.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if digits is not None:
        df = df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else c for c, t in df.dtypes])
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_lines(df: DataFrame, path: str, *parts: str) -> None:
    """A text file of ``name: value`` lines for one-row summaries, or of the given columns with tabs between."""
    if parts:
        line = F.concat_ws("\t", *parts)
        df.select(line).write.mode("overwrite").text(path)
    else:
        lines = F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]))
        df.select(lines).write.mode("overwrite").text(path)


def matrix(cells: DataFrame, src: str = "src", dst: str = "dst", value: str = "prob") -> DataFrame:
    """A dense matrix with labelled rows; missing cells 0. Only for exports: columns are the distinct targets."""
    return cells.groupBy(src).pivot(dst).agg(F.first(value)).na.fill(0.0)
