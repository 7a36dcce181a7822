"""Document fingerprints from improbable byte windows.

Every window of 16 bytes has a collision entropy (Renyi, order 2), which depends
only on how many pairs of its bytes are equal. Windows are ranked by how rare
their level is over all windows of the corpus, the rarest first. Among each 64
(in short texts an eighth of all)
neighbouring windows the one of the best rank (of equals the one whose bytes
hash lowest, then the leftmost) scores a point; windows with a quarter of
the points they could have are the features. Their hashes go, in text
order, into a chain of Bloom filters. Two fingerprints are alike as far as the
bits that their filters share exceed what chance would share.

A null text is an empty one and has no feature; two empty fingerprints are
equal (1), an empty and another one are not alike (0). A text shorter than a
window is one zero-padded window; long ones are read whole. Repeated rows and ties
stay; extra columns are ignored, whatever their names; an empty table gives no
rows. ``edited_likeness`` needs whole numbers as ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
NEIGHBOURS = 64
LEVELS = WINDOW * (WINDOW - 1) // 2 + 1
FILTER_BITS = 1024
HASHES = 5
PER_FILTER = 80
#: Share of the gap between chance and full overlap that still counts as nothing.
CUTOFF = 0.3


def levels(data: np.ndarray) -> np.ndarray:
    """Number of equal pairs within each window of ``data`` (at least a window long)."""
    n = len(data) - WINDOW + 1
    out = np.zeros(n, np.int32)
    run = np.zeros(len(data) + 1, np.int32)
    for d in range(1, WINDOW):
        m = len(data) - d
        np.cumsum(data[:-d] == data[d:], out=run[1 : m + 1], dtype=np.int32)
        out += run[WINDOW - d : WINDOW - d + n]
        out -= run[:n]
    return out


def padded(text: bytes) -> np.ndarray:
    return np.frombuffer(text.ljust(WINDOW, b"\0") if text else b"", np.uint8)


def feature_hashes(text: bytes, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows in text order, each once."""
    data = padded(text)
    if not len(data):
        return np.zeros(0, np.uint64)
    mixed, step = data * np.uint32(0x9E3779B1), 1
    while step < WINDOW:  # hash of 2, 4, 8, 16 bytes
        mixed = (mixed[:-step] ^ (mixed[:-step] >> np.uint32(15))) * np.uint32(0x85EBCA77) + mixed[step:]
        step *= 2
    tie = ((mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(10)).astype(np.int64)  # 22 bits
    key = (ranks[levels(data)] << np.int64(56)) | (tie << np.int64(34)) | np.arange(len(data) - WINDOW + 1)
    span, reach = max(1, min(NEIGHBOURS, len(key) // 8)), 1
    while reach * 2 <= span:  # minima over 2, 4, ... neighbours
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if span > reach:
        key = np.minimum(key[: -(span - reach)], key[span - reach :])
    place = key & np.int64((1 << 34) - 1)
    # the best place never moves back, so its points are the length of its run
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    points = np.diff(np.r_[first, len(place)])
    chosen = place[first[points >= min(span // 4, points.max())]]
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[chosen]).view("<u8")
    h = (words[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ ((words[:, 1] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h[np.sort(np.unique(h, return_index=True)[1])]


def filters(hashes: np.ndarray) -> np.ndarray:
    """Bits of the chained filters, one row each."""
    bits = np.zeros((-(-len(hashes) // PER_FILTER), FILTER_BITS), np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(12 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    return bits


def digest(text: bytes, ranks: np.ndarray) -> tuple[str, np.ndarray]:
    """The fingerprint's text form and its filter bits."""
    hashes = feature_hashes(text, ranks)
    bits = filters(hashes)
    return f"{len(hashes)}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}", bits


def parse(fingerprint: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8)
    return np.unpackbits(data).reshape(-1, FILTER_BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the shorter chain of each filter's best overlap, less chance."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    total, other = 0.0, b.astype(np.float32)
    size_b = other.sum(axis=1)
    for row in a:
        size = float(row.sum())
        shared, most = other @ row.astype(np.float32), np.minimum(size_b, size)
        chance = size_b * size / FILTER_BITS
        floor = chance + CUTOFF * (most - chance)
        total += float(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / len(a)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each level over all windows of all texts: the rarest 0; equals by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    total += np.bincount(levels(padded(text)), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(t or b"", ranks)[0] for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")


def with_successors(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows dealt into id ranges, each range followed by the row that comes after it.

    Order: id descending (nulls last), then a hash of the text, then the text. Returns
    ``(id, text, part, after)`` partitioned and sorted by part; ``after`` rows are the
    next range's first (after the last range: the first one's), whose own place is
    elsewhere. Null ids are ranges of hashes, so they don't meet in one task. Only
    range bounds and one place for each range pass through the driver.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, as documents are ordered by it")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("_x", F.col("id").cast("double"))
    # ascending (_o, _h) is the order
    rows = rows.withColumn("_o", F.coalesce(F.bitwise_not("id"), F.lit((1 << 63) - 1))).withColumn("_h", F.xxhash64("text"))
    cuts = sorted(set(rows.approxQuantile("_x", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cuts = cuts or [0.0]  # an empty table, or ids that are all null
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_x", outputCol="_b", handleInvalid="keep")
    last = F.lit(len(cuts) + 1) + F.shiftright("_h", 58).cast("int") + 32  # 64 ranges of hashes for null ids
    dealt = cut.transform(rows).withColumn("part", F.when(F.col("id").isNull(), last).otherwise((F.lit(len(cuts)) - F.col("_b")).cast("int")))
    heads = sorted((r["part"], r["p"]["_o"], r["p"]["_h"]) for r in dealt.groupBy("part").agg(F.min(F.struct("_o", "_h")).alias("p")).collect())  # a row for each range
    follow = [(o, h, heads[i - 1][0]) for i, (_, o, h) in enumerate(heads)]
    table = docs.sparkSession.createDataFrame(follow, "_o bigint, _h bigint, before int")
    both = dealt.join(F.broadcast(table), ["_o", "_h"], "left").select(  # as many rows as ranges
        "id", "text", "_o", "_h",
        F.inline(F.expr("CASE WHEN before IS NULL THEN array(struct(part, false AS after)) ELSE array(struct(part, false AS after), struct(before AS part, true AS after)) END")),
    )
    return both.repartition("part").sortWithinPartitions("part", "after", "_o", "_h", F.col("text").asc_nulls_first())


def edited_likeness(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text", parts: int = 48) -> DataFrame:
    """Each row's fingerprint beside that of an edited text and of the next document.

    The edited text has the last half (rounded down) of its code points replaced by
    the first as many (or all) of the next document's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = waiting = first = None

        def close(row: tuple, text: str, bits: np.ndarray) -> tuple:
            own, own_text, name, own_bits = row
            half = len(own_text) // 2
            edited = (own_text[: len(own_text) - half] + text[:half]).encode()
            edited_name, edited_bits = digest(edited, ranks)
            return own, len(own_text), hashlib.sha256(edited).hexdigest(), name, edited_name, likeness(own_bits, edited_bits), likeness(own_bits, bits)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            out = []
            for own, text, at, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if at != part:
                    if waiting:
                        out.append(close(waiting, first[1], first[3]))
                    part, waiting, first = at, None, None
                if after and not waiting:
                    continue
                name, bits = digest(text.encode(), ranks)
                if waiting:
                    out.append(close(waiting, text, bits))
                waiting = None if after else (own, text, name, bits)
                first = first or waiting
            yield batch_of(out)
        if waiting:
            yield batch_of([close(waiting, first[1], first[3])])

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs, id_col, text_col, parts).select("id", "text", "part", "after").mapInArrow(run, schema)
