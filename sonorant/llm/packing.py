"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: every partition packs its pieces best-fit
(largest first); bins that are nearly full leave at once, the others move up a
tree as items in their own right, ``fan_in`` partitions to one, and are packed
best-fit again, until one task holds all that is left or nothing gets fewer.
A task packs at most ``ROOM`` items at a time, so no group grows with the input,
and every piece ends in exactly one sequence.

A null text is an empty one and becomes the end mark alone. Repeated rows and
ties stay as pieces of their own; extra columns are ignored, whatever their names;
an empty table gives no rows. Long texts are cut into pieces whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage
from .bpe import load_ranks

CAPACITY = 1024
#: Items that one task packs together.
ROOM = 200_000
#: A bin with at most this much room left leaves the tree.
SLACK = 8

_PIECE = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
_BIN = _PIECE + ", bin bigint, offset bigint, filled bigint, done boolean"


@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str, mark: str, mark_id: int):
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={mark: mark_id})


def token_ids(column: pa.Array, ranks_path: str, pattern: str, mark: str = "<|endoftext|>", mark_id: int = 50256) -> Iterator[list[int]]:
    """Ids of each text, null as empty; ``mark`` inside a text is its one special token, as in the vocabulary's own tokeniser."""
    encoding = _encoding(ranks_path, pattern, mark, mark_id)
    for text in column.to_pylist():
        text = text or ""
        yield encoding.encode(text, allowed_special="all") if mark in text else encoding.encode_ordinary(text)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole if they fit, else a shorter first piece and full ones."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def tokenised_pieces(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document, an end mark included."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for index, ids in enumerate(token_ids(batch.column(1), ranks_path, pattern)):
                ids.append(end_id)
                data, at = np.array(ids, "<u4").tobytes(), 0
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    rows.append(index)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECE.format(kind=kind))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, and each bin's load: largest item first, into the fullest bin that takes it.

    Open bins wait by the room they have; a bit mask of the rooms in use gives
    the least that is enough.
    """
    bins, place, loads = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i], place[i] = b, loads[b]
        loads[b] += size
        if left := room - size:
            waiting[left].append(b)
            mask |= 1 << left
    return bins, place, np.array(loads, np.int64)


def _round(df: DataFrame, level: int, capacity: int, kind: str) -> DataFrame:
    """Pack the bins (rows of one ``bin``) that each partition of ``df`` holds into new ones."""

    def packed(rows: pa.Table, spent: int, pid: int) -> pa.RecordBatch:
        old, inverse = np.unique(rows["bin"].to_numpy(), return_inverse=True)
        sizes = np.zeros(len(old), np.int64)
        sizes[inverse] = rows["filled"].to_numpy()
        bins, place, loads = best_fit(sizes, capacity)
        full = loads >= capacity - SLACK
        new = (level << 58) + (pid << 32) + spent + bins[inverse]
        columns = [rows[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(new), pa.array(place[inverse] + rows["offset"].to_numpy()), pa.array(loads[bins[inverse]]), pa.array(full[bins[inverse]])],
            [*rows.column_names[:5], "bin", "offset", "filled", "done"],
        ), len(loads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, spent, pid = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            while batch.num_rows:
                part = batch
                if level and waiting + batch.num_rows >= ROOM:  # rows are sorted by bin; a bin stays in one piece
                    keys = batch.column(5).to_numpy()
                    cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
                    part = batch.slice(0, cut)
                if part.num_rows:
                    held.append(part)
                    waiting += part.num_rows
                if waiting >= ROOM:
                    out, n = packed(pa.Table.from_batches(held), spent, pid)
                    spent, held, waiting = spent + n, [], 0
                    yield out
                if part.num_rows == batch.num_rows:
                    break
                batch = batch.slice(part.num_rows)
                if not part.num_rows:
                    held.append(batch)
                    waiting += batch.num_rows
                    break
        if held:
            yield packed(pa.Table.from_batches(held), spent, pid)[0]

    return df.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "filled").mapInArrow(run, _BIN.format(kind=kind))


def pack(pieces: DataFrame, capacity: int = CAPACITY, fan_in: int = 8) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces``: (doc_id, piece, start, length, ids_crc32), lengths from 1 to ``capacity``.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    items = (
        pieces.withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint")).withColumn("filled", F.col("length"))
    )
    level, leaves = 0, None
    done: list[DataFrame] = []
    while True:
        now, _ = stage(_round(items, level, capacity, kind), f"packed{level}")
        done.append(now.where("done"))
        rest = now.where("NOT done")
        left, tasks = rest.where("offset = 0").agg(F.count("*"), F.countDistinct(F.expr("shiftright(bin, 32)"))).first()
        parts = max(-(-tasks // fan_in), -(-left // ROOM), 1)
        if not left or tasks <= 1 or (leaves is not None and parts >= leaves):
            done.append(rest)
            break
        level, leaves = level + 1, parts
        parent = F.pmod(F.expr("shiftright(bin, 32)"), F.lit(parts))
        items = rest.repartition(parts, parent).sortWithinPartitions("bin", "offset")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
