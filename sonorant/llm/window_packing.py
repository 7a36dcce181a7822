"""Bounded-space online packing of tokenised documents into windows of a fixed length.

Every partition keeps ``OPEN`` windows. A document's whole windows leave at once; its
rest goes where it fits best. If it fits nowhere, the fullest window is filled with
its beginning and leaves, and what is left of it is placed anew, so a window is padded
only at the end of the stream. There the windows of a partition are merged, the
emptiest into the fullest, and what is under a window moves up a tree, ``FAN_IN``
partitions to one, through the same open windows. The last task cuts the rest into
powers of two, which need no padding.

A task holds ``OPEN`` windows and one batch, whatever the partition's size, and every
level is written to the shared folder, so a lost executor costs its own partitions.

A null text is an empty one and becomes the end mark alone. Repeated rows and ties stay
as documents of their own; extra columns are ignored, whatever their names; an empty
table gives no rows. Long texts are cut into windows whole.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage
from .packing import CAPACITY, token_ids

#: Open windows of a task; partitions whose rests meet in one task.
OPEN, FAN_IN = 64, 64
#: Rows that a task collects before it hands them on.
FLUSH = 20_000

_ROW = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence bigint, offset bigint, done boolean, ids binary"


class Windows:
    """Open windows of one task. A piece is ``(doc_id, start, ids, doc_tokens)`` with little-endian unsigned 32-bit ``ids``."""

    def __init__(self, capacity: int, most: int, emit: Callable[[list], None]) -> None:
        self.capacity, self.most, self.emit = capacity, most, emit
        self.by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.mask = self.open = 0  # bit r of the mask: there is a window with room r

    def _take(self, room: int) -> list:
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        self.open -= 1
        return window

    def _keep(self, window: list, room: int) -> None:
        if not room:
            self.emit(window)
            return
        self.by_room[room].append(window)
        self.mask |= 1 << room
        self.open += 1

    def _least_room(self, at_least: int) -> int | None:
        fits = self.mask >> at_least
        return at_least + (fits & -fits).bit_length() - 1 if fits else None

    def add(self, doc_id: object, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.capacity:
            self.emit([(doc_id, start, ids[: self.capacity], doc_tokens)])
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            room = self._least_room(len(ids))
            if room is None and self.open < self.most:
                self._keep([(doc_id, start, ids, doc_tokens)], self.capacity - len(ids))
                return
            if room is None:
                room = self._least_room(1)
            window, n = self._take(room), min(room, len(ids))
            self._keep([*window, (doc_id, start, ids[:n], doc_tokens)], room - n)
            start, ids = start + n, ids[n:]

    def merge(self) -> list:
        """Empties the windows: the fullest are filled from the emptiest and leave; returns what is under a window."""
        rest = deque(w for room in range(self.capacity + 1) for w in self.by_room[room])
        self.by_room, self.mask, self.open = [[] for _ in range(self.capacity + 1)], 0, 0
        while rest:
            window = rest.popleft()
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and rest:
                doc_id, start, ids, doc_tokens = rest[-1].pop()
                window.append((doc_id, start, ids[:room], doc_tokens))
                if len(ids) > room:
                    rest[-1].append((doc_id, start + room, ids[room:], doc_tokens))
                if not rest[-1]:
                    rest.pop()
                room -= len(window[-1][2])
            if room:
                return [window]
            self.emit(window)
        return []


def powers_of_two(window: list) -> Iterator[list]:
    """The pieces of ``window`` cut into windows whose lengths are the powers of two in its length."""
    left, pieces = sum(len(p[2]) for p in window), list(window)
    while left:
        size, out = 1 << left.bit_length() - 1, []
        left -= size
        while size:
            doc_id, start, ids, doc_tokens = pieces.pop(0)
            out.append((doc_id, start, ids[:size], doc_tokens))
            if len(ids) > size:
                pieces.insert(0, (doc_id, start + size, ids[size:], doc_tokens))
            size -= len(out[-1][2])
        yield out


def _packed(df: DataFrame, pieces: Callable[[pa.RecordBatch], Iterator[tuple]], schema: str, level: int, last: bool, capacity: int, most: int) -> DataFrame:
    """Rows of ``_ROW``: what the tasks of ``df`` emit, and with ``done`` false what each has left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        number, kind = (level << 58) + (TaskContext.get().partitionId() << 32), None

        def emit(window: list, done: bool = True) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, doc_tokens in window:
                data = ids.tobytes()
                rows.append((doc_id, start, len(ids), zlib.crc32(data) if done else None, doc_tokens, number, offset, done, None if done else data))
                offset += len(ids)
            number += 1

        def flushed() -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "done", "ids"])

        windows = Windows(capacity, most, emit)
        for batch in batches:
            kind = batch.column(0).type
            for piece in pieces(batch):
                windows.add(*piece)
                if len(rows) >= FLUSH:
                    yield flushed()
        for rest in windows.merge():
            for window in powers_of_two(rest) if last else [rest]:
                emit(window, last)
        if rows:
            yield flushed()

    return df.mapInArrow(run, schema)


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    most_open: int = OPEN, fan_in: int = FAN_IN,
) -> DataFrame:
    """Every piece of every document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are its text's and ``end_id``; each lies in exactly one piece. All
    sequences hold ``capacity`` ids but for a few of the very end, which hold powers of two.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = _ROW.format(kind=kind)

    def documents(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1), ranks_path, pattern), strict=True):
            ids = np.array([*ids, end_id], "<u4")
            yield doc_id, 0, ids, len(ids)

    def rests(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, start, ids, doc_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield doc_id, start, np.frombuffer(ids, "<u4"), doc_tokens

    level, out = 0, []
    now, _ = stage(_packed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), documents, schema, 0, False, capacity, most_open), "windows0")
    while True:
        out.append(now.where("done"))
        rest = now.where("NOT done")
        tasks = rest.where("offset = 0").count()  # each task leaves one window at most
        if not tasks:
            break
        level, parts = level + 1, -(-tasks // fan_in)
        parent = F.pmod(F.expr("shiftright(sequence, 32)"), F.lit(parts))
        items = rest.repartition(parts, parent).sortWithinPartitions("sequence", "offset").select("doc_id", "start", "ids", "doc_tokens")
        now, _ = stage(_packed(items, rests, schema, level, parts == 1, capacity, most_open), f"windows{level}")
    full = out[0]
    for more in out[1:]:
        full = full.unionByName(more)
    return full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")
