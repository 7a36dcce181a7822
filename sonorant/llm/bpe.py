"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is vectorised over a batch of texts. Every code point gets a
class (letter, number, white space, other, and what an apostrophe or the last
space of a run turns into, seen from its successors). Each class is a transition
function on a few scanner states; functions compose associatively, so the state
before every code point comes from a blocked prefix scan over function numbers
(a table holds all products), not from a loop over the text. State and class
say where a token starts. The slices are encoded by pair merging in rank order,
with a bounded memo of slices already met.

Nulls and empties encode to nothing and decode to the empty string. Rows are
independent; repeated rows and ties stay; extra columns are ignored, whatever
their names; an empty table gives no rows. Long texts are worked on whole.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slices a worker remembers before it starts its memo anew, and the bytes of a slice it remembers at most.
MEMO, LONGEST = 250_000, 64
#: The pattern whose matches the automaton finds (a fixed value); no other can be asked for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of an arrow batch that are worked on at once, and code points that are scanned at once.
ROWS = 500
SCAN = 500_000

# classes of code points
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, LAST_BLANK, LAST_SPACE, BREAK = range(9)
# scanner states: at a token's start; inside letters, numbers, others, white space; after a blank that joins the next; with one or two letters of a contraction to come
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, JOIN, LEFT1, LEFT2 = range(8)
#: White space of the pattern's \s (Unicode White_Space).
WHITE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE] = SPACE
    return kinds


def _step(kind: int, state: int) -> tuple[int, bool]:
    """State after a code point of ``kind``, and whether a token starts there."""
    if kind == BREAK:
        return FRESH, True
    if kind in (SPACE, LAST_BLANK, LAST_SPACE):
        return {SPACE: IN_SPACE, LAST_BLANK: JOIN, LAST_SPACE: FRESH}[kind], kind != SPACE or state != IN_SPACE
    if state == LEFT2:
        return LEFT1, False
    if state == LEFT1:
        return FRESH, False
    if kind in (QUOTE1, QUOTE2) and state not in (IN_OTHER, JOIN):
        return (LEFT1 if kind == QUOTE1 else LEFT2), True
    run = {LETTER: IN_LETTER, NUMBER: IN_NUMBER}.get(kind, IN_OTHER)
    return run, state not in (run, JOIN)


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each class; products of functions; functions as state maps; token starts by class and state."""
    maps = [tuple(_step(k, s)[0] for s in range(8)) for k in range(9)]
    starts = np.array([[_step(k, s)[1] for s in range(8)] for k in range(9)])
    known = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:  # grows: closure of the generators under composition
        for g in maps:
            h = tuple(g[f[s]] for s in range(8))
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    product = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in queue] for f in queue], np.uint16)
    return np.array([known[m] for m in maps], np.uint16), product, np.array(queue, np.uint8), starts


def token_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where tokens start in ``points``; ``breaks`` (places of separators between texts) count as starts."""
    kind = _classes()[points]
    kind[breaks] = BREAK
    after = np.r_[kind[1:], np.uint8(BREAK)]
    last = (kind == SPACE) & (after != SPACE) & (after != BREAK)
    kind[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_SPACE)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        far = np.r_[points, np.zeros(2, points.dtype)]
        one, two = far[quotes + 1], far[quotes + 2]
        one = np.where(kind[np.minimum(quotes + 1, len(kind) - 1)] == BREAK, 0, one)
        kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[quotes[pair]] = QUOTE2
    number, product, apply, starts = _automaton()
    rows = -(-len(kind) // 64)
    fs = np.zeros(rows * 64, np.uint16)
    fs[: len(kind)] = number[kind]
    fs = np.ascontiguousarray(fs.reshape(rows, 64).T)  # one row of the text in each column
    for j in range(1, 64):
        fs[j] = product[fs[j - 1], fs[j]]
    total, reach = fs[-1].copy(), 1
    while reach < rows:  # doubling scan over the rows' products
        total[reach:] = product[total[:-reach].copy(), total[reach:]]
        reach *= 2
    begin = np.r_[np.uint8(FRESH), apply[total[:-1], FRESH]]
    before = np.empty((64, rows), np.uint8)
    before[0] = begin
    before[1:] = apply[fs[:-1], begin[None, :]]
    return np.flatnonzero(starts[kind, before.T.reshape(-1)[: len(kind)]])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: neighbours are merged in the order of their rank, the leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        r, i = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or ranks.get(piece[i : end[j]]) != r:
            continue  # one of the two was merged meanwhile
        gone[j], end[i] = 1, end[j]
        if end[i] < n:
            prev[end[i]] = i
            if (r := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i))
        if i and (r := ranks.get(piece[prev[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, prev[i]))
    return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]


class Memo(dict):
    """Slice to its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        out = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= LONGEST:
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def memo(path: str) -> Memo:
    return Memo(load_ranks(path))


@lru_cache(maxsize=4)
def load_tokens(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each text."""
    known, out, at = memo(path), [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < SCAN):
            size += len(texts[upto]) + 1
            upto += 1
        if len(known) > MEMO:
            known.clear()
        out += _encode(texts[at:upto], known)
        at = upto
    return out


def _encode(texts: list[str], known: Memo) -> list[bytes]:
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    starts = token_starts(points, breaks)
    data = joined.encode()
    place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # first byte of each code point
    at = np.r_[place[starts], len(data)].tolist()
    upto = np.searchsorted(starts, breaks).tolist()  # the separator's own slice ends each text
    out, begin = [], 0
    for end in upto:
        out.append(b"".join([known[data[a:b]] for a, b in zip(at[begin:end], at[begin + 1 : end + 1])]))  # noqa: B905
        begin = end + 1
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, ends)``: the text's ids and, for each, where its bytes end in the text.

    Both are binary, little-endian unsigned 32-bit. ``ranks_path`` must exist on
    every worker, as an installed package's file does. ``pattern`` is the vocabulary's own.
    """
    if pattern != PATTERN:
        raise ValueError("the automaton cuts texts by one pattern, and this is another")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.fromiter(map(len, load_tokens(ranks_path)), np.uint32)
        for batch in _slices(batches):
            ids = encode_texts([x or "" for x in batch.column(1).to_pylist()], ranks_path)
            ends = [np.cumsum(sizes[np.frombuffer(x, "<u4")], dtype="<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], ["id", "ids", "ends"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, ends binary")


def decode_ids(ids: bytes, ends: bytes, tokens: list[bytes]) -> bytes:
    """The text's bytes from its ids; the retained offsets must agree with the tokens' lengths."""
    out = b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])
    if len(out) != (int(np.frombuffer(ends[-4:], "<u4")[0]) if ends else 0):
        raise ValueError("offsets and ids disagree")
    return out


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encode``'s rows with ``decoded``, the text's bytes."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokens(ranks_path)
        for batch in _slices(batches):
            back = [decode_ids(i or b"", e or b"", tokens) for i, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], ["id", "ids", "ends", "decoded"])

    return encoded.select("id", "ids", "ends").mapInArrow(run, f"id {kind}, ids binary, ends binary, decoded binary")
