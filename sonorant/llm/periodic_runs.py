"""Runs: stretches of consecutive words that repeat with a period and cannot be extended.

By the runs theorem the root of every run is, for one of two opposite orders of the
alphabet, the longest Lyndon word at some place. The longest Lyndon word at ``i`` ends
before the next suffix that is smaller, which is a next-smaller value of the inverse
suffix array. So each order gives one candidate root for a place; it is extended to
the right by the longest common prefix of the suffixes at its begin and its end and to
the left by that of the reversed text, both minima of an LCP array (a sparse table over
blocks). Candidates whose neighbours do not agree at all are set aside before.

Many documents are worked on in one array: no two have a symbol in common, and each ends
with a symbol that is less than its others, so that no comparison crosses documents.
Only the LCP arrays are made one by one, for documents that have candidates left.
Memory is proportional to the longest document; nothing is shuffled.

Words are runs of anything but ``\\x20\\x09-\\x0D``. A null text has no words. Repeated
rows stay; extra columns are ignored, whatever their names; an empty table gives no
rows. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import texts

#: Words worked on in one array (one longer document makes an array of its own).
WORDS = 200_000
#: Neighbours that are compared before the suffix arrays are asked.
GLANCE = 4
#: Places of a block of the range-minimum table, as a power of two.
_BLOCK = 5


def suffix_ranks(key: np.ndarray, kinds: int) -> np.ndarray:
    """Rank of each suffix of ``key`` (numbers under ``kinds``) by prefix doubling, places alike being sorted again only."""
    counts = np.bincount(key, minlength=kinds)
    rank = (np.cumsum(counts) - counts)[key]
    open_ = np.flatnonzero(counts[key] > 1)
    h, n = 1, len(key)
    while len(open_):
        both = rank[open_] * n + rank[open_ + h]
        order = np.argsort(both, kind="stable")
        open_, both = open_[order], both[order]
        first = rank[open_]
        at = np.arange(len(open_))
        new = np.r_[True, both[1:] != both[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], at, 0))
        rank[open_] = first + np.maximum.accumulate(np.where(new, at, 0)) - group
        open_ = open_[~(new & np.r_[new[1:], True])]
        h *= 2
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """First later place with a smaller value (its length if there is none), by climbing a tree of minima and coming down."""
    n = len(values)
    tree = [np.append(values, -1)]  # the end is smaller than all
    while len(tree[-1]) > 1:
        low = tree[-1]
        if len(low) % 2:
            low = tree[-1] = np.append(low, np.iinfo(low.dtype).max)
        tree.append(np.minimum(low[0::2], low[1::2]))
    out = np.empty(n, np.int64)
    who = np.arange(n)
    node, level = who + 1, 0
    while len(who):
        odd = (node & 1) == 1
        hit = np.zeros(len(who), bool)
        hit[odd] = tree[level][node[odd]] < values[who[odd]]
        found, at = who[hit], node[hit]
        for below in range(level - 1, -1, -1):
            at = 2 * at
            at += tree[below][at] >= values[found]
        out[found] = at
        who, node = who[~hit], (node[~hit] + odd[~hit]) >> 1
        level += 1
    return out


def lcp_array(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in order with the one before it (0 for the first)."""
    n = len(text)
    out = np.zeros(n, np.int32)
    s, before, place, put = memoryview(np.ascontiguousarray(text)), memoryview(np.ascontiguousarray(order)), memoryview(np.ascontiguousarray(rank)), memoryview(out)
    h = 0
    for i in range(n):
        r = place[i]
        if not r:
            h = 0
            continue
        j = before[r - 1]
        most = n - max(i, j)
        while h < most and s[i + h] == s[j + h]:
            h += 1
        put[r] = h
        if h:
            h -= 1
    return out


class RangeMinima:
    """Minima of ranges of an array: a sparse table over blocks, prefix and suffix minima within them."""

    def __init__(self, values: np.ndarray) -> None:
        self.size = 1 << _BLOCK
        n = -(-len(values) // self.size) * self.size
        self.values = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, self.size)
        self.prefix = np.minimum.accumulate(blocks, axis=1).ravel()
        self.suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table, width = [blocks.min(axis=1)], 1
        while 2 * width <= len(blocks):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over ``low..high`` (both included, ``low <= high``)."""
        a, b = low >> _BLOCK, high >> _BLOCK
        out = np.minimum(self.suffix[low], self.prefix[high])
        near = np.flatnonzero(a == b)
        if len(near):
            at, last = low[near], high[near]
            least = self.values[at]
            for _ in range(int((last - at).max())):
                at = np.minimum(at + 1, last)
                least = np.minimum(least, self.values[at])
            out[near] = least
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            first, last = a[wide] + 1, b[wide] - 1
            level = np.frexp((last - first + 1).astype(float))[1] - 1
            for k in np.unique(level):
                own = level == k
                x = np.minimum(self.table[k][first[own]], self.table[k][last[own] + 1 - (1 << k)])
                out[wide[own]] = np.minimum(out[wide[own]], x)
        return out


class Extensions:
    """Lengths of the common prefixes of suffixes of one document."""

    def __init__(self, text: np.ndarray, rank: np.ndarray) -> None:
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        self.rank, self.least = rank, RangeMinima(lcp_array(text, order, rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of suffixes ``i < j``; one that begins at or beyond the end has nothing in common with another."""
        n, out = len(self.rank), np.zeros(len(i), np.int64)
        inside = np.flatnonzero((j < n) & (i >= 0))
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        out[inside] = self.least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def _joined(docs: list[np.ndarray], flip: bool = False) -> tuple[np.ndarray, int, np.ndarray]:
    """One array of the documents' symbols, each followed by its end, with no symbol in common; how many there are; where each begins."""
    lengths = np.array([len(d) for d in docs], np.int64)
    kinds = np.array([int(d.max()) + 2 if len(d) else 1 for d in docs], np.int64)
    base, begin = np.cumsum(kinds) - kinds, np.cumsum(lengths + 1) - lengths - 1
    out = np.repeat(base, lengths + 1)
    inside = np.ones(len(out), bool)
    inside[begin + lengths] = False
    words = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
    out[inside] += np.repeat(kinds, lengths) - 1 - words if flip else words + 1
    return out, int(kinds.sum()), begin


def find(docs: list[np.ndarray], least_length: int, exponent: int) -> list[np.ndarray]:
    """Runs ``(start, length, period)`` of each document of word numbers (from 0, without gaps), sorted by start and period.

    Those of at least ``least_length`` words and ``exponent`` (2 or more) periods.
    """
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(docs)
    if not docs:
        return out
    key, kinds, begin = _joined(docs)
    owner = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    end = begin + np.array([len(d) for d in docs])
    rank = suffix_ranks(key, kinds)
    roots = []
    for order in (rank, suffix_ranks(_joined(docs, flip=True)[0], kinds)):
        stop = next_smaller(order)
        i = np.flatnonzero(np.arange(len(key)) != end[owner])
        j = stop[i]
        need = np.minimum(np.maximum(least_length - (j - i), (exponent - 1) * (j - i)), GLANCE)
        near = np.zeros(len(i), np.int64)
        for step, first in ((1, 0), (-1, -1)):
            alive, a, b = np.arange(len(i)), i + first, j + first
            for _ in range(GLANCE):
                same = (b < len(key)) & (a >= 0)
                same[same] = key[a[same]] == key[b[same]]
                alive, a, b = alive[same], a[same] + step, b[same] + step
                near[alive] += 1
        roots.append(np.stack([i, j], axis=1)[near >= need])
    roots = np.unique(np.concatenate(roots), axis=0)
    left = np.unique(owner[roots[:, 0]])
    if not len(left):
        return out
    back, many, back_begin = _joined([docs[d][::-1] for d in left])
    back_rank = suffix_ranks(back, many)
    place = np.searchsorted(owner[roots[:, 0]], np.r_[left, len(docs)])
    for k, d in enumerate(left):
        n = len(docs[d])
        i, j = (roots[place[k] : place[k + 1]] - begin[d]).T
        local = lambda r, at: np.argsort(np.argsort(r[at : at + n]))  # noqa: E731  the end, which is least, goes
        right = Extensions(docs[d], local(rank, begin[d]))(i, j)
        before = Extensions(docs[d][::-1], local(back_rank, back_begin[k]))(n - j, n - i)
        start, period = i - before, j - i
        length = j + right - start
        keep = (length >= least_length) & (length >= exponent * period)
        out[d] = np.unique(np.stack([start, period, length], axis=1)[keep], axis=0)[:, [0, 2, 1]]
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers of the words, equal words alike, from 0 without gaps."""
    known = dict(zip(dict.fromkeys(words), count(), strict=False))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def without_repeats(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not len(found):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def periodic_runs(docs: DataFrame, least_length: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed`` of every document.

    ``runs``: (start, length, period) in words, sorted by start and period. ``collapsed``:
    the words outside of repeated periods, joined by one space.
    """
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def worked(ids: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        found = find([numbered(w) for w in words], least_length, exponent)
        flat = np.concatenate(found)
        offsets = np.r_[0, np.cumsum([len(f) for f in found])]
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
        collapsed = [b" ".join(without_repeats(w, f)) for w, f in zip(words, found, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, first, total = [], 0, 0
            for k in range(batch.num_rows):
                held.append(texts(batch.column(1).slice(k, 1))[0].split())
                total += len(held[-1])
                if total >= WORDS or k == batch.num_rows - 1:
                    yield worked(batch.column(0).slice(first, len(held)), held)
                    held, first, total = [], k + 1, 0

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
