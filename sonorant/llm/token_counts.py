"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node's failure link leads to the node of
what is left after the greedy pieces of its string are cut off, and its pop
count says how many pieces those are; both are worked out once, breadth first.
A word is then read byte by byte: where the trie has no way on, the pops are
added and the failure link is followed. That counts exactly the pieces of
greedy longest-match-first in time linear in the word, and no piece is built.

Words (runs of anything but 0x20 and 0x09-0x0D) are read with a blank before
them, as the vocabulary marks the starts of words. Null and word-less texts count
zero. Repeated rows and ties stay; extra columns are ignored, whatever their
names. Texts are read whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import texts
from .bpe import load_ranks

#: Words a worker remembers before it starts its memo anew, and the bytes of a word it remembers at most.
MEMO, LONGEST = 400_000, 64


class Automaton(dict):
    """Word (with its blank) to its number of pieces; unknown words are run through the trie.

    The vocabulary must hold every single byte, so that a word can always be cut.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        super().__init__()
        goto: dict[int, int] = {}
        ends, parent, byte = [False], [0], [0]
        for token in vocabulary:
            node = 0
            for b in token:
                nxt = goto.get(node << 8 | b)
                if nxt is None:
                    nxt = goto[node << 8 | b] = len(ends)
                    ends.append(False)
                    parent.append(node)
                    byte.append(b)
                node = nxt
            ends[node] = bool(node)
        if any(b not in goto for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        depth = [0] * len(ends)
        for v in range(1, len(ends)):  # a parent is always made before its children
            depth[v] = depth[parent[v]] + 1
        fail, pops, rest = [0] * len(ends), [0] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                pops[v] = 1
            else:
                z, n = fail[parent[v]], pops[parent[v]]
                while (w := goto.get(z << 8 | byte[v])) is None:
                    n += pops[z]
                    z = fail[z]
                fail[v], pops[v] = w, n
            rest[v] = pops[v] + rest[fail[v]]
        self.goto, self.fail, self.pops, self.rest = goto, fail, pops, rest

    def __missing__(self, word: bytes) -> int:
        goto, fail, pops, state, total = self.goto, self.fail, self.pops, 0, 0
        for b in b" " + word:
            while (nxt := goto.get(state << 8 | b)) is None:
                total += pops[state]
                state = fail[state]
            state = nxt
        total += self.rest[state]
        if len(word) <= LONGEST:
            self[word] = total
        return total


@lru_cache(maxsize=2)
def automaton(ranks_path: str) -> Automaton:
    return Automaton(load_ranks(ranks_path))


def token_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens, longest)``: words, pieces, and the most pieces of one word."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(ranks_path)
        for batch in batches:
            found = []
            for text in texts(batch.column(1)):
                counts = [known[w] for w in text.split()]
                found.append((len(counts), sum(counts), max(counts, default=0)))
                if len(known) > MEMO:
                    known.clear()
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_words", "n_tokens", "longest"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint, longest bigint")
