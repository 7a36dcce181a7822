"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are grown on labelled documents (histogram splits, logistic loss) with
monotonic constraints: more repetition, more symbols or more shouting can never
raise a score. They are flattened to node arrays of complete binary trees, and a
batch is scored by walking all trees of all documents at once.

A null text is an empty one: no words, which the base rules fail. Repeated rows
and ties are scored alike; extra columns are ignored (``kept`` keeps them), whatever
their names. Texts are measured whole, however long; an empty table gives no rows. Labels: null ones are
skipped; of several for a document the lowest counts. Without labels of both
kinds only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import texts

#: Labelled documents the trees are grown on, at most (those of the least hashes).
SAMPLE = 20_000
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistic and its constraint: -1 if the score must not rise with it.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "distinct_rate": 0, "top_word_rate": -1,
    "upper_rate": -1, "digit_rate": 0, "mark_rate": -1, "stop_rate": 0, "bar_rate": -1, "line_words": 0, "high_rate": 0,
}


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint64, len(words))
    h, step = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while step < window:  # hash of 2, 4, 8 words
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[step:] ^ (h[step:] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        step *= 2
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    span = np.arange(window)
    if (ids[a[:, None] + span] != ids[b[:, None] + span]).any():  # a hash collision: compare the windows themselves
        _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, window), axis=0, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(counts[inverse.reshape(-1)] > 1)
    else:
        hit = np.unique(np.r_[a, b])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts[:0x80].sum() + counts[0xC0:].sum() - counts[0x20] - counts[9:14].sum())
    symbols = int(counts[list(b"#*$%&|<>")].sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = repeat_words(words)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    marks = int(counts[[0x21, 0x3F]].sum())
    features = [
        float(np.log1p(n)), chars / n, symbols / n, dup / lines, repeated / n, len(tally) / n, max(tally.values()) / n,
        counts[65:91].sum() / chars, counts[48:58].sum() / chars, marks / n, counts[[0x2C, 0x2E]].sum() / n, counts[0x7C] / n, n / lines,
        counts[0xC0:].sum() / chars,
    ]
    return [n, chars, symbols, dup, repeated], [float(x) for x in features]


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees, one row each: feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a document is good."""
        if not len(self.leaf) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        inner = self.feature.shape[1]
        while node.flat[0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.start + self.leaf[tree, node - inner].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 2.0, least: float = 5.0, bins: int = 48) -> Trees:
    """Boost ``rounds`` trees of ``depth`` levels on features ``x`` and labels ``y`` (0 or 1)."""
    good = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
    start = float(np.log(good / (1 - good)))
    inner, signs = 2**depth - 1, np.array(list(FEATURES.values()))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    n, width = x.shape
    logit = np.full(n, start)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(n, int)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            key = (((node - first)[:, None] * width + np.arange(width)) * bins + binned).ravel()
            size = many * width * bins
            g = np.bincount(key, np.repeat(grad, width), size).reshape(many, width, bins).cumsum(axis=2)
            h = np.bincount(key, np.repeat(hess, width), size).reshape(many, width, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            lo, hi = low[first : first + many, None, None], high[first : first + many, None, None]
            left, right = np.clip(-g / (h + smooth), lo, hi), np.clip(-(gt - g) / (ht - h + smooth), lo, hi)

            def worth(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
                return -(g * w + 0.5 * (h + smooth) * w * w)

            gain = worth(left, g, h) + worth(right, gt - g, ht - h) - worth(np.clip(-gt / (ht + smooth), lo, hi), gt, ht)
            bad = (h < least) | (ht - h < least) | (signs[None, :, None] * (right - left) < 0)
            gain = np.where(bad, -np.inf, gain).reshape(many, -1)
            best = gain.argmax(axis=1)
            for k in range(many):
                at, (f, b) = first + k, divmod(int(best[k]), bins)
                low[[2 * at + 1, 2 * at + 2]], high[[2 * at + 1, 2 * at + 2]] = low[at], high[at]
                if gain[k, best[k]] > 1e-6 and b < len(cuts[f]):
                    feature[at], threshold[at] = f, cuts[f][b]
                    middle = (left[k, f, b] + right[k, f, b]) / 2
                    if signs[f] < 0:
                        low[2 * at + 1], high[2 * at + 2] = max(low[at], middle), min(high[at], middle)
                    elif signs[f] > 0:
                        high[2 * at + 1], low[2 * at + 2] = min(high[at], middle), max(low[at], middle)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        leaf = rate * np.clip(-g / (h + smooth), low[inner:], high[inner:])
        logit += leaf[node - inner]
        trees.append((feature, threshold, leaf))
    return Trees(*(np.stack(part) for part in zip(*trees, strict=True)), start)


def _measured(docs: DataFrame, id_col: str, text_col: str, trees: Trees | None) -> DataFrame:
    """Base counts of every row, with the features, or the verdict of ``trees``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t) for t in texts(batch.column(1))]
            base = np.array([b for b, _ in got], np.int64).reshape(-1, 5)
            x = np.array([f for _, f in got]).reshape(-1, len(FEATURES))
            columns = [batch.column(0), *(pa.array(base[:, i]) for i in range(5))]
            if trees is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", *BASE, "features"])
            else:
                failed, score = base_failed(base), trees.score(x)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)], ["id", *BASE, "base_failed", "kept", "score"])

    more = "features array<double>" if trees is None else "base_failed boolean, kept boolean, score double"
    schema = f"id {kind}, {', '.join(f'{c} bigint' for c in BASE)}, {more}"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees from ``labels(id, quality)`` of at most ``sample`` documents, those whose ids hash lowest."""
    known = (
        labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    chosen = chosen.groupBy("id").agg(F.min("text").alias("text"))  # an id counts once, so at most `sample` rows
    rows = _measured(chosen, "id", "text", None).join(F.broadcast(known), "id").select("features", "quality", *BASE).collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, len(FEATURES))
    base = np.array([[r[c] for c in BASE] for r in rows], np.int64).reshape(-1, 5)
    y = np.array([float(r["quality"]) for r in rows])
    ok = ~base_failed(base)  # what the base rules reject needs no verdict
    return grow(x[ok], y[ok])


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base counts, base_failed, kept, score)`` of every row."""
    return _measured(docs, id_col, text_col, trees)


def kept(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the base rules and the trees keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t) for t in texts(batch.column(batch.schema.names.index(text_col)))]
            base = np.array([b for b, _ in got], np.int64).reshape(-1, 5)
            good = ~base_failed(base) & (trees.score(np.array([f for _, f in got]).reshape(-1, len(FEATURES))) >= 0.5)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
