"""Language identification by sparse multinomial logistic regression.

Features: character 1- to 3-grams of the lower-cased text, hashed, with
sublinear term frequency, inverse document frequency (over all learning
documents) and unit length. Training: follow-the-regularised-leader with an
elastic-net penalty on a bounded sample, then one temperature fitted on a part
of the sample that the weights have not seen.

A text that is null or has no letter is ``und`` with score 0, as is every text
if nothing was learned. Rows without a language are not learned from. Repeated
rows and ties are predicted alike; extra columns are ignored, whatever their
names. Texts are read whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Documents learned from, at most (those of the least hashes).
SAMPLE = 6000
UNKNOWN = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of a text and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    key, found = points * np.uint32(0x9E3779B1), []
    found.append(key)
    for n in (1, 2):
        if len(points) > n:
            key = (key[:-1] ^ (key[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[n:] * np.uint32(0xC2B2AE3D) + np.uint32(n)
            found.append(key)
    keys = np.concatenate(found)
    counts = np.bincount((keys ^ (keys >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    index = np.flatnonzero(counts)
    return index, counts[index]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages)
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[index]
        return (x / max(float(np.sqrt(x @ x)), 1e-12)).astype(np.float32)

    def logits(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(index, counts) @ self.weights[index]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*grams(text)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (buckets, classes) after ``epochs`` of per-coordinate FTRL-proximal steps over (index, value) rows."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, x = rows[i]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[index] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[index] = more
    return weights(z, n).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a log grid refined twice."""
    if not len(y):
        return 1.0
    low, high = np.log(0.02), np.log(20.0)
    for _ in range(3):
        grid = np.linspace(low, high, 25)
        scaled = logits[None] / np.exp(grid)[:, None, None]
        top = scaled.max(axis=2, keepdims=True)
        loss = (np.log(np.exp(scaled - top).sum(axis=2)) + top[:, :, 0] - scaled[:, np.arange(len(y)), y]).mean(axis=1)
        best = int(loss.argmin())
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 24)]
    return float(np.exp(grid[best]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` that have a language: document frequencies of all, weights of at most ``sample``."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if has_letter(text):
                    total[grams(text)[0]] += 1
                    n += 1
        total[BUCKETS] = n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(grams(t), lang) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0].astype("<i4").tobytes() for g, _ in kept], pa.binary()), pa.array([g[1].astype("<i4").tobytes() for g, _ in kept], pa.binary()), pa.array([x for _, x in kept], pa.string())],
                ["index", "counts", "lang"],
            )

    df = np.zeros(BUCKETS + 1)
    for r in rows.select("text").mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS + 1 rows
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    one = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("r"))  # an id counts once
    picked = one.select("r.text", "r.lang").mapInArrow(features, "index binary, counts binary, lang string")  # at most `sample` rows
    got = sorted((r["lang"], r["index"], r["counts"]) for r in picked.collect())
    languages = sorted({lang for lang, _, _ in got})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), idf)
    model = Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), idf)
    sparse = [(np.frombuffer(i, "<i4"), np.frombuffer(c, "<i4")) for _, i, c in got]
    y = np.array([languages.index(lang) for lang, _, _ in got])
    vectors = [(i, model.vector(i, c)) for i, c in sparse]
    apart = np.random.default_rng(1).permutation(len(y)) % 5 == 0  # a fifth only fits the temperature
    fit = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
    weights = ftrl([vectors[i] for i in fit], y[fit], len(languages))
    held = np.flatnonzero(apart)
    logits = np.array([vectors[i][1] @ weights[vectors[i][0]] for i in held]).reshape(-1, len(languages))
    return Model(languages, weights, idf, temperature(logits, y[held]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row; only the text is looked at."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
