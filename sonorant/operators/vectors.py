"""Feature vectors as ARRAY<DOUBLE>: standardising, similarity, centroids, windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import together


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column, floor: float = 1e-8) -> Column:
    size = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / size)


def argmax(a: Column) -> Column:
    """Zero-based place of the first greatest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def standardised(df: DataFrame, features: str) -> DataFrame:
    """Population z-scores of each coordinate; a constant one is divided by 1. Moments take one pass, rows without features keep none."""
    m = df.where(F.size(features) > 0).select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(features)).alias("m")).first()
    if m is None or not m["m"]["count"]:
        return df
    n, mean = m["m"]["count"], m["m"]["mean"].toArray()
    std = np.sqrt(np.maximum(m["m"]["variance"].toArray(), 0) * (n - 1) / n)
    means, scales = (F.array(*map(F.lit, v.tolist())) for v in (mean, np.where(std > 0, std, 1.0)))
    return df.withColumn(features, F.transform(features, lambda x, i: (x - F.get(means, i)) / F.get(scales, i)))


def centroids(df: DataFrame, label: str, features: str) -> DataFrame:
    """Mean vector of each label; partial sums by (label, place), so a hot label only adds partial rows."""
    by_place = df.select(label, F.posexplode(features).alias("_i", "_x")).groupBy(label, "_i").agg(F.avg("_x").alias("_m"))
    return by_place.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_c")).select(label, F.transform("_c", lambda c: c["_m"]).alias("centroid"))


#: Centroids that are broadcast at once, and bytes of them; of more, one lot after another.
MOST_CENTROIDS, MOST_BYTES = 4096, 16 << 20


def similarities(df: DataFrame, cents: DataFrame, features: str, label: str) -> DataFrame:
    """Adds ``sims``: (label, cosine) of every vector with every centroid ``cents(label, centroid)``, in the row, without a join or shuffle.

    A vector is normalised once. Centroids, a row for each label, are broadcast in lots of bounded size.
    """
    n, width = cents.agg(F.count("*"), F.max(F.size("centroid"))).first()
    lots = max(1, -(-n // max(1, min(MOST_CENTROIDS, MOST_BYTES // (8 * max(width or 1, 1))))))
    c = cents.select(F.struct(F.col(label).alias("label"), l2_normalised(F.col("centroid")).alias("c")).alias("_s"), F.pmod(F.xxhash64(label), F.lit(lots)).alias("_lot"))
    out = df.withColumn("_x", l2_normalised(F.col(features))).withColumn("sims", F.array().cast(f"array<struct<label:{cents.schema[label].dataType.simpleString()},sim:double>>"))
    for lot in range(lots):
        one = c.where(F.col("_lot") == lot).agg(F.sort_array(F.collect_list("_s")).alias("_cs"))  # one row
        more = F.transform("_cs", lambda s: F.struct(s["label"].alias("label"), dot(F.col("_x"), s["c"]).alias("sim")))
        out = out.crossJoin(F.broadcast(one)).withColumn("sims", F.concat("sims", more)).drop("_cs")
    return out.drop("_x")


def nearest(sims: Column) -> Column:
    """Of ``similarities`` the (sim, label) with the greatest cosine, of equals the least label (numbers only)."""
    best = F.array_max(F.transform(sims, lambda s: F.struct(s["sim"].alias("sim"), (-s["label"]).alias("label"))))
    return F.struct((-best["label"]).alias("label"), best["sim"].alias("sim"))


def limited_centres(df: DataFrame, label: str, features: str, most: int, key: str) -> DataFrame:
    """Unit centres of at most ``most`` vectors of each label, those of the least ``key``."""
    w = Window.partitionBy(label).orderBy(key)
    some = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)  # a bounded rank: cut before the shuffle too
    return centroids(some, label, features).withColumn("centroid", l2_normalised(F.col("centroid")))


def super_embedding(left: DataFrame, right: DataFrame, key: str, features: str) -> DataFrame:
    """Both tables' features standardised and put side by side; a key that is missing on either side, or comes twice, is an error."""
    a = standardised(left.select(key, F.col(features).alias("_a")), "_a")
    b = standardised(right.select(key, F.col(features).alias("_b")), "_b")
    both = a.join(b, key, "full")
    many = Window.partitionBy(key)
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.count("*").over(many) > 1)
    checked = both.withColumn("_bad", bad)
    return checked.select(key, F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("keys do not agree: "), F.col(key).cast("string"))).cast("array<double>")).otherwise(F.concat("_a", "_b")).alias(features))


def window_dataset(df: DataFrame, key: str, labels: str, features: str, size: int, hop: int, positive: float = 5.0) -> DataFrame:
    """``(key, w, x, labels, flag, weight)``: windows of each row's features with its label vector; a row with a label weighs ``positive``, else 1."""
    flag = F.aggregate(labels, F.lit(0.0), lambda s, x: s + x) > 0
    rows = df.select(key, F.posexplode(windows(F.col(features), size, hop)).alias("w", "x"), F.col(labels).alias("labels"), flag.alias("flag"))
    return rows.withColumn("weight", F.when(F.col("flag"), positive).otherwise(1.0))


def masked_bce(logits: Column, targets: Column, weight: Column) -> Column:
    """Weighted binary cross-entropy of one row's logits; null targets are masked. Null if all are."""
    x = F.zip_with(logits, targets, lambda z, t: F.when(t.isNotNull(), F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))))
    known = F.filter(x, lambda v: v.isNotNull())
    return weight * F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.size(known))


#: Rows of a piece of a batch, about, of which two meet in a task, and rows that are held against a piece at once.
PIECE, TILE = 8192, 256


def contrastive_loss(df: DataFrame, batch: str, key: str, label: str, features: str, temperature: float = 0.1) -> DataFrame:
    """``(batch, loss)``: supervised contrastive loss within each batch, over unit vectors; with two views for each label it is NT-Xent.

    Rows without a partner of their label count nothing. Only rows of a batch meet: large batches are dealt into
    pieces, and each two pieces are one matrix product.
    """
    rows = df.select(F.col(batch).alias("b"), F.col(key).alias("k"), F.col(label).alias("l"), F.col(features).cast("array<double>").alias("x"))
    rows = rows.where(F.col("b").isNotNull() & F.col("k").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())).withColumn("w", F.size("x"))
    sizes = rows.groupBy("b", "w").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    dealt = rows.join(sizes, ["b", "w"]).withColumn("own", F.pmod(F.xxhash64("k"), F.col("pieces")).cast("int"))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("pieces") - 1))).drop("own", "pieces")
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).drop("own", "pieces")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-8)

    def met(a: pa.Table, c: pa.Table) -> pa.Table:
        none = {"b": a["b"].slice(0, 0), "k": a["k"].slice(0, 0), "e": pa.array([], pa.float64()), "o": pa.array([], pa.float64()), "n": pa.array([], pa.int64())}
        if not len(a) or not len(c):
            return pa.table(none)
        same = a["i"][0].as_py() == a["j"][0].as_py()
        codes = lambda name: np.split(_codes(pa.chunked_array([*a[name].chunks, *c[name].chunks])), [len(a)])
        (k1, k2), (l1, l2) = codes("k"), codes("l")
        width = a["w"][0].as_py()
        x, y = (unit(t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), width)) for t in (a, c))
        own1, n1 = _label_sums(x, l1, y, l2)
        own2, n2 = _label_sums(y, l2, x, l1)
        e1, e2 = np.zeros(len(x)), np.zeros(len(y))
        for at in range(0, len(x), TILE):
            s = x[at : at + TILE] @ y.T
            e = np.exp(s / temperature)
            if same:  # the only place where a key meets itself
                p, q = np.nonzero(k1[at : at + TILE, None] == k2[None])
                e[p, q] = 0
                mine = (l1[at + p] == l2[q]) & (l2[q] >= 0)
                np.subtract.at(own1, at + p[mine], s[p[mine], q[mine]])
                np.subtract.at(n1, at + p[mine], 1)
            e1[at : at + TILE] = e.sum(axis=1)
            if not same:
                e2 += e.sum(axis=0)
        sides = [(a, e1, own1, n1)] if same else [(a, e1, own1, n1), (c, e2, own2, n2)]
        return pa.concat_tables([pa.table({"b": t["b"], "k": t["k"], "e": e, "o": o / temperature, "n": n}) for t, e, o, n in sides])

    pairs = together(left, right, ("b", "w", "i", "j"), met, f"b {kinds['b']}, k {kinds['k']}, e double, o double, n bigint")
    row = pairs.groupBy("b", "k").agg(F.log(F.sum("e")).alias("all"), F.try_divide(F.sum("o"), F.sum("n")).alias("own"), F.sum("n").alias("n"))
    return row.where("n > 0").groupBy(F.col("b").alias(batch)).agg(F.avg(F.col("all") - F.col("own")).alias("loss"))


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, equal where values are, -1 for null."""
    return values.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _label_sums(x: np.ndarray, own: np.ndarray, y: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the sum of its products with the rows of ``y`` that have its label, and their number."""
    names, place = np.unique(others, return_inverse=True)
    total, count = np.zeros((len(names), y.shape[1])), np.bincount(place, minlength=len(names))
    np.add.at(total, place, y)
    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
    there = (names[at] == own) & (own >= 0)
    return np.where(there, (x * total[at]).sum(axis=1), 0.0), np.where(there, count[at], 0).astype(np.int64)


def windows(features: Column, size: int, hop: int, tail: str = "drop", pad: float = 0.0) -> Column:
    """Fixed windows over an array.

    A shorter array is padded to one window. ``tail``: "drop" leaves the rest out;
    "anchor" adds a window that ends with the array, also where the tiling is exact.
    """
    n = F.size(features)
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(hop))
    if tail == "anchor":
        last = F.element_at(starts, -1) + hop
        starts = F.when((n >= size) & (last < n), F.concat(starts, F.array(n - size))).otherwise(starts)
    full = F.when(n < size, F.concat(features, F.array_repeat(F.lit(pad), size - n))).otherwise(features)
    return F.transform(starts, lambda s: F.slice(full, s + 1, size))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
