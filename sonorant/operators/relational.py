"""Relational glue: overrides, skips, priorities, renumbering, relative top-k, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

def dirty_bool(c: Column) -> Column:
    """True for ``true`` in any case with blanks around; false for other text; null stays."""
    return F.lower(F.trim(c.cast("string"))) == "true"


def override(base: DataFrame, newer: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join; a non-null newer value replaces the base one. Of several newer rows for a key the greatest counts, as a whole."""
    one = newer.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new"))
    joined = base.join(one, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in columns else c for c in base.columns])


def not_in(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``done``."""
    return df.join(done.select(key), key, "left_anti")


def without_prefix(df: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows whose ``name`` starts with none of ``prefixes``.

    Equi-joins: each distinct name is cut at the lengths that prefixes have (one small
    row, as lengths are bounded by those of names). A null name or prefix matches nothing.
    """
    p = prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("_p")).distinct()
    lengths = F.broadcast(p.agg(F.collect_set(F.length("_p")).alias("_l")))
    names = df.select(F.col(name).alias("_n")).distinct().crossJoin(lengths)
    cuts = names.withColumn("_p", F.explode(F.transform(F.filter("_l", lambda n: n <= F.length("_n")), lambda n: F.substring("_n", F.lit(1), n))))
    return df.join(cuts.join(p, "_p", "left_semi").select(F.col("_n").alias(name)).distinct(), name, "left_anti").select(df.columns)


def first_by_priority(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in ascending ``order``; aggregated before the shuffle, so a hot key is no burden."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def ranked(df: DataFrame, *order: Column, start: int = 1, parts: int = 0) -> DataFrame:
    """Dense numbers ``n`` over a total order without one task sorting everything.

    Rows are range-partitioned and checkpointed, so that counts and places speak of
    the same ranges; a row's number is its place within its range plus the sizes
    of the ranges before.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    # monotonically_increasing_id is (partition << 33) + place in the partition
    sizes = ranged.groupBy(F.shiftright("_m", 33).alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each range
    named = ranged.withColumn("_part", F.shiftright("_m", 33)).join(F.broadcast(before), "_part")
    return named.withColumn("n", (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + start).cast("bigint")).drop("_m", "_part", "_before")


def split_exactly(df: DataFrame, share: float, key: Column) -> DataFrame:
    """Adds ``train``: true for exactly floor(``share`` of all) rows, those of the least hashes of ``key`` (which must be unique)."""
    n = df.count()
    return ranked(df, F.md5(key.cast("string")), key).withColumn("train", F.col("n") <= int(share * n)).drop("n")


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def resampled(df: DataFrame, key: str, weight: str, factor: float, seed: int = 0) -> DataFrame:
    """Sampling with replacement to about ``factor`` times the rows, in proportion to ``weight``.

    A row comes as often as its expectation, rounded up or down by chance; copies are numbered ``copy``.
    """
    total = df.agg((F.count("*") * factor / F.sum(weight)).alias("_f"))  # one row
    times = F.floor(F.col(weight) * F.col("_f") + uniform(F.col(key), seed)).cast("int")
    many = df.crossJoin(F.broadcast(total)).withColumn("_t", times).where("_t > 0")
    return many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).drop("_f", "_t")


def by_prefix(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and those whose names start with ``prefix``."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def without_ends(matrix: DataFrame, row: str, first: str = "START", last: str = "END") -> DataFrame:
    """A labelled matrix without its first state's row and its last state's column, missing ones ignored."""
    return matrix.where(F.col(row) != first).drop(last)


def later_wins(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Union of two keyed tables; of a key in both the newer row stays."""
    return newer.unionByName(older.join(newer.select(key), key, "left_anti").select(newer.columns))


def unknown_labels(df: DataFrame, label: str, known: list[str]) -> DataFrame:
    """What a skip of unknown labels leaves out: ``(label, n)``, for a warning."""
    return df.where(~F.coalesce(F.col(label).isin(known), F.lit(False))).groupBy(label).agg(F.count("*").alias("n"))


def large_groups(df: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Rows of groups of ``least`` rows or more."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def totals(places: DataFrame, files: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, total)`` for each of ``places``, 0 where it has no file."""
    sums = files.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return places.select(key).join(sums, key, "left").na.fill(0, ["n"]).na.fill(0.0, ["total"])


def copy_plan(rows: DataFrame, files: DataFrame, key: str, target: Column) -> DataFrame:
    """``(source, target)`` of the files to copy: those that ``rows`` name, each under ``target`` (made of the joined columns)."""
    return rows.join(files, key).select(F.col("path").alias("source"), target.alias("target")).distinct()


def conversion_plan(files: DataFrame, done: DataFrame, ending: str = ".wav") -> DataFrame:
    """``(source, target)`` of files of another ``ending`` that have no converted file yet; names are kept but for the ending."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    todo = files.where(~F.endswith(F.lower("path"), F.lit(ending))).select(F.col("path").alias("source"), F.concat(stem, F.lit(ending)).alias("target"))
    return todo.join(done.select(F.col("path").alias("target")), "target", "left_anti").select("source", "target")


def relative_top(df: DataFrame, cluster: str, score: str, share: float, n: int, *order: Column) -> DataFrame:
    """Of each cluster the first ``n`` rows in ``order`` whose score is at least ``share`` of the cluster's best."""
    best = df.groupBy(cluster).agg(F.max(score).alias("_best"))
    near = df.join(best, cluster).where(F.col(score) >= share * F.col("_best"))
    # a bounded rank: tasks keep n rows of a cluster each before the shuffle
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_best")


def class_weights(df: DataFrame, cls: str, classes: DataFrame | None = None) -> DataFrame:
    """Inverse-frequency weights, rescaled to sum to the number of classes; ``classes`` names those that may have no row."""
    n = df.groupBy(cls).count()
    if classes is not None:
        n = classes.select(cls).distinct().join(n, cls, "left").na.fill(0, ["count"])
    every = Window.partitionBy()  # a row for each class
    raw = n.withColumn("w", F.sum("count").over(every) / (F.count("*").over(every) * F.greatest(F.col("count").cast("double"), F.lit(1e-6))))
    return raw.select(cls, (F.col("w") / F.sum("w").over(every) * F.count("*").over(every)).alias("weight"))


def masked_accuracy(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """Accuracy over rows with a target, and over those of class 0."""
    ok = (F.col(predicted) == F.col(target)).cast("double")
    return df.where(F.col(target).isNotNull()).agg(F.avg(ok).alias("overall"), F.avg(F.when(F.col(target) == 0, ok)).alias("class0"))
