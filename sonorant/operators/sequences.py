"""Sequence analytics: soft Markov transition matrices, length quantiles, position histograms.

States are probability vectors in long form ``(group, t, state, p)``; a hard
sequence has p = 1. START and END are synthetic states around each sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def padded(df: DataFrame, group: str, *keep: str) -> DataFrame:
    """Steps renumbered from 1, with START before and END after every sequence."""
    base = df.select(group, *keep, F.dense_rank().over(Window.partitionBy(group).orderBy("t")).alias("t"), "state", "p")
    ends = base.groupBy(group, *keep).agg(F.max("t").alias("n"))
    marks = ends.select(group, *keep, F.inline(F.array(
        F.struct(F.lit(0).alias("t"), F.lit("START").alias("state"), F.lit(1.0).alias("p")),
        F.struct((F.col("n") + 1).alias("t"), F.lit("END").alias("state"), F.lit(1.0).alias("p")),
    )))
    return base.unionByName(marks)


def markov1(df: DataFrame, group: str, *by: str) -> DataFrame:
    """Order-1 transition probabilities ``(by..., src, dst, prob)``; only cells with weight."""
    steps = padded(df, group, *by)
    nxt = steps.select(group, (F.col("t") - 1).alias("t"), F.col("state").alias("dst"), F.col("p").alias("q"))
    cells = steps.join(nxt, [group, "t"]).groupBy(*by, F.col("state").alias("src"), "dst").agg(F.sum(F.col("p") * F.col("q")).alias("w"))
    return cells.select(*by, "src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy(*by, "src"))).alias("prob"))


def markov2(df: DataFrame, group: str) -> DataFrame:
    """Order-2 transition probabilities ``(s0, s1, s2, prob)``; rows are the pairs of states met."""
    steps = padded(df, group)
    one = steps.select(group, (F.col("t") - 1).alias("t"), F.col("state").alias("s1"), F.col("p").alias("p1"))
    two = steps.select(group, (F.col("t") - 2).alias("t"), F.col("state").alias("s2"), F.col("p").alias("p2"))
    cells = (
        steps.join(one, [group, "t"]).join(two, [group, "t"])
        .groupBy(F.col("state").alias("s0"), "s1", "s2").agg(F.sum(F.col("p") * F.col("p1") * F.col("p2")).alias("w"))
    )
    return cells.select("s0", "s1", "s2", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("s0", "s1")), 12).alias("prob"))


def markov1_rollup(df: DataFrame, group: str, by: str) -> DataFrame:
    """Matrices per ``by`` and for all (``by`` null) from one pass of cells."""
    steps = padded(df, group, by)
    nxt = steps.select(group, (F.col("t") - 1).alias("t"), F.col("state").alias("dst"), F.col("p").alias("q"))
    cells = steps.join(nxt, [group, "t"]).groupBy(by, F.col("state").alias("src"), "dst").agg(F.sum(F.col("p") * F.col("q")).alias("w"))
    every = cells.groupBy("src", "dst").agg(F.sum("w").alias("w")).withColumn(by, F.lit(None).cast(cells.schema[by].dataType))
    both = cells.unionByName(every.select(cells.columns))
    return both.select(by, "src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy(by, "src"))).alias("prob"))


def length_quantiles(df: DataFrame, group: str, *by: str) -> DataFrame:
    """Quartiles and whiskers (1.5 interquartile ranges) of log2 sequence lengths, of all or for each ``by``."""
    n = df.groupBy(*by, group).count().select(*by, F.log2("count").alias("x"))
    if by:
        q = n.groupBy(*by).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        q = q.select(*by, *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        inside = n.join(q, list(by)).where((F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach))
        return inside.groupBy(*by, "q1", "median", "q3").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    q = n.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    inside = n.crossJoin(F.broadcast(q)).where(  # one row
        (F.col("x") >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & (F.col("x") <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    )
    return inside.groupBy("q1", "median", "q3").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def position_histogram(df: DataFrame, cluster: str, position: str) -> DataFrame:
    """Share of each position within a cluster."""
    n = df.groupBy(cluster, position).count()
    return n.select(cluster, position, (F.col("count") / F.sum("count").over(Window.partitionBy(cluster))).alias("prob"))
