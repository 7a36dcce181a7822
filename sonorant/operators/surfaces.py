"""Densities of points in the plane, for each label."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel_density(df: DataFrame, label: str, x: str, y: str, bins: int = 100, adjust: float = 0.5, least: int = 10, reach: float = 3.0) -> DataFrame:
    """``(label, gx, gy, x, y, density)``: Gaussian kernel density of each label's points on its own grid of ``bins`` by ``bins``.

    Bandwidths are the label's standard deviations times n^(-1/6) times ``adjust``; the grid goes ``reach`` of them
    beyond the extremes. Points are counted by cell first, so a label of any size is a table of at most
    bins² rows; the kernel is then applied along one axis and along the other, each an aggregation of what its cells
    give to ``bins`` places. Labels of fewer than ``least`` points, or of points on a line along an axis, are left out.
    """
    p = df.select(F.col(label).alias("_l"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    m = p.groupBy("_l").agg(F.count("*").alias("_n"), *[f(f"_{c}").alias(f"{name}{c}") for c in "xy" for name, f in (("_s", F.stddev_samp), ("_a", F.min), ("_b", F.max))])
    m = m.where((F.col("_n") >= least) & (F.col("_sx") > 0) & (F.col("_sy") > 0))
    for c in "xy":
        h = F.col(f"_s{c}") * F.pow(F.col("_n").cast("double"), F.lit(-1 / 6)) * adjust
        m = m.withColumn(f"_h{c}", h).withColumn(f"_lo{c}", F.col(f"_a{c}") - reach * F.col(f"_h{c}")).withColumn(f"_step{c}", (F.col(f"_b{c}") - F.col(f"_a{c}") + 2 * reach * F.col(f"_h{c}")) / bins)
    m = m.withColumnRenamed("_l", "_of").drop("_sx", "_sy", "_ax", "_ay", "_bx", "_by")
    cell = lambda c: F.least(F.floor((F.col(f"_{c}") - F.col(f"_lo{c}")) / F.col(f"_step{c}")), F.lit(bins - 1)).cast("int")
    counts = p.join(m, F.col("_l").eqNullSafe(F.col("_of"))).select(F.col("_of").alias("label"), cell("x").alias("bx"), cell("y").alias("by")).groupBy("label", "bx", "by").agg(F.count("*").alias("w"))
    places = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    kernel = lambda c: F.exp(-0.5 * F.pow((F.col(f"g{c}") - F.col(f"b{c}")) * F.col(f"_step{c}") / F.col(f"_h{c}"), F.lit(2.0)))
    joined = lambda d: d.join(m, F.col("label").eqNullSafe(F.col("_of")))
    across = joined(counts).withColumn("gx", places).groupBy("label", "gx", "by").agg(F.sum(F.col("w") * kernel("x")).alias("w"))
    both = joined(across).withColumn("gy", places).groupBy("label", "gx", "gy").agg(F.sum(F.col("w") * kernel("y")).alias("w"))
    centre = lambda c: F.col(f"_lo{c}") + (F.col(f"g{c}") + 0.5) * F.col(f"_step{c}")
    return joined(both).select(F.col("label").alias(label), "gx", "gy", centre("x").alias("x"), centre("y").alias("y"), (F.col("w") / (F.col("_n") * 2 * math.pi * F.col("_hx") * F.col("_hy"))).alias("density"))
