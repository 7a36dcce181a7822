"""Envelope smoothing and peaks over ordered frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, key: str, x: str, width: int = 10) -> DataFrame:
    """Zero-padded moving average of constant divisor: ``width // 2`` frames before, the rest after."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(-(width // 2), width - width // 2 - 1)
    return df.withColumn("smooth", F.sum(x).over(w) / width)


def running_median(df: DataFrame, key: str, x: str, half: int = 2) -> DataFrame:
    """Median of ``2 * half + 1`` frames, zeros beyond the ends."""
    w = Window.partitionBy(key).orderBy("i")
    around = F.array_sort(F.array(*[F.coalesce(F.lag(x, d).over(w) if d > 0 else F.lead(x, -d).over(w) if d < 0 else F.col(x), F.lit(0.0)) for d in range(-half, half + 1)]))
    return df.withColumn("median", F.get(around, half))


def normalised(df: DataFrame, key: str, x: str) -> DataFrame:
    """Divided by the key's maximum where that is positive."""
    top = F.max(x).over(Window.partitionBy(key))
    return df.withColumn("norm", F.when(top > 0, F.col(x) / top).otherwise(F.col(x)))


def local_peaks(df: DataFrame, key: str, x: str, height: float = 0.3) -> DataFrame:
    """Strict local maxima of at least ``height``; the middle of a plateau counts, ends don't.

    Plateaus are runs of equal values, found with one window over the key.
    """
    w = Window.partitionBy(key).orderBy("i")
    marked = df.withColumn("_n", F.when(F.lag(x).over(w) == F.col(x), 0).otherwise(1)).withColumn("_run", F.sum("_n").over(w))
    flat = marked.groupBy(key, "_run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first(x).alias(x))
    r = Window.partitionBy(key).orderBy("a")
    return (
        flat.withColumn("_p", F.lag(x).over(r)).withColumn("_q", F.lead(x).over(r))
        .where((F.col(x) > F.col("_p")) & (F.col(x) > F.col("_q")) & (F.col(x) >= height))
        .select(key, F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("i"), x)
    )


def distant_peaks(peaks: DataFrame, key: str, x: str, distance: int = 5) -> DataFrame:
    """Peaks at least ``distance`` apart, the higher first, of equals the later.

    Peaks are cut into islands wherever two in a row are ``distance`` or more apart, as
    none suppresses another across such a gap; each island is settled by itself.
    """
    w = Window.partitionBy(key).orderBy("i")
    apart = F.coalesce(F.col("i") - F.lag("i").over(w) >= distance, F.lit(True)).cast("int")
    islands = peaks.withColumn("_new", apart).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def suppress(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        at, keep = pdf["i"].to_numpy(), np.ones(len(pdf), bool)
        for j in np.argsort(pdf[x].to_numpy(), kind="stable")[::-1]:
            if keep[j]:
                low, high = np.searchsorted(at, at[j] - distance, "right"), np.searchsorted(at, at[j] + distance)
                keep[low:j] = keep[j + 1 : high] = False
        return pdf[keep].drop(columns="_island")

    return islands.groupBy(key, "_island").applyInPandas(suppress, peaks.schema)
