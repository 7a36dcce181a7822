"""Event runs over ordered frames: thresholds, gaps and islands, gap tolerance, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Number the rows of each key from 0 in ``order`` as frame ``i``."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint") - 1)


def runs(df: DataFrame, key: str, active: Column, min_frames: int, max_gap: int = 0, hold_open: bool = False) -> DataFrame:
    """Runs of active frames ``(key, seg, start_f, end_f)``, numbered from 1 after the length filter.

    Up to ``max_gap`` inactive frames are bridged. With ``hold_open`` a run still
    within the gap at the last frame of its key extends to that frame. One window
    partitioning on ``key`` serves all steps.
    """
    by = Window.partitionBy(key)
    marked = df.select(key, "i", active.alias("_on"), F.max("i").over(by).alias("_last")).where("_on")
    prev = F.lag("i").over(by.orderBy("i"))
    opened = marked.withColumn("_new", F.when(prev.isNull() | (F.col("i") - prev - 1 > max_gap), 1).otherwise(0))
    numbered = opened.withColumn("_run", F.sum("_new").over(by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(key, "_run").agg(F.min("i").alias("start_f"), F.max("i").alias("_end"), F.first("_last").alias("_last"))
    end = F.when(F.col("_last") - F.col("_end") <= max_gap, F.col("_last")).otherwise(F.col("_end")) if hold_open else F.col("_end")
    kept = spans.withColumn("end_f", end).where(F.col("end_f") - F.col("start_f") + 1 >= min_frames)
    return kept.select(key, F.row_number().over(by.orderBy("start_f")).cast("bigint").alias("seg"), "start_f", "end_f")


def with_times(df: DataFrame, pad: int, hop: int = 320, rate: int = 32000, pad_head: bool = True) -> DataFrame:
    """Adds padded ``onset`` and ``offset`` seconds; the onset is clamped at 0, the offset is not clamped."""
    start = F.greatest(F.col("start_f") - (pad if pad_head else 0), F.lit(0))
    return df.select("*", F.round(start * hop / rate, 2).alias("onset"), F.round((F.col("end_f") + pad) * hop / rate, 2).alias("offset"))


def split_at_silence(df: DataFrame, key: str, silent: Column, min_frames: int, keep: int) -> DataFrame:
    """Pieces ``(key, seg, start_f, end_f)`` between silences of ``min_frames`` or more, ``keep`` silent frames left on at either end.

    Where a silence is shorter than twice ``keep`` both neighbours keep it. A key that is all silence gives no piece.
    """
    last = df.groupBy(key).agg(F.max("i").alias("_last"))
    quiet = runs(df, key, silent, min_frames).select(key, F.col("start_f").alias("_s"), F.col("end_f").alias("_e"))
    by = Window.partitionBy(key).orderBy("_s")
    edges = quiet.unionByName(last.select(key, (F.col("_last") + 1).alias("_s"), (F.col("_last") + 1).alias("_e")))  # an empty silence after the end
    loud = edges.join(last, key).withColumn("_from", F.coalesce(F.lag("_e").over(by) + 1, F.lit(0))).where(F.col("_s") > F.col("_from"))
    out = loud.withColumn("start_f", F.greatest(F.col("_from") - keep, F.lit(0))).withColumn("end_f", F.least(F.col("_s") - 1 + keep, F.col("_last")))
    return out.select(key, F.row_number().over(by).cast("bigint").alias("seg"), "start_f", "end_f")
