"""Streaming counterparts: coalescing intervals and closing runs as events arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def coalesced(events: DataFrame, key: str, gap_seconds: float, late: str = "10 minutes") -> DataFrame:
    """Merged intervals from ``(key, onset, offset)`` timestamps as session windows with a gap for each row.

    A row reaches from its onset to its offset plus the gap, so overlapping reaches
    join, which is the running-maximum rule of the batch operator. Closed sessions are
    emitted once the watermark has passed them.
    """
    reach = F.concat(((F.unix_millis("offset") - F.unix_millis("onset")) / 1000 + gap_seconds).cast("string"), F.lit(" seconds"))
    return (
        events.withWatermark("onset", late).groupBy(key, F.session_window("onset", reach))
        .agg(F.min("onset").alias("onset"), F.max("offset").alias("offset"), F.count("*").alias("n")).drop("session_window")
    )


def call_sessions(frames: DataFrame, key: str, threshold: float, gap_seconds: float, least: int, late: str = "10 minutes") -> DataFrame:
    """Runs of frames ``(key, ts, score)`` above ``threshold`` at most ``gap_seconds`` apart, of ``least`` active frames or more."""
    active = frames.where(F.col("score") > threshold).withWatermark("ts", late)
    runs = active.groupBy(key, F.session_window("ts", f"{gap_seconds} seconds")).agg(F.min("ts").alias("onset"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("session_window")


def over_new_files(spark: SparkSession, path: str, schema: str | StructType, plan: Callable[[DataFrame], DataFrame], out: str, log: str, files_at_once: int = 1000) -> DataFrame:
    """Run ``plan`` over what has arrived under ``path`` since the last call and append its closed windows to ``out``; returns all of ``out``.

    ``path`` is a folder of files or one file; ``log`` the query's checkpoint, so a call
    that fails is made good by the next one; ``files_at_once`` make a micro-batch. A path with nothing behind it is an error.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{folder}/{{{name}}}")  # as a pattern of one name: a stream takes no plain path of a file
    result = plan(files)
    result.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
