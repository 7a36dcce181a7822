"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "sonorant", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC times, ANSI SQL and adaptive execution (skewed joins split at run time)."""
    build = SparkSession.builder.appName(app)
    if master:
        build = build.master(master)
    if shuffle_partitions:
        build = build.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        build.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))  # recordings are large rows
        .getOrCreate()
    )


def shared_place(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; one of its own only where everything runs in one process."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="sonorant-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: computed once, so that all that reads it sees the same rows in the same partitions."""
    shared_place(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    For loops: a checkpoint still carries what the optimiser knows of its columns, which can double with
    every round of joins; a table read again knows its schema alone.
    """
    path = f"{shared_place(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
