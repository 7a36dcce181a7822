"""Small helpers shared by the corpus operators: staging, arrow batches, components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; ``bytes.split()`` splits on the same set.
WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of its own only where everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sonorant-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_released = 0.0


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so only when the driver collects its garbage, which a driver with room may not do for hours."""
    global _released
    if time.monotonic() - _released > 5:
        gc.collect()
        spark._jvm.System.gc()
        _released = time.monotonic()


def stage(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it again, which cuts its lineage.

    A lost executor then costs a reread of files instead of the whole history.
    Returns the reread table and its path (for ``drop``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sonorant-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` to ``(node, component)``.

    ``component`` is the smallest node of the component; only nodes with an edge
    to another node are returned. Alternates large-star and small-star rounds
    built from aggregates and joins (no neighbour list is ever gathered, so a hub
    with millions of links is only a skewed join key), and stages each round.
    Null ends and loops are dropped; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    now, path = stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        per = now.groupBy("u").agg(F.count("*").alias("n"))
        forked = not per.where("n > 1").isEmpty()
        if not forked and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(roots, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(roots.select("u", F.col("m").alias("v"))).distinct()
        )
        old = path
        now, path = stage(small, "edges")
        drop(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


#: A block is hot from this many members on; they are counted over one member in ``_EVERY``.
_HOT, _EVERY = 100_000, 64
#: Hot blocks that are dealt out, at most (the largest); each of its parts.
_MOST_HOT, _PARTS = 10_000, 1024


def meeting(blocks: DataFrame, similarity: float) -> DataFrame:
    """Of ``blocks(v, key, size, ...)`` the rows that meet another of their ``v`` of which the smaller size is ``similarity`` of the larger or more.

    ``key`` is a number whose low bits vary, and stands once under a ``v``. One exchange by ``v`` does it: in order
    of size, a row with any such partner has one next to it. Blocks that are hot in a sample are known to hold more, so they are dealt
    into parts and stay whole (that bears on speed alone).
    """
    some = blocks.where(F.pmod("key", F.lit(_EVERY)) == 0).groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= _HOT // _EVERY)
    hot = some.orderBy(F.desc("n")).limit(_MOST_HOT).select("v", F.lit(True).alias("_hot"))
    dealt = blocks.join(F.broadcast(hot), "v", "left").withColumn("_part", F.when(F.col("_hot"), F.pmod("key", F.lit(_PARTS))).otherwise(0))
    own = Window.partitionBy("v", "_part").orderBy("size")
    both = dealt.withColumn("_less", F.lag("size").over(own)).withColumn("_more", F.lead("size").over(own))
    near = (F.col("_less") >= F.lit(similarity) * F.col("size") - 1e-9) | (F.col("size") >= F.lit(similarity) * F.col("_more") - 1e-9)
    return both.where(F.coalesce("_hot", F.lit(False)) | near).drop("_hot", "_part", "_less", "_more")


#: The place of a block that has none or several.
ANY = (1 << 16) - 1


def linked(
    met: DataFrame | list[DataFrame], verified: Callable[[DataFrame], DataFrame], similarity: float, shared: int = 1, comps: DataFrame | None = None,
    facts: DataFrame | None = None, fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """Components ``(node, component)`` of all verified links between members that meet.

    ``met(v, key, size, need)``: ``meeting`` blocks; a pair is a candidate if it
    meets under ``need`` of them (of two members the lesser) and the smaller size
    is ``similarity`` of the larger or more. With a column ``pos`` members of a block meet only
    if their places (``ANY`` fits all) differ by no more than the edits that the similarity allows. ``verified`` cuts candidates ``(a, b)``
    down to links. ``comps``: components known before. ``facts(key, size, ...)`` with
    ``fits`` (of both members' columns) rejects pairs that cannot link before they
    are verified, mostly before they leave the block, so that members with a common
    part but little else in common never become pairs. ``met`` may come in parts, each with whole blocks:
    then one part at a time is dealt out and paired, and the numbers of blocks in common are added up.

    So that a large group never becomes all its pairs, members are first held
    against one chief of each block: the least key, or where components are known the
    member that meets others under the largest share of its blocks, as the
    original of many edited copies does. Then, within each block, those outside
    the component that dominates it are held against all of other components.
    """
    parts = met if isinstance(met, list) else [met]
    for whole in (False, True):
        if len(parts) > 1:
            counts = [stage(_met_pairs(part, similarity, shared, comps, facts, fits, whole, parts), "pairs") for part in parts]
            counted = reduce(DataFrame.unionByName, [part for part, _ in counts])
            counted = counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")) if shared > 1 else counted.distinct()
        else:
            counts, counted = [], _met_pairs(parts[0], similarity, shared, comps, facts, fits, whole, parts)
        counted = counted.where("n >= need").select("a", "b") if shared > 1 else counted.select("a", "b")
        if facts is not None and not whole:
            one, two = (facts.select(*[F.col(c).alias(x if c == "key" else f"{c}_{x}") for c in facts.columns]) for x in ("a", "b"))
            met_facts = counted.join(one, "a").join(two, "b").where(F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b") - 1e-9)
            counted = met_facts.where(fits(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))).select("a", "b")
        candidates, path = stage(counted, "candidates")
        drop(candidates.sparkSession, *(where for _, where in counts))
        links = verified(candidates)
        if comps is not None:
            links = links.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
        comps = connected_components(links)
        drop(candidates.sparkSession, path)
    return comps


def _met_pairs(met: DataFrame, similarity: float, shared: int, comps: DataFrame | None, facts: DataFrame | None, fits: Callable | None, whole: bool, parts: list[DataFrame]) -> DataFrame:
    """``(a, b, n, need)`` of members that ``linked`` holds against one another in blocks of ``met``: under how many they meet, and should; only ``(a, b)`` where one is enough."""
    if comps is None:
        named = met.withColumn("comp", F.col("key")).withColumn("members", F.lit(1).cast("bigint"))
        chief = F.min("key")
    else:
        heads = comps.groupBy("component").agg((F.count("*") + 1).alias("members"))
        member = comps.join(heads, "component").unionByName(heads.withColumn("node", F.col("component")))
        named = met.join(member, met["key"] == member["node"], "left").drop("node")
        named = named.withColumn("comp", F.coalesce("component", "key")).withColumn("members", F.coalesce("members", F.lit(1))).drop("component")
        weight = "members"
        if not whole:
            weight = "weight"
            every = reduce(DataFrame.unionByName, parts)
            named = named.join(every.groupBy("key").agg((F.count("*") / F.first("size")).alias("weight")), "key")
        chief = F.max_by("key", weight)
    also = [c for c in facts.columns if c not in ("key", "size")] if whole and facts is not None else []
    carried = also + (["pos"] if "pos" in met.columns else [])
    named = named.join(facts.drop("size"), "key") if also else named
    named = named.repartition("v")  # one exchange serves all that follows
    ruler = chief if comps is None else F.max_by("comp", weight)
    ruling = named.groupBy("v").agg(ruler.alias("ruler"), chief.alias("chief"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").drop("c0", "c1")
    outside = named.join(ruling, "v").where("comp <> ruler").select("v", "ruler", "chief", F.col("key").alias("a"), F.col("size").alias("na"), F.col("need").alias("da"), F.col("comp").alias("ca"), *[F.col(c).alias(f"{c}_a") for c in carried])
    if whole:
        inside = named.select("v", F.col("key").alias("b"), F.col("size").alias("nb"), F.col("need").alias("db"), F.col("comp").alias("cb"), *[F.col(c).alias(f"{c}_b") for c in carried])
        pairs = outside.join(inside, "v").where("ca <> cb AND (ca < cb OR cb = ruler)").where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9)
        if "pos" in carried:
            pairs = pairs.where((F.greatest("pos_a", "pos_b") == ANY) | (F.abs(F.col("pos_a") - F.col("pos_b")) <= F.lit(1 - similarity) * F.greatest("na", "nb") + 1e-9))
        if also:
            pairs = pairs.where(fits(lambda c: F.col("na" if c == "size" else f"{c}_a"), lambda c: F.col("nb" if c == "size" else f"{c}_b")))
        need = F.least("da", "db")
    else:
        pairs, need = outside.withColumn("b", F.col("chief")).where("a <> b"), F.col("da")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), need.alias("need"))
    if shared == 1:
        return pairs.select("a", "b").distinct()
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", parts: int = 8) -> DataFrame:
    """Join of ``rows``, of which many may share a key, with ``table``, which has each key once; a key's rows go to ``parts`` places."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    return dealt.join(table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*keys, "_part"], how).drop("_part")


#: Places of a bit map of keys; its size does not grow with the data.
_MAP = 1 << 24


def _marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_in``: false if ``key`` is surely not among ``ids(key)``, by a broadcast bit map of fixed size (2 MB)."""
    at = F.pmod(F.xxhash64(key), F.lit(_MAP))
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    mask = ids.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_mask"))  # at most _MAP / 64 rows
    some = rows.withColumn("_w", word).join(F.broadcast(mask), "_w", "left")
    return some.withColumn("_in", F.coalesce(F.col("_mask").bitwiseAND(bit) != 0, F.lit(False))).drop("_w", "_mask")


def maybe_in(rows: DataFrame, ids: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``ids(key)``, for an exact join to follow."""
    return _marked(rows, ids, key).where("_in").drop("_in")


def split_by(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be among ``ids(key)``, for an exact join, and the others, which need none."""
    marked = _marked(rows, ids, key)
    return marked.where("_in").drop("_in"), marked.where("NOT _in").drop("_in")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
