"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, line_dedup, packing, periodic_runs, quality, secret_scan, simhash, sql, token_counts, turn_repair, url_filter, window_packing


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file; present on every worker as part of its package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: (host, path, verdict); the path starts with a slash.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES, url_filter.default_labels(spark)).withColumnRenamed("id", "page_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.with_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    strong = F.filter("spans", lambda s: s["rank"] <= len(secret_scan.STRONG))
    counts = [F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == kind), False)).cast("long").alias(f"n_{kind}") for kind, *_ in secret_scan.STRONG]
    return rows.select("doc_id", *counts, F.sha2(secret_scan.joined(strong), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select(F.col("id").alias("doc_id"), F.expr("coalesce(crc32(cast(cast(id AS string) AS binary)) % 3 = 1, false)").alias("held_out"), "lang_pred", "score")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprints.edited_likeness(docs, fingerprints.rarity(docs), parts=parts).withColumnRenamed("id", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go and which (numbers from 0)."""
    done = line_dedup.deduplicated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.size("_removed").alias("n_removed"), F.array_join("_removed", ",").alias("removed"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenised_pieces(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), end_id=2))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    done = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), path, pattern()), path)
    return done.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def periodic(docs: DataFrame) -> DataFrame:
    """``documents`` whose id's checksum ends in 0 with words that repeat from some place on (see the contract of op11)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def edited(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        numbers = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"))
        word = lambda i, x: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))
        once = F.transform(F.array(numbers), lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: word(i, x)), " "))
        return F.when(n > 0, F.element_at(once, 1)).otherwise("")

    text = F.element_at(F.transform(F.array(words), edited), 1)  # the words are made once
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select(F.col("id").alias("doc_id"), "runs", "collapsed", F.when(F.size("runs") > 0, longest).alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), "best.period",
        F.floor(-F.col("best.l") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that the contract of op12 asks for; nulls become one space in the checksum, the roles and the texts."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = conversations.select("conv_id", "turn", F.when(what == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times", "_copy")


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = turn_repair.repair(damaged(conversations))
    written = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    done = done.select(F.col("conv_id").alias("_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(written, 256).alias("repaired_sha256"))
    every = conversations.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_langid": op6_langid,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_runs": op11_runs,
    "op12_turns": op12_turns,
    "op13_packing": op13_packing,
}
SQL: dict[str, str] = {"op12_turns": sql.OP12}
