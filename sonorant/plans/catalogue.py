"""The query catalogue: name to plan, and name to DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calls, dsp, numeric, text
from ..operators import clustering, density, dirichlet, heads, intervals, layouts, neighbours, relational, runs, sequences, smoothing, surfaces, vectors
from ..session import shared_place
from ..sources import audio
from ..streaming import events, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _epoch(ts: str = "ts") -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.frames(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")


F_SQL = "f AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


@query(f"""WITH {F_SQL}, a AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM f WHERE value > 34),
r AS (SELECT user_id, min(i) AS start_f, max(i) AS end_f FROM a GROUP BY user_id, g HAVING max(i) - min(i) + 1 >= 3)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_f) AS seg, start_f, end_f FROM r""")
def call_runs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(_frames(spark, sf_dir), "user_id", F.col("value") > 34, 3)


_HYSTERESIS = """, l AS (SELECT user_id, max(i) AS last_i FROM f GROUP BY user_id),
a AS (SELECT user_id, i, lag(i) OVER (PARTITION BY user_id ORDER BY i) AS p FROM f WHERE value > {t}),
n AS (SELECT user_id, i, sum(CASE WHEN p IS NULL OR i - p - 1 > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM a),
r AS (SELECT n.user_id, min(i) AS start_f, CASE WHEN last_i - max(i) <= {gap} THEN last_i ELSE max(i) END AS end_f FROM n JOIN l USING (user_id) GROUP BY n.user_id, g, last_i),
k AS (SELECT * FROM r WHERE end_f - start_f + 1 >= 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_f) AS seg, start_f, end_f,
  round(greatest(start_f - 3, 0) * 320 / 32000.0::DOUBLE, 2) AS onset, round((end_f + 3) * 320 / 32000.0::DOUBLE, 2) AS "offset" FROM k"""


@query(f"WITH {F_SQL}" + _HYSTERESIS.format(t=34, gap=2))
def call_runs_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_times(runs.runs(_frames(spark, sf_dir), "user_id", F.col("value") > 34, 2, max_gap=2, hold_open=True), pad=3)


@query(f"WITH {F_SQL}" + _HYSTERESIS.format(t=80, gap=1))
def call_runs_high_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_times(runs.runs(_frames(spark, sf_dir), "user_id", F.col("value") > 80, 2, max_gap=1, hold_open=True), pad=3)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", _epoch().alias("onset"), "value")
    return e.select("user_id", "onset", (F.col("onset") + 600 * F.col("value")).alias("offset"))


_COALESCE = """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS onset, epoch_us(ts) / 1e6 + 600 * value AS "offset" FROM events),
m AS (SELECT *, max("offset") OVER (PARTITION BY user_id ORDER BY onset, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR onset - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY onset, "offset" ROWS UNBOUNDED PRECEDING) AS g FROM m),
c AS (SELECT user_id, min(onset) AS onset, max("offset") AS "offset" FROM g GROUP BY user_id, g) """


@query(_COALESCE.format(gap=3600) + "SELECT user_id, round(onset, 2) AS onset, round(\"offset\", 2) AS \"offset\" FROM c")
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce(_intervals(spark, sf_dir), ["user_id"], 3600).select("user_id", F.round("onset", 2).alias("onset"), F.round("offset", 2).alias("offset"))


@query(_COALESCE.format(gap=600) + "SELECT user_id, round(onset, 2) AS onset, round(\"offset\", 2) AS \"offset\" FROM c")
def interval_coalesce_small_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce(_intervals(spark, sf_dir), ["user_id"], 600).select("user_id", F.round("onset", 2).alias("onset"), F.round("offset", 2).alias("offset"))


@query(_COALESCE.format(gap=3600) + """, x AS (SELECT unnest(generate_series(CAST(floor(onset / 3600) AS BIGINT), CAST(floor("offset" / 3600) AS BIGINT))) AS frame, user_id % 5 AS label FROM c)
SELECT frame, label, count(*) AS n FROM x GROUP BY frame, label""")
def interval_frame_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = intervals.coalesce(_intervals(spark, sf_dir), ["user_id"], 3600).withColumn("label", F.col("user_id") % 5)
    return intervals.frame_overlap(c, 3600, "label").groupBy("frame", "label").agg(F.count("*").alias("n"))


@query("""SELECT a.user_id, a.event_id AS ref_id, b.event_id AS sys_id FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'click' AND b.event_type = 'view' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 <= 21600""")
def event_match_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", _epoch().alias("t"))
    ref = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("ref_id"), F.col("t").alias("t_ref"))
    sys = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("sys_id"), F.col("t").alias("t_sys"))
    return intervals.band_join(ref, sys, "user_id", "t_ref", "t_sys", 21600.0).select("user_id", "ref_id", "sys_id")


@query()  # a largest matching; held against brute force in the tests
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("filename"), "event_type", _epoch().alias("onset"), "value")
    e = e.withColumn("offset", F.col("onset") + 600 * F.col("value"))
    return intervals.event_metrics(e.where("event_type = 'click'"), e.where("event_type = 'view'"), collar=21600.0)


def _hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs.frames(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
    return e.select("user_id", (F.col("user_id") % 5).alias("species"), F.col("i").alias("t"), F.col("event_type").alias("state"), F.lit(1.0).alias("p"))


_STEPS = f"""WITH {F_SQL}, s AS (SELECT user_id, user_id % 5 AS species, i + 1 AS t, event_type AS state FROM f
UNION ALL SELECT DISTINCT user_id, user_id % 5, 0, 'START' FROM events UNION ALL SELECT user_id, user_id % 5, count(*) + 1, 'END' FROM events GROUP BY user_id),
c AS (SELECT a.species, a.state AS src, b.state AS dst, count(*) AS w FROM s a JOIN s b ON a.user_id = b.user_id AND b.t = a.t + 1 GROUP BY 1, 2, 3) """


@query(_STEPS + "SELECT src, dst, round(sum(w) / sum(sum(w)) OVER (PARTITION BY src), 9) AS prob FROM c GROUP BY src, dst")
def markov1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.markov1(_hard(spark, sf_dir), "user_id").select("src", "dst", F.round("prob", 9).alias("prob"))


@query(_STEPS + """SELECT species, src, dst, round(w / sum(w) OVER (PARTITION BY species, src), 9) AS prob FROM c
UNION ALL SELECT CAST(NULL AS BIGINT), src, dst, round(sum(w) / sum(sum(w)) OVER (PARTITION BY src), 9) FROM c GROUP BY src, dst""")
def markov1_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.markov1_rollup(_hard(spark, sf_dir), "user_id", "species").select("species", "src", "dst", F.round("prob", 9).alias("prob"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, sum(value) AS v FROM events GROUP BY 1, 2, 3),
q AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY d) AS t, event_type AS state, v / sum(v) OVER (PARTITION BY user_id, d) AS p FROM d WHERE v > 0),
s AS (SELECT * FROM q UNION ALL SELECT DISTINCT user_id, 0, 'START', 1.0 FROM q UNION ALL SELECT user_id, max(t) + 1, 'END', 1.0 FROM q GROUP BY user_id),
c AS (SELECT a.state AS src, b.state AS dst, sum(a.p * b.p) AS w FROM s a JOIN s b ON a.user_id = b.user_id AND b.t = a.t + 1 GROUP BY 1, 2)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS prob FROM c""")
def markov1_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("t"), F.col("event_type").alias("state")).agg(F.sum("value").alias("v")).where("v > 0")
    soft = d.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("user_id", "t")))
    return sequences.markov1(soft, "user_id").select("src", "dst", F.round("prob", 9).alias("prob"))


@query(_STEPS + """, x AS (SELECT a.state AS s0, b.state AS s1, d.state AS s2, count(*) AS w FROM s a JOIN s b ON a.user_id = b.user_id AND b.t = a.t + 1 JOIN s d ON a.user_id = d.user_id AND d.t = a.t + 2 GROUP BY 1, 2, 3)
SELECT s0, s1, s2, round(w / sum(w) OVER (PARTITION BY s0, s1), 9) AS prob FROM x""")
def markov2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.markov2(_hard(spark, sf_dir), "user_id").withColumn("prob", F.round("prob", 9))


@query("""WITH n AS (SELECT log2(count(*)) AS x FROM conversations GROUP BY conv_id),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM n)
SELECT round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, round(min(x), 9) AS low, round(max(x), 9) AS high FROM n, q
WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY q1, median, q3""")
def sequence_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = sequences.length_quantiles(_read(spark, sf_dir, "conversations"), "conv_id")
    return q.select(*[F.round(c, 9).alias(c) for c in q.columns])


@query("SELECT role, turn, round(count(*) / sum(count(*)) OVER (PARTITION BY role), 9) AS prob FROM conversations GROUP BY role, turn")
def call_index_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.position_histogram(_read(spark, sf_dir, "conversations"), "role", "turn").withColumn("prob", F.round("prob", 9))


@query("""WITH n AS (SELECT source || '_' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || '_' || CAST(n_chars % 20 AS VARCHAR) || '.wav' AS f FROM documents)
SELECT f AS filename, split_part(f, '_', 1) AS species, split_part(f, '_', 1) || '_' || split_part(f, '_', 2) AS seq,
CAST(replace(split_part(f, '_', 3), '.wav', '') AS INT) AS idx, regexp_replace(f, '_[0-9]+\\.wav$', '.wav') AS base, regexp_extract(f, '_([0-9]{5})_', 1) AS gid FROM n""")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.concat_ws("", F.col("source"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("_"), (F.col("n_chars") % 20).cast("string"), F.lit(".wav")).alias("filename"))
    f = F.col("filename")
    return d.select("filename", text.species(f).alias("species"), text.group_id(f).alias("seq"), text.call_index(f).alias("idx"), text.base_name(f).alias("base"), text.five_digits(f).alias("gid"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars % 2) AS label FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).alias("label"))
    return relational.override(base, _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label")), "doc_id", ["label"])


@query("SELECT doc_id, quality, toxic, source FROM labels JOIN documents USING (doc_id) WHERE quality = 1 OR toxic = 1")
def label_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").where("quality = 1 OR toxic = 1").join(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query("""WITH x AS (SELECT vec_id, embedding[1:10] AS e FROM embeddings) SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INT) AS argmax, list_position(e, list_max(e)) - 1 = 6 AS flag FROM x""")
def pseudo_label_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vectors.argmax(F.slice("embedding", 1, 10))
    return _read(spark, sf_dir, "embeddings").select("vec_id", a.alias("argmax"), (a == 6).alias("flag"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.not_in(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 5 = 0 AND q.page_id <> p.page_id AND starts_with(p.url, regexp_extract(q.url, '^[a-z]+://[^/]+/[a-z]+/', 0)) AND regexp_extract(q.url, '^[a-z]+://[^/]+/[a-z]+/', 0) <> '' AND p.page_id % 5 <> 0) AND p.page_id % 5 <> 0""")
def prefix_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select("page_id", "url")
    done = p.where("page_id % 5 = 0").select(F.regexp_extract("url", r"^[a-z]+://[^/]+/[a-z]+/", 0).alias("prefix")).where("prefix <> ''").distinct()
    return relational.without_prefix(p.where("page_id % 5 <> 0"), "url", done, "prefix").select("page_id")


@query("SELECT n_chars, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_by_priority(_read(spark, sf_dir, "documents").select("n_chars", "doc_id", "source"), "n_chars", "source", "doc_id")


@query("""WITH u AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), g AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer WHERE c_acctbal <= 0),
h AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM generate_series(0, (SELECT max(c_custkey) FROM customer)) t(i) WHERE i NOT IN (SELECT k FROM u)) SELECT c_custkey, i AS new_id FROM g JOIN h USING (r)""")
def free_id_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    top = c.agg(F.max("c_custkey")).first()[0]
    free = relational.not_in(spark.range(0, (top if top is not None else -1) + 1).withColumnRenamed("id", "new_id"), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("new_id")), "new_id")
    groups = relational.ranked(c.where("c_acctbal <= 0").select("c_custkey"), F.col("c_custkey"))
    return groups.join(relational.ranked(free, F.col("new_id")), "n").select("c_custkey", "new_id")


@query("SELECT s_suppkey, 'call_' || lpad(CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) + 100 AS VARCHAR), 5, '0') || '.wav' AS new_name FROM supplier")
def seq_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relational.ranked(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal"), F.col("s_suppkey"), start=101)
    return s.select("s_suppkey", F.concat(F.lit("call_"), F.lpad(F.col("n").cast("string"), 5, "0"), F.lit(".wav")).alias("new_name"))


@query("SELECT event_type, max(value) AS top FROM events GROUP BY event_type ORDER BY top DESC, event_type LIMIT 3")
def topk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("top")).orderBy(F.desc("top"), "event_type").limit(3)


def _vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_CENT = f"""{_VEC}, p AS (SELECT label, i, avg(e[i]) AS m FROM v, generate_series(1, 64) t(i) GROUP BY label, i), c AS (SELECT label AS c, list(m ORDER BY i) AS m FROM p GROUP BY label),
s AS (SELECT vec_id, label, c, list_dot_product(e, m) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(m, m)) AS sim FROM v, c)"""


@query("SELECT vec_id, label, 'a' AS species FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, NULL, 'b' FROM embeddings WHERE label >= 5")
def union_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    a, b = e.where("label < 5").withColumn("species", F.lit("a")), e.where("label >= 5").drop("label").withColumn("species", F.lit("b"))
    return a.unionByName(b, allowMissingColumns=True)


_LONG = "SELECT vec_id, i, round(x[i], 6) AS x FROM y, generate_series(1, 64) t(i)"


def _cells(df: DataFrame, features: str = "features") -> DataFrame:
    """``(vec_id, i, x)`` of every coordinate, from 1."""
    return df.select("vec_id", F.posexplode(features).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {_VEC}, y AS (SELECT a.vec_id, list_concat(a.e[1:8], b.e[9:64]) AS x FROM v a JOIN v b USING (vec_id)) {_LONG}")
def hconcat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vec(spark, sf_dir)
    a, b = e.select("vec_id", F.slice("features", 1, 8).alias("a")), e.select("vec_id", F.slice("features", 9, 56).alias("b"))
    return _cells(a.join(b, "vec_id").select("vec_id", F.concat("a", "b").alias("features")))


@query(f"WITH {_VEC}, m AS (SELECT i, avg(e[i]) AS m, stddev_pop(e[i]) AS s FROM v, generate_series(1, 64) t(i) GROUP BY i) SELECT vec_id, i, round((e[i] - m) / s, 6) AS x FROM v, m")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(vectors.standardised(_vec(spark, sf_dir), "features"))


@query(f"WITH {_VEC} SELECT vec_id, i, round(e[i] / sqrt(list_dot_product(e, e)), 6) AS x FROM v, generate_series(1, 64) t(i)")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_vec(spark, sf_dir).withColumn("features", vectors.l2_normalised(F.col("features"))))


_Z = f"{_VEC}, m AS (SELECT i, avg(e[i]) AS m, stddev_pop(e[i]) AS s FROM v, generate_series(1, 64) t(i) GROUP BY i), z AS (SELECT vec_id, i, (e[i] - m) / s AS x FROM v, m)"


@query(f"WITH {_Z} SELECT vec_id, i, round(x, 6) AS x FROM z WHERE i <= 32 UNION ALL SELECT vec_id, i, round(x, 6) FROM z WHERE i > 32")
def super_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vec(spark, sf_dir)
    a, b = e.select("vec_id", F.slice("features", 1, 32).alias("features")), e.select("vec_id", F.slice("features", 33, 32).alias("features"))
    return _cells(vectors.super_embedding(a, b, "vec_id", "features"))


@query(f"""WITH {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM v), p AS (SELECT label, i, avg(e[i]) AS m FROM r, generate_series(1, 64) t(i) WHERE r <= 20 GROUP BY label, i),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM p GROUP BY label) SELECT label, i, round(m / n, 6) AS x FROM p JOIN n USING (label)""")
def limited_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.limited_centres(_vec(spark, sf_dir), "label", "features", 20, "vec_id").select("label", F.posexplode("centroid").alias("i", "x"))
    return c.select("label", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {_CENT} SELECT c AS label, i, round(m[i], 6) AS x FROM c, generate_series(1, 64) t(i)")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroids(_vec(spark, sf_dir), "label", "features").select("label", F.posexplode("centroid").alias("i", "x"))
    return c.select("label", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


def _sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vec(spark, sf_dir)
    return vectors.similarities(v, vectors.centroids(v, "label", "features"), "features", "label")


@query(f"WITH {_CENT} SELECT vec_id, arg_max(c, sim) AS cluster, round(max(sim), 6) AS sim FROM s GROUP BY vec_id")
def cosine_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _sims(spark, sf_dir).withColumn("best", vectors.nearest(F.col("sims")))
    return best.select("vec_id", F.col("best.label").alias("cluster"), F.round("best.sim", 6).alias("sim"))


@query(f"WITH {_CENT} SELECT vec_id, c AS cluster, round(sim, 6) AS sim FROM s")
def sim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sims(spark, sf_dir).select("vec_id", F.inline("sims")).select("vec_id", F.col("label").alias("cluster"), F.round("sim", 6).alias("sim"))


@query(f"""WITH {_CENT}, o AS (SELECT label AS cluster, vec_id, sim, max(sim) OVER (PARTITION BY label) AS best FROM s WHERE label = c),
r AS (SELECT cluster, vec_id, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) AS r FROM o WHERE sim >= 0.95 * best) SELECT cluster, vec_id FROM r WHERE r <= 10""")
def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _sims(spark, sf_dir).select("vec_id", F.col("label").alias("cluster"), F.inline("sims")).where("label = cluster").select("cluster", "vec_id", "sim")
    return relational.relative_top(own, "cluster", "sim", 0.95, 10, F.col("vec_id")).select("cluster", "vec_id")


@query(f"WITH {_CENT} SELECT a.c AS i, b.c AS j, round(1 - list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m)) / sqrt(list_dot_product(b.m, b.m)), 6) AS dist FROM c a JOIN c b ON a.c < b.c WHERE 1 - list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m)) / sqrt(list_dot_product(b.m, b.m)) < 0.9")
def centroid_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroids(_vec(spark, sf_dir), "label", "features").select(F.col("label").alias("i"), vectors.l2_normalised(F.col("centroid")).alias("a"))
    pairs = c.join(c.select(F.col("i").alias("j"), F.col("a").alias("b")), F.col("i") < F.col("j"))  # leaf centres, a few
    return pairs.withColumn("dist", 1 - vectors.dot(F.col("a"), F.col("b"))).where("dist < 0.9").select("i", "j", F.round("dist", 6).alias("dist"))


@query(f"""WITH {_VEC}, d AS (SELECT a.vec_id, a.label, b.label AS o, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
x AS (SELECT vec_id, sum(CASE WHEN o = label THEN s END) / (sum(CASE WHEN o = label THEN n END) - 1) AS a, min(CASE WHEN o <> label THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM x""")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.silhouette(_vec(spark, sf_dir), "vec_id", "features", "label").select(F.round("silhouette", 6).alias("silhouette"))


@query("WITH n AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), w AS (SELECT event_type, sum(c) OVER () / (count(*) OVER () * c) AS w FROM n) SELECT event_type, round(w / sum(w) OVER () * count(*) OVER (), 9) AS weight FROM w")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.class_weights(_read(spark, sf_dir, "events"), "event_type").withColumn("weight", F.round("weight", 9))


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 9) AS overall, round(avg(CASE WHEN toxic = 0 THEN CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END END), 9) AS class0 FROM labels WHERE toxic IS NOT NULL")
def frame_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = relational.masked_accuracy(_read(spark, sf_dir, "labels"), "quality", "toxic")
    return a.select(F.round("overall", 9).alias("overall"), F.round("class0", 9).alias("class0"))


@query(f"WITH {F_SQL} SELECT user_id, i, round(sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS smooth FROM f")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.moving_average(_frames(spark, sf_dir), "user_id", "value").select("user_id", "i", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {F_SQL}, w AS (SELECT user_id, i, list_sort([coalesce(lag(value, 2) OVER w, 0), coalesce(lag(value, 1) OVER w, 0), value, coalesce(lead(value, 1) OVER w, 0), coalesce(lead(value, 2) OVER w, 0)]) AS l FROM f WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, l[3] AS median FROM w""")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.running_median(_frames(spark, sf_dir), "user_id", "value").select("user_id", "i", "median")


@query(f"WITH {F_SQL} SELECT user_id, i, round(CASE WHEN max(value) OVER (PARTITION BY user_id) > 0 THEN value / max(value) OVER (PARTITION BY user_id) ELSE value END, 6) AS norm FROM f")
def norm_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.normalised(_frames(spark, sf_dir), "user_id", "value").select("user_id", "i", F.round("norm", 6).alias("norm"))


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.local_peaks(smoothing.normalised(_frames(spark, sf_dir), "user_id", "value"), "user_id", "norm")


@query(f"""WITH {F_SQL}, n AS (SELECT user_id, i, CASE WHEN max(value) OVER (PARTITION BY user_id) > 0 THEN value / max(value) OVER (PARTITION BY user_id) ELSE value END AS x FROM f),
m AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY user_id ORDER BY i) = x THEN 0 ELSE 1 END AS n FROM n), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS run FROM m),
p AS (SELECT user_id, min(i) AS a, max(i) AS b, min(x) AS x FROM r GROUP BY user_id, run), q AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY a) AS l, lead(x) OVER (PARTITION BY user_id ORDER BY a) AS h FROM p)
SELECT user_id, CAST((a + b) // 2 AS INT) AS i, round(x, 6) AS norm FROM q WHERE x > l AND x > h AND x >= 0.3""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir).withColumn("norm", F.round("norm", 6))


@query()
def peak_count_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.distant_peaks(_peaks(spark, sf_dir), "user_id", "norm").groupBy("user_id").agg(F.count("*").alias("n"))


def _windows(spark: SparkSession, sf_dir: str, tail: str) -> DataFrame:
    w = vectors.windows(F.col("features"), 24, 12, tail)
    return _vec(spark, sf_dir).select("vec_id", F.posexplode(w).alias("w", "x")).select("vec_id", "w", F.round(vectors.mean(F.col("x")), 6).alias("mean"))


@query(f"WITH {_VEC} SELECT vec_id, w, round(list_avg(e[12 * w + 1 : 12 * w + 24]), 6) AS mean FROM v, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS w)")
def array_windows_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "drop")


@query(f"WITH {_VEC} SELECT vec_id, w, round(list_avg(CASE WHEN w = 4 THEN e[41:64] ELSE e[12 * w + 1 : 12 * w + 24] END), 6) AS mean FROM v, (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS w)")
def array_windows_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "anchor")


@query("""WITH b AS (SELECT l_linenumber AS k, avg(l_extendedprice) + 9 * stddev_pop(l_discount) AS bic FROM lineitem GROUP BY 1), s AS (SELECT min(bic) AS m, stddev_pop(bic) AS d FROM b)
SELECT thr, CAST(min(k) AS INT) AS k, count(*) AS n FROM b, s, (SELECT unnest([CAST(0.5 AS DOUBLE), 1.0]) AS thr) WHERE bic <= m + thr * d GROUP BY thr""")
def bic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg((F.avg("l_extendedprice") + 9 * F.stddev_pop("l_discount")).alias("bic"))
    return clustering.select_k(scan, [0.5, 1.0])


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source")
def dir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(_vec(spark, sf_dir), "features", 10).select("vec_id", "cluster", "probs")


@query()
def gmm_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.gmm(clustering.pca(_vec(spark, sf_dir), "features", 5), "features", 5).select("vec_id", "probs")


@query()
def pca2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.pca(_vec(spark, sf_dir), "features", 2).select("vec_id", F.col("features").alias("pc"))


@query()
def bic_scan_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = clustering.pca(_vec(spark, sf_dir), "features", 60)
    return clustering.bic_scan(x, "features", range(2, 31), "diag")


@query()
def bic_scan_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors.standardised(clustering.pca(_vec(spark, sf_dir), "features", 12), "features")
    return clustering.bic_scan(x, "features", range(2, 101), "tied")


@query()
def bic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIC of diagonal mixtures of 2 to 100 components on standardised features, and the thresholds each keeps."""
    x = vectors.standardised(_vec(spark, sf_dir), "features")
    return clustering.within(clustering.bic_scan(x, "features", range(2, 101), "diag"), [0.5, 1.0])


@query()
def bic_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors.standardised(clustering.pca(_vec(spark, sf_dir), "features", 12), "features")
    return clustering.choose_and_refit(x, "features", range(2, 101), "tied", [0.5, 1.0]).select("thr", "k", "vec_id", "cluster", "probs")


@query()
def dirichlet_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and shares of a Dirichlet-process mixture of at most 20 components on standardised components."""
    x = vectors.standardised(clustering.pca(_vec(spark, sf_dir), "features", 8), "features").persist()
    return dirichlet.assigned(x, "features", dirichlet.fit(x, "features", 20)).select("vec_id", "cluster", "probs")


@query()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of standardised components: -1 is noise."""
    x = vectors.standardised(clustering.pca(_vec(spark, sf_dir), "features", 8), "features")
    done = density.hdbscan(x, "vec_id", "features", least=20, samples=10)
    return done.select(F.col("id").alias("vec_id"), "cluster", "probability", "members")


@query()
def fuzzy_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional layout that keeps the fuzzy neighbourhoods of the features."""
    v = _vec(spark, sf_dir)
    near = neighbours.descent(v, "vec_id", "features", 15)
    return layouts.umap(v, "vec_id", "features", near).select(F.col("id").alias("vec_id"), "x", "y")


@query()
def stochastic_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional layout that keeps the chances of being neighbours, perplexity 20."""
    v = _vec(spark, sf_dir)
    near = neighbours.descent(v, "vec_id", "features", 60, rounds=2)
    return layouts.tsne(v, "vec_id", "features", near, perplexity=20.0).select(F.col("id").alias("vec_id"), "x", "y")


@query(f"""WITH {_VEC}, d AS (SELECT a.vec_id, b.vec_id AS j, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, j) AS rank FROM d)
SELECT vec_id, CAST(rank AS INT) AS rank, j, round(d, 6) AS d FROM r WHERE rank <= 10""")
def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vec(spark, sf_dir)
    found = neighbours.nearest(v, "vec_id", "features", 10, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")))
    return found.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("rank", "n")).select("vec_id", (F.col("rank") + 1).alias("rank"), "n.j", F.round("n.d", 6).alias("d"))


@query()
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest neighbours of the rows whose id is divisible by 50, and how many of them neighbour descent over all rows finds."""
    v = _vec(spark, sf_dir)
    cells = neighbours.Cells(v, "vec_id", "features")
    exact = neighbours.nearest(v, "vec_id", "features", 10, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")), cells)
    found = neighbours.descent(v, "vec_id", "features", 10, cells=cells).select("id", F.transform("near", lambda p: p["j"]).alias("found"))
    js = F.transform("near", lambda p: p["j"])
    return exact.join(found, "id").select(F.col("id").alias("vec_id"), js.alias("neighbours"), F.size(F.array_intersect(js, F.col("found"))).alias("hits"))


@query()
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vec(spark, sf_dir).select("vec_id", *[F.get("features", i).alias(f"h{i + 1}") for i in range(12)])
    return clustering.top_components(e, [f"h{i + 1}" for i in range(12)], "harmonic_pc").select("vec_id", "harmonic_pc1", "harmonic_pc2", "harmonic_pc3")


@query()
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.explained_variance(_vec(spark, sf_dir), "features", 10)


@query()
def size_bounded_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vec(spark, sf_dir).withColumn("features", vectors.l2_normalised(F.col("features")))
    return clustering.bounded_leaves(v, "features", max(v.count() // 6, 1)).select("vec_id", "leaf")


@query()
def subcluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = clustering.gmm(clustering.pca(_vec(spark, sf_dir), "features", 5), "features", 4).withColumn("repeats", (F.col("vec_id") % 7 + 1).cast("double"))
    return clustering.subclusters(v, "vec_id", "probs", "repeats")


# projections, filters, orders and sets


@query("SELECT c_custkey AS key, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def prefix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key").withColumn("other", F.lit(1))
    return relational.by_prefix(c, "c_", "key")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def label_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'brass') OR contains(lower(p_type), 'plated') OR contains(lower(p_type), 'promo')")
def label_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").where(text.contains_any(F.lower("p_type"), ["brass", "plated", "promo"])).select("p_partkey", "p_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') OR event_type IS NULL GROUP BY 1")
def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unknown_labels(_read(spark, sf_dir, "events").select("event_type"), "event_type", ["click", "view"])


@query(_STEPS + """, w AS (SELECT src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS p FROM c GROUP BY src, dst), d AS (SELECT DISTINCT event_type AS dst FROM events)
SELECT s.src, d.dst, round(coalesce(w.p, 0), 9) AS prob FROM (SELECT DISTINCT src FROM w WHERE src <> 'START') s CROSS JOIN d LEFT JOIN w ON w.src = s.src AND w.dst = d.dst""")
def matrix_without_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = relational.without_ends(audio.matrix(sequences.markov1(_hard(spark, sf_dir), "user_id")), "src")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("dst"), F.round(F.col(c), 9).alias("prob")) for c in wide.columns if c != "src"])).alias("x")
    return wide.select("src", cells).select("src", "x.dst", "x.prob")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 10)")
def large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.large_groups(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


@query("""WITH n AS (SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_' || lpad(CAST(doc_id AS VARCHAR), 5, '0') END || CASE WHEN doc_id % 7 = 0 THEN '_x' ELSE '_' || CAST(n_chars % 20 AS VARCHAR) END || '.wav' AS f FROM documents)
SELECT doc_id, split_part(f, '_', 1) AS species, split_part(f, '_', 2) AS seq, CAST(replace(split_part(f, '_', 3), '.wav', '') AS INT) AS idx FROM n WHERE regexp_full_match(f, '[^_]*_[^_]*_[0-9]+\\.wav')""")
def strict_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    seq = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    idx = F.when(F.col("doc_id") % 7 == 0, "_x").otherwise(F.concat(F.lit("_"), (F.col("n_chars") % 20).cast("string")))
    parts = d.select("doc_id", text.strict_parts(F.concat("source", seq, idx, F.lit(".wav"))).alias("p")).where("p IS NOT NULL")
    return parts.select("doc_id", "p.species", "p.seq", "p.idx")


@query("SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS n FROM events")
def sorted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ranked(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), F.col("user_id"), F.col("ts"), F.col("event_id")).select("user_id", "event_id", "n")


@query("SELECT page_id, row_number() OVER (ORDER BY CAST(page_id AS VARCHAR)) AS n FROM pages")
def lexicographic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ranked(_read(spark, sf_dir, "pages").select("page_id"), F.col("page_id").cast("string"), F.col("page_id")).select("page_id", "n")


@query("""WITH t AS (SELECT doc_id, CASE WHEN quality = 1 OR toxic = 1 THEN 5.0 ELSE 1.0 END AS w FROM labels), f AS (SELECT count(*) * 5.0 / sum(w) AS f FROM t),
c AS (SELECT doc_id, CAST(floor(w * f + CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0) AS INT) AS n FROM t, f)
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(generate_series(1, n)) FROM c WHERE n > 0) GROUP BY doc_id""")
def weighted_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 1) | (F.col("toxic") == 1), 5.0).otherwise(1.0).alias("w"))
    return relational.resampled(rows, "doc_id", "w", 5.0).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, r <= floor(0.8 * n) AS train FROM r""")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.split_exactly(_read(spark, sf_dir, "documents").select("doc_id"), 0.8, F.col("doc_id"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('7:' || CAST(l_linenumber AS VARCHAR)), l_linenumber) AS r FROM lineitem WHERE l_quantity >= 20)
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS k FROM t WHERE l_quantity >= 0.95 * best) WHERE k <= 2""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").where("l_quantity >= 20").select("l_orderkey", "l_linenumber", "l_quantity")
    return relational.relative_top(rows, "l_orderkey", "l_quantity", 0.95, 2, F.md5(F.concat(F.lit("7:"), F.col("l_linenumber").cast("string"))), F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, CAST(quality AS BIGINT) AS v FROM labels UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def later_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = _read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v"))
    return relational.later_wins(older, _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("v")), "doc_id")


@query("SELECT n_nationkey, count(s_suppkey) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def place_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "supplier").where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "n_nationkey")
    t = relational.totals(_read(spark, sf_dir, "nation"), files, "n_nationkey", "s_acctbal")
    return t.select("n_nationkey", "n", F.round("total", 2).alias("total"))


@query("""WITH n AS (SELECT k, count(event_id) AS c FROM (SELECT unnest(['click', 'view', 'never']) AS k) LEFT JOIN events ON event_type = k GROUP BY k), w AS (SELECT k, sum(c) OVER () / (count(*) OVER () * greatest(CAST(c AS DOUBLE), 1e-6)) AS w FROM n) SELECT k AS event_type, round(w / sum(w) OVER () * count(*) OVER (), 9) AS weight FROM w""")
def class_weights_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.range(1).select(F.explode(F.array(*map(F.lit, ["click", "view", "never"]))).alias("event_type"))
    e = _read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return relational.class_weights(e, "event_type", classes).withColumn("weight", F.round("weight", 9))


@query("SELECT DISTINCT p.url AS source, 'best/' || l.label || '/' || CAST(l.vec_id AS VARCHAR) || '.wav' AS target FROM embeddings l JOIN pages p ON p.page_id = l.vec_id")
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    files = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("vec_id"), F.col("url").alias("path"))
    return relational.copy_plan(rows, files, "vec_id", F.concat(F.lit("best/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".wav")))


@query("""WITH f AS (SELECT 'in/' || source || '/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.mp3' ELSE '.FLAC' END AS path, doc_id FROM documents)
SELECT path AS source, regexp_replace(path, '\\.[^./]*$', '') || '.wav' AS target FROM f WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0""")
def conversion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("doc_id") % 3 == 0, ".wav").when(F.col("doc_id") % 3 == 1, ".mp3").otherwise(".FLAC")
    stem = F.concat(F.lit("in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    d = _read(spark, sf_dir, "documents")
    return relational.conversion_plan(d.select(F.concat(stem, ending).alias("path")), d.where("doc_id % 5 = 0").select(F.concat(stem, F.lit(".wav")).alias("path")))


# scalar functions


@query("""SELECT l_orderkey, l_linenumber, round(ln(abs(l_discount - 0.05) + 1e-12), 9) AS log, round(sign(l_discount - 0.05) * pow(abs(l_discount - 0.05) + 1e-12, 0.5), 9) AS power,
l_linenumber * 320 / 32000.0::DOUBLE AS seconds, CAST(floor(l_quantity * 32000 / 320) AS BIGINT) AS frame, round(1127 * ln(1 + l_extendedprice / 700), 6) AS mel,
CAST(floor((least(greatest(l_quantity / 10 - 2, -2), 2) + 2) * 63.75) AS SMALLINT) AS quant, round(1 / (1 + exp(-l_discount)), 9) AS sig, round((l_quantity + 4.2677393) / 4.5689974, 9) AS z FROM lineitem""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount") - 0.05
    return _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numeric.safe_log(d), 9).alias("log"), F.round(numeric.signed_power(d), 9).alias("power"),
        numeric.frame_to_seconds(F.col("l_linenumber")).alias("seconds"), numeric.seconds_to_frame(F.col("l_quantity")).alias("frame"), F.round(numeric.hertz_to_mel(F.col("l_extendedprice")), 6).alias("mel"),
        numeric.quantised(F.col("l_quantity") / 10 - 2).alias("quant"), F.round(numeric.sigmoid(F.col("l_discount")), 9).alias("sig"), F.round(numeric.z_constant(F.col("l_quantity")), 9).alias("z"),
    )


@query(f"""WITH {_VEC}, x AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi, list_sum(list_transform(e, lambda x: exp(x))) AS t FROM v)
SELECT vec_id, i, CAST(floor((e[i] - lo) / (hi - lo) * 255) AS SMALLINT) AS u8, round(exp(e[i]) / t, 9) AS soft, e[i] > 0 AS fires, CAST(list_position(e, hi) AS INT) AS cls FROM x, generate_series(1, 64) t(i)""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("features")
    x = _vec(spark, sf_dir).select("vec_id", numeric.head_class(f).alias("cls"), F.array_min(f).alias("lo"), F.array_max(f).alias("hi"), F.posexplode(F.arrays_zip(f.alias("f"), numeric.softmax(f).alias("s"), numeric.head_labels(f).alias("h"))).alias("i", "x"))
    return x.select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), numeric.to_uint8(F.col("x.f"), F.col("lo"), F.col("hi")).alias("u8"), F.round("x.s", 9).alias("soft"), F.col("x.h").alias("fires"), "cls")


@query("""SELECT page_id, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(url, '(\\.[^./]*)$', 1)) AS ext, 'call_' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS num,
upper(url[1:1]) || lower(url[2:]) AS cap, replace(url, 'https', 'http') AS plain, page_id % 3 = 0 AS flag FROM pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    dirty = F.when(F.col("page_id") % 3 == 0, " True ").otherwise("false")
    return _read(spark, sf_dir, "pages").select(
        "page_id", text.stem(u).alias("stem"), text.extension(u).alias("ext"), text.numbered("call_", F.col("page_id")).alias("num"),
        text.capitalised(u).alias("cap"), F.replace(u, F.lit("https"), F.lit("http")).alias("plain"), relational.dirty_bool(dirty).alias("flag"),
    )


# windows, labels, losses


@query(f"""WITH {F_SQL}, l AS (SELECT user_id, max(i) AS last_i FROM f GROUP BY user_id), a AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM f WHERE value < 30),
q AS (SELECT user_id, min(i) AS s, max(i) AS e FROM a GROUP BY user_id, g HAVING count(*) >= 3 UNION ALL SELECT user_id, last_i + 1, last_i + 1 FROM l),
p AS (SELECT user_id, s, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s) + 1, 0) AS b FROM q)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s) AS seg, greatest(b - 1, 0) AS start_f, least(s, last_i) AS end_f FROM p JOIN l USING (user_id) WHERE s > b""")
def silence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.split_at_silence(_frames(spark, sf_dir), "user_id", F.col("value") < 30, 3, 1)


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS onset, epoch_us(ts) / 1e6 + 600 * value AS "offset" FROM events), lo AS (SELECT user_id, floor(min(onset) / 7200) * 7200 AS lo, max(onset) AS hi FROM e GROUP BY user_id),
c AS (SELECT user_id, lo + 7200 * unnest(generate_series(0, CAST(floor((hi - lo) / 7200) AS BIGINT))) AS start FROM lo), x AS (SELECT user_id, start, f, start + f * 600 AS t FROM c, generate_series(0, 11) g(f))
SELECT x.user_id, start, CAST(f AS INT) AS f, CAST(bool_or(e.onset IS NOT NULL) AS INT) AS label FROM x LEFT JOIN e ON e.user_id = x.user_id AND e.onset <= x.t AND e."offset" >= x.t GROUP BY 1, 2, 3""")
def clip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _intervals(spark, sf_dir)
    span = e.groupBy("user_id").agg((F.floor(F.min("onset") / 7200) * 7200).cast("double").alias("lo"), F.max("onset").alias("hi"))
    clips = span.select("user_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 7200).cast("int"))).alias("k"), "lo").select("user_id", (F.col("lo") + 7200 * F.col("k")).alias("start"))
    out = intervals.clip_labels(e, clips, ["user_id"], frames=12, hop=600.0)
    return out.select("user_id", "start", F.posexplode("labels").alias("f", "label"))


@query(f"""WITH {_VEC}, w AS (SELECT vec_id, label, w, e[12 * w + 1 : 12 * w + 24] AS x FROM v, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS w))
SELECT vec_id, w, round(list_sum(x), 6) AS total, label < 3 AS flag, CASE WHEN label < 3 THEN 5.0 ELSE 1.0 END AS weight FROM w""")
def window_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vec(spark, sf_dir).withColumn("labels", F.array(*[(F.col("label") == i).cast("double") for i in range(3)]))
    d = vectors.window_dataset(v, "vec_id", "labels", "features", 24, 12)
    return d.select("vec_id", "w", F.round(vectors.mean(F.col("x")) * 24, 6).alias("total"), "flag", "weight")


@query(f"""WITH {_VEC}, x AS (SELECT vec_id, i, e[i] AS z, CASE WHEN vec_id % 7 = i % 7 THEN NULL WHEN label = i % 10 THEN 1.0 ELSE 0.0 END AS t, CASE WHEN label < 3 THEN 5.0 ELSE 1.0 END AS w FROM v, generate_series(1, 64) t(i))
SELECT vec_id, round(min(w) * avg(CASE WHEN t IS NOT NULL THEN greatest(z, 0) - z * t + ln(1 + exp(-abs(z))) END), 6) AS loss FROM x GROUP BY vec_id""")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda z, i: F.when(F.col("vec_id") % 7 == (i + 1) % 7, F.lit(None).cast("double")).otherwise((F.col("label") == (i + 1) % 10).cast("double"))
    v = _vec(spark, sf_dir)
    return v.select("vec_id", F.round(vectors.masked_bce(F.col("features"), F.transform("features", at), F.when(F.col("label") < 3, 5.0).otherwise(1.0)), 6).alias("loss"))


@query(f"""WITH {_VEC}, n AS (SELECT vec_id, vec_id % 16 AS b, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), s AS (SELECT a.b, a.vec_id, list_dot_product(a.e, c.e) / 0.1 AS s, a.label = c.label AS own FROM n a JOIN n c ON a.b = c.b AND a.vec_id <> c.vec_id),
r AS (SELECT b, vec_id, ln(sum(exp(s))) AS t, avg(CASE WHEN own THEN s END) AS o FROM s GROUP BY 1, 2) SELECT b AS batch, round(avg(t - o), 6) AS loss FROM r WHERE o IS NOT NULL GROUP BY b""")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vec(spark, sf_dir).withColumn("batch", F.col("vec_id") % 16)
    return vectors.contrastive_loss(v, "batch", "vec_id", "label", "features").withColumn("loss", F.round("loss", 6))


@query("""WITH n AS (SELECT role, conv_id, log2(count(*)) AS x FROM conversations GROUP BY 1, 2), q AS (SELECT role, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM n GROUP BY role)
SELECT role, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, round(min(x), 9) AS low, round(max(x), 9) AS high FROM n JOIN q USING (role) WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY role, q1, median, q3""")
def sequence_length_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = sequences.length_quantiles(_read(spark, sf_dir, "conversations"), "conv_id", "role")
    return q.select("role", *[F.round(c, 9).alias(c) for c in q.columns if c != "role"])


@query(f"""WITH {_VEC}, p AS (SELECT label, e[1] AS x, e[2] AS y FROM v), m AS (SELECT label, count(*) AS n, stddev_samp(x) * pow(count(*), -1 / 6.0::DOUBLE) * 0.5 AS hx, stddev_samp(y) * pow(count(*), -1 / 6.0::DOUBLE) * 0.5 AS hy, min(x) AS ax, max(x) AS zx, min(y) AS ay, max(y) AS zy FROM p GROUP BY label HAVING count(*) >= 10),
g AS (SELECT label, n, hx, hy, ax - 3 * hx AS lox, (zx - ax + 6 * hx) / 24 AS sx, ay - 3 * hy AS loy, (zy - ay + 6 * hy) / 24 AS sy FROM m), b AS (SELECT label, least(floor((x - lox) / sx), 23) AS bx, least(floor((y - loy) / sy), 23) AS byy, count(*) AS w FROM p JOIN g USING (label) GROUP BY 1, 2, 3)
SELECT label, CAST(i AS INT) AS gx, CAST(j AS INT) AS gy, round(sum(w * exp(-0.5 * pow((i - bx) * sx / hx, 2)) * exp(-0.5 * pow((j - byy) * sy / hy, 2))) / (any_value(n) * 2 * pi() * any_value(hx) * any_value(hy)), 6) AS density
FROM b JOIN g USING (label), generate_series(0, 23) a(i), generate_series(0, 23) c(j) GROUP BY 1, 2, 3""")
def label_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel density of the first two features for each label, on a grid of 24 by 24."""
    v = _vec(spark, sf_dir).select("label", F.get("features", 0).alias("x"), F.get("features", 1).alias("y"))
    return surfaces.kernel_density(v, "label", "x", "y", bins=24).select("label", "gx", "gy", F.round("density", 6).alias("density"))


@query()
def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a head, fitted on four fifths of the vectors, gives to all of them."""
    v = _vec(spark, sf_dir).withColumn("labels", F.array(*[(F.col("label") == i).cast("int") for i in range(10)])).withColumn("weight", F.when(F.col("label") < 3, 5.0).otherwise(1.0))
    coef = heads.fit(v.where("vec_id % 5 <> 0"), "features", "labels", "weight")
    return heads.scored(v, "features", coef).select("vec_id", (F.col("vec_id") % 5 == 0).alias("held_out"), "label", numeric.head_class(F.col("logits")).alias("head_class"))


# recordings: the events of a user as the samples of a WAV file


def _wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that ``audio.export`` has written of the events, found again by a scan."""
    root = f"{shared_place(spark)}/wav-{uuid.uuid4().hex}"
    frames = _frames(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", ((F.col("value") % 100) / 100).cast("float").alias("s")))).alias("x"))
    clips = frames.select(F.concat(F.lit("user"), F.col("user_id"), F.lit(".wav")).alias("filename"), F.lit(0).cast("bigint").alias("seg"), F.lit(8000).alias("sr"), F.col("x.s").alias("samples"))
    audio.export(clips, root).write.format("noop").mode("overwrite").save()
    return audio.files(spark, root)


_PCM = f"{F_SQL}, s AS (SELECT 'user' || user_id || '_0.wav' AS filename, i, trunc(CAST((value % 100) / 100 AS FLOAT) * CAST(32767 AS FLOAT)) / 32768.0::DOUBLE AS x FROM f), n AS (SELECT filename, count(*) AS n FROM s GROUP BY 1)"


@query(f"WITH {_PCM} SELECT filename, n AS num_frames, 8000 AS sr, n / 8000.0::DOUBLE AS duration FROM n")
def recording_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.metadata(_wav(spark, sf_dir)).select("filename", "num_frames", "sr", "duration")


@query(f"WITH {_PCM} SELECT filename, CAST(i AS INT) AS i, round(x, 6) AS x FROM s")
def recording_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.recordings(_wav(spark, sf_dir)).select("filename", F.posexplode("samples").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(f"""WITH {_PCM}, c AS (SELECT filename, CAST(unnest(generate_series(0, (n - 16) // 8)) AS INT) AS clip FROM n WHERE n >= 16)
SELECT c.filename, clip, clip * 8 / 8000.0::DOUBLE AS start, count(*) AS size, round(sum(x), 6) AS total FROM c JOIN s ON s.filename = c.filename AND i BETWEEN clip * 8 AND clip * 8 + 15 GROUP BY 1, 2""")
def recording_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = audio.training_clips(audio.recordings(_wav(spark, sf_dir)), 16, 8)
    return c.select("filename", "clip", "start", F.size("samples").cast("bigint").alias("size"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH {_PCM}, k AS (SELECT filename, unnest(generate_series(0, n // 4)) AS k FROM n)
SELECT k.filename, CAST(k AS INT) AS k, round(sqrt(coalesce(sum(x * x), 0) / 8), 6) AS rms FROM k LEFT JOIN s ON s.filename = k.filename AND i BETWEEN 4 * k - 4 AND 4 * k + 3 GROUP BY 1, 2""")
def rms_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of centred frames of 8 samples every 4."""
    t = calls.tracked(audio.recordings(_wav(spark, sf_dir)), lambda x, _: dsp.rms(x, 8, 4))
    return t.select("filename", F.posexplode("track").alias("k", "rms")).withColumn("rms", F.round("rms", 6))


@query(f"""WITH {_PCM}, k AS (SELECT filename, unnest(generate_series(0, (n - 8) // 4)) AS k FROM n WHERE n >= 8), j AS (SELECT filename, k, b, (i - 4 * k) AS j, x * (0.5 - 0.5 * cos(2 * pi() * (i - 4 * k) / 8)) AS y FROM k JOIN s USING (filename), generate_series(0, 4) g(b) WHERE i BETWEEN 4 * k AND 4 * k + 7)
SELECT filename, CAST(k AS INT) AS k, CAST(b AS INT) AS b, round(sqrt(pow(sum(y * cos(2 * pi() * b * j / 8)), 2) + pow(sum(y * sin(2 * pi() * b * j / 8)), 2)), 6) AS magnitude FROM j GROUP BY 1, 2, 3""")
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of Hann-windowed frames of 8 samples every 4."""
    t = calls.tracked(audio.recordings(_wav(spark, sf_dir)), lambda x, _: dsp.stft(x, 8, 4, 8))
    cells = t.select("filename", F.posexplode("track").alias("c", "m"))
    return cells.select("filename", F.floor(F.col("c") / 5).cast("int").alias("k"), (F.col("c") % 5).alias("b"), F.round("m", 6).alias("magnitude"))


@query(f"""WITH {_PCM}, m AS (SELECT filename, avg(x) AS m FROM s GROUP BY 1) SELECT filename, round(avg(pow(x - m, 2)), 9) AS m2, round(avg(pow(x - m, 3)), 9) AS m3, round(avg(pow(x - m, 4)), 9) AS m4 FROM s JOIN m USING (filename) GROUP BY 1""")
def amplitude_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = calls.tracked(audio.recordings(_wav(spark, sf_dir)), lambda x, _: np.array(dsp.moments(x)))
    return t.select("filename", *[F.round(F.get("track", k), 9).alias(f"m{k + 2}") for k in range(3)])


@query("""SELECT user_id, round(epoch_us(ts) / 1e6, 6) AS onset, round(epoch_us(ts) / 1e6 + 600 * value, 6) AS "offset" FROM events""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written as CSV in fixed precision and in order, and read again."""
    path = f"{shared_place(spark)}/csv-{uuid.uuid4().hex}"
    audio.write_csv(_intervals(spark, sf_dir), path, digits=6, order=["user_id", "onset"])
    return audio.read_csv(spark, path, "user_id bigint, onset double, offset double")


# streams and table functions


_RUNS = f"WITH {F_SQL}" + _HYSTERESIS[: _HYSTERESIS.index("\nSELECT")].format(t=34, gap=2) + " SELECT {key}, row_number() OVER (PARTITION BY user_id ORDER BY start_f) AS seg, start_f, end_f FROM k"


@query(_RUNS.format(key="user_id"))
def stream_call_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with gap tolerance from a stream: the frames arrive in files out of order, in several micro-batches, with a marker at each recording's end."""
    place = f"{shared_place(spark)}/runs-{uuid.uuid4().hex}"
    frames = _frames(spark, sf_dir).select("user_id", "i", (F.col("value") > 34).alias("active"))
    marks = frames.groupBy("user_id").agg(F.max("i").alias("last"))
    rows = frames.withColumn("last", F.lit(None).cast("bigint")).unionByName(marks.select("user_id", F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("boolean").alias("active"), "last"))
    rows.repartition(6, F.xxhash64("user_id", "i")).write.parquet(f"{place}/in")
    return events.over_new_files(spark, f"{place}/in", rows.schema, lambda df: stateful.runs_of_stream(df, "user_id", 2, 2), f"{place}/out", f"{place}/log", files_at_once=2)


@query(_RUNS.format(key="CAST(user_id AS VARCHAR) AS recording"))
def table_function_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with gap tolerance from a table function called in SQL, a partition for each recording."""
    stateful.register(spark)
    frames = _frames(spark, sf_dir).select(F.col("user_id").cast("string").alias("recording"), "i", (F.col("value") > 34).alias("active"))
    return spark.sql("SELECT * FROM segments(TABLE(SELECT * FROM {frames}) PARTITION BY (recording) ORDER BY (i), 2, 2)", frames=frames)


@query("""WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE value > 34), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM a),
g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a),
s AS (SELECT user_id, min(ts) AS f, max(ts) AS l, count(*) AS n FROM g GROUP BY user_id, g HAVING count(*) >= 2)
SELECT user_id, epoch_us(f) / 1e6 AS onset, epoch_us(l) / 1e6 AS last, n FROM s, m WHERE l + INTERVAL 6 HOUR <= w""")
def stream_call_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files: sessions that the watermark has closed once all files are read."""
    place = f"{shared_place(spark)}/sessions-{uuid.uuid4().hex}"
    schema = _read(spark, sf_dir, "events").schema
    plan = lambda df: events.call_sessions(df.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score")), "user_id", 34.0, 21_600, 2)
    closed = events.over_new_files(spark, f"{sf_dir}/events.parquet", schema, plan, f"{place}/out", f"{place}/log")
    at = lambda c: _epoch(f"cast({c} AS timestamp_ntz)").alias(c)
    return closed.select("user_id", at("onset"), at("last"), "n")
