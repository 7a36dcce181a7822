"""Every catalogue query that has SQL against DuckDB on the small fixtures."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sonorant.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixtures")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    got, want = ordered(catalogue.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(catalogue.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["bic_scan_diag", "bic_scan_tied", "bic_table", "bic_refit", "event_metrics", "peak_count_distance", "explained_variance"])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_soft_rows_sum_to_one(spark):
    for row in catalogue.QUERIES["gmm_soft"](spark, SF).collect():
        assert abs(sum(row["probs"]) - 1) < 1e-9
    shares = {}
    for row in catalogue.QUERIES["subcluster"](spark, SF).collect():
        shares[row["vec_id"]] = shares.get(row["vec_id"], 0) + row["p"]
    assert all(abs(x - 1) < 1e-9 for x in shares.values())


def vectors_of(duck):
    rows = duck.sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def test_clusters_are_the_nearest_centres(spark, duck):
    ids, x = vectors_of(duck)
    rows = {r["vec_id"]: r for r in catalogue.QUERIES["kmeans"](spark, SF).collect()}
    own = np.array([rows[i]["cluster"] for i in ids])
    assert set(own) == set(range(10)) and all(rows[i]["probs"][rows[i]["cluster"]] == 1 == sum(rows[i]["probs"]) for i in ids)
    centres = np.stack([x[own == c].mean(axis=0) for c in range(10)])
    assert (((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == own).mean() > 0.98


def test_components_equal_a_singular_value_decomposition(spark, duck):
    ids, x = vectors_of(duck)
    got = {r["vec_id"]: r["pc"] for r in catalogue.QUERIES["pca2"](spark, SF).collect()}
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(np.array([got[i] for i in ids])), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    share = [r["share"] for r in sorted(catalogue.QUERIES["explained_variance"](spark, SF).collect())]
    assert np.allclose(share, (s**2 / (s**2).sum())[:10])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, _ = np.linalg.svd(z[:, :12] - z[:, :12].mean(axis=0), full_matrices=False)
    three = {r["vec_id"]: [r[f"harmonic_pc{k}"] for k in (1, 2, 3)] for r in catalogue.QUERIES["top_components"](spark, SF).collect()}
    assert np.allclose(np.abs(np.array([three[i] for i in ids])), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_leaves_are_bounded(spark):
    leaves = catalogue.QUERIES["size_bounded_tree"](spark, SF).groupBy("leaf").count().collect()
    assert max(r["count"] for r in leaves) <= sum(r["count"] for r in leaves) // 6


def test_queries_read_folders_of_files_and_all_of_a_long_recording(spark, tmp_path):
    """The events as a folder of parts, a part of them more than a year later."""
    later = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 400 DAYS ELSE ts END AS ts", "user_id", "event_type", "value", "props")
    later.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("stream_call_sessions", "clip_labels"):
        got, want = ordered(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()), ordered(con.sql(catalogue.SQL[name]).df())
        assert len(got) and (name != "clip_labels" or got["start"].max() - got["start"].min() > 400 * 86_400)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)
