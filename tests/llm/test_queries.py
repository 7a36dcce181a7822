"""The registered queries over small tables, and the pipeline stage by stage against brute force."""

import os
import random
import zlib

import numpy as np
import pytest

from sonorant.llm import quality, secret_scan, simhash
from sonorant.llm import queries as Q

from .test_line_dedup import brute
from .test_simhash import components, jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixtures")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_a_query_returns_a_row_for_each_row(spark, name):
    table, key = {"op2_url_filter": ("pages", "page_id"), "op12_turns": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    got = [r[0] for r in Q.QUERIES[name](spark, SF).select(key).collect()]
    assert set(got) == set(ids) and (name in ("op9_packing", "op13_packing") or len(got) == len(set(ids) if name == "op12_turns" else ids))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no fixtures")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with near copies, repeated lines, secrets, nulls, empties, repeated rows and clashing columns; labels for some."""
    rng = random.Random(21)
    word = lambda: f"{rng.choice(['river', 'stone', 'light', 'house'])}{rng.randrange(5000)}"
    texts = []
    for _ in range(25):
        lines = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(2, 5))]
        texts.append("\n".join([*lines, "all rights reserved by the owner"]))
        edited = lines[0].split(" ")
        edited[rng.randrange(len(edited))] = "edited"
        texts.append("\n".join([" ".join(edited), *(" ".join(word() for _ in range(12)) for _ in range(3)), "password = hunter2222"]))
    texts += [texts[0], None, "", "too short", "word " * 100, "$ % | " * 40]
    ids = [*range(len(texts) - 2), None, 3]
    root = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "aa", "src", len(t or ""), 7, 8, 9) for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[4])
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _own int, spans int, _lines int").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 5 != 4, 0) for i in range(40)], "doc_id bigint, quality boolean, toxic int").selectExpr("doc_id", "cast(quality AS int) AS quality", "toxic").write.parquet(f"{root}/labels.parquet")
    return root


def stages(spark, root):
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), []
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, root).cache()
        out.append(docs)
    return out


def test_each_stage_equals_brute_force(spark, tables):
    first, second, third, fourth, last = stages(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())

    trees = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    good = []
    for r in docs.collect():
        base, x = quality.statistics((r["text"] or "").encode())
        if base[0] >= 20 and 100 * base[4] <= 30 * base[0] and trees.score(np.array([x]))[0] >= 0.5:
            good.append((str(r["doc_id"]), str(r["text"])))
    assert key(first) == sorted(good) and len(good) > 20

    rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in first.collect()})
    # rows alike in id are few; the order among them is by a hash, so only the set of kept lines is compared
    gone = brute([t for *_, t in rows])
    kept = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, (*_, t) in enumerate(rows)]
    assert sorted({r["text"] for r in second.collect()}) == sorted({t for t in kept if t.split()})
    assert all(r["n_chars"] == len(r["text"]) and (r["_own"], r["spans"], r["_lines"]) == (7, 8, 9) for r in second.collect())

    rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in second.collect()})
    root = components(len(rows), lambda i, j: jaccard(rows[i][2], rows[j][2]) >= 0.8)
    assert sorted(r["text"] for r in third.collect()) == sorted(rows[i][2] for i in set(root))

    spans = {r["doc_id"]: (r["text"], r["spans"]) for r in secret_scan.with_spans(third.drop("spans")).collect()}
    for r in fourth.collect():
        text, found = spans[r["doc_id"]]
        for s in reversed(found):
            text = text[: s["start"]] + "[secret]" + text[s["end"] :]
        assert r["text"] == text and r["n_chars"] == len(text) and "hunter2222" not in text

    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    pieces = last.collect()
    for r in fourth.collect():
        ids = [*known.encode(r["text"], add_special_tokens=False).ids, 2]
        mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == r["doc_id"])
        assert mine == [(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for a, n, _ in mine] and sum(n for _, n, _ in mine) == len(ids)
    assert simhash.first_of_groups(third).count() == third.count()


def test_run_applies_the_stages_and_takes_empty_tables(spark, tables, tmp_path):
    want = sorted(tuple(r)[:5] for r in stages(spark, tables)[-1].collect())
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, tables).collect()) == want
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
