"""Plain-loop oracles and edge cases of the ordered operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorant.operators import clustering, intervals, relational, runs, sequences, vectors


def loop_runs(active, gap, least):
    out, start, last = [], None, None
    for i, on in enumerate(active):
        if on:
            if start is None:
                start = i
            elif i - last - 1 > gap:
                out.append((start, last))
                start = i
            last = i
    if start is not None:
        n = len(active) - 1
        out.append((start, n if n - last <= gap else last))
    return [r for r in out if r[1] - r[0] + 1 >= least]


def test_hysteresis_equals_a_state_machine(spark):
    rng = random.Random(1)
    cases = [[rng.random() < 0.4 for _ in range(rng.randint(1, 30))] for _ in range(40)] + [[True], [False], [True, False, False, True]]
    df = spark.createDataFrame([(k, i, on) for k, c in enumerate(cases) for i, on in enumerate(c)], "k int, i bigint, on boolean")
    for gap, least in ((0, 1), (2, 2), (3, 1)):
        got = {}
        for r in runs.runs(df, "k", F.col("on"), least, gap, hold_open=True).orderBy("k", "seg").collect():
            got.setdefault(r["k"], []).append((r["start_f"], r["end_f"]))
        assert got == {k: w for k, c in enumerate(cases) if (w := loop_runs(c, gap, least))}


def test_coalescing_keeps_contained_intervals_together(spark):
    df = spark.createDataFrame([("a", 0.0, 10.0), ("a", 1.0, 2.0), ("a", 11.0, 12.0), ("a", 13.5, 14.0), ("b", 0.0, 1.0)], "f string, onset double, offset double")
    got = sorted(tuple(r) for r in intervals.coalesce(df, ["f"], 1.0).collect())
    assert got == [("a", 0.0, 12.0), ("a", 13.5, 14.0), ("b", 0.0, 1.0)]


def test_matching_is_one_to_one(spark):
    ref = spark.createDataFrame([("x", 1.0, 2.0), ("x", 1.2, 2.2)], "filename string, onset double, offset double")
    sys = spark.createDataFrame([("x", 1.1, 2.1), ("x", 9.0, 9.5), ("y", 1.0, 2.0)], "filename string, onset double, offset double")
    m = intervals.event_metrics(ref, sys).first()
    assert (m["tp"], m["fp"], m["fn"]) == (1, 1, 1)


def test_soft_markov_equals_the_outer_products(spark):
    rng = np.random.default_rng(0)
    seqs = {g: rng.dirichlet(np.ones(3), size=n) for g, n in (("a", 1), ("b", 4), ("c", 2))}
    rows = [(g, t, str(s), float(p[s])) for g, m in seqs.items() for t, p in enumerate(m) for s in range(3)]
    want = np.zeros((5, 5))  # START, 0, 1, 2, END
    for m in seqs.values():
        want[0, 1:4] += m[0]
        for p, q in zip(m, m[1:]):
            want[1:4, 1:4] += np.outer(p, q)
        want[1:4, 4] += m[-1]
    want = want / np.maximum(want.sum(axis=1, keepdims=True), 1e-300)
    name = {"START": 0, "END": 4} | {str(s): s + 1 for s in range(3)}
    got = sequences.markov1(spark.createDataFrame(rows, "g string, t int, state string, p double"), "g").collect()
    for r in got:
        assert abs(want[name[r["src"]], name[r["dst"]]] - r["prob"]) < 1e-12


@pytest.mark.parametrize("tail", ["drop", "anchor"])
def test_window_counts(spark, tail):
    for n, drop, anchor in ((0, 1, 1), (5, 1, 1), (6, 1, 2), (9, 2, 3), (10, 2, 3)):
        df = spark.createDataFrame([([1.0] * n,)], "x array<double>")
        w = df.select(vectors.windows(F.col("x"), 6, 3, tail).alias("w")).first()["w"]
        assert len(w) == (drop if tail == "drop" else anchor) and all(len(v) == 6 for v in w), (n, tail)


def test_ranked_equals_a_global_row_number(spark):
    vals = random.Random(2).sample(range(1000), 300)
    got = {r["v"]: r["n"] for r in relational.ranked(spark.createDataFrame([(v,) for v in vals], "v int"), F.col("v"), parts=7).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(vals))}


def test_dirty_booleans(spark):
    df = spark.createDataFrame([(" True ",), ("false",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(relational.dirty_bool(F.col("x"))).collect()] == [True, False, False, None]


def test_em_likelihood_and_bic(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(6, 1, (60, 2))]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").cache()
    for kind in ("diag", "tied"):
        one, two = (clustering.em(df, "features", k, kind, rounds=5) for k in (1, 2))
        assert two[3] > one[3]
        assert clustering.bic(two[3], 120, 2, 2, kind) < clustering.bic(one[3], 120, 1, 2, kind)
    scan = spark.createDataFrame([(2, 10.0), (3, 4.0), (4, 4.5)], "k int, bic double")
    assert clustering.select_k(scan, [1.0]).first()["k"] == 3


def test_bounded_leaves(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))], "id int, features array<double>")
    out = clustering.bounded_leaves(df, "features", 25)
    assert out.count() == 60 and max(r["count"] for r in out.groupBy("leaf").count().collect()) <= 25
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "id int, features array<double>")
    assert clustering.bounded_leaves(same, "features", 2).count() == 6


def test_leaves_merge_at_most_once(spark):
    pairs = spark.createDataFrame([(0, 1, 0.05), (1, 2, 0.01), (0, 3, 0.1), (2, 3, 0.5)], "i int, j int, dist double")
    assert clustering.merge_leaves(pairs, [0, 1, 2, 3]) == {0: 0, 1: 0, 2: 2, 3: 3}


def brute_matching(ref, sys, collar, share):
    """The most pairs by trying every assignment of one reference event after the other."""
    def best(i, used):
        if i == len(ref):
            return 0
        most = best(i + 1, used)
        on, off = ref[i]
        for j, (a, b) in enumerate(sys):
            if j not in used and abs(a - on) <= collar and abs(b - off) <= max(collar, share * (off - on)):
                most = max(most, 1 + best(i + 1, used | {j}))
        return most

    return best(0, frozenset())


def test_matching_is_the_largest_one_and_keeps_equal_events_apart(spark):
    rng = random.Random(5)
    ref, sys, want = [], [], {}
    for k in range(40):
        times = lambda: [(t := round(rng.random() * 6, 1), t + rng.choice([0.5, 1.0, 3.0])) for _ in range(rng.randint(0, 6))]
        a, b = times(), times()
        a += a[:1]
        b += b[:1]
        ref += [(f"f{k}", "x", *e) for e in a]
        sys += [(f"f{k}", "x", *e) for e in b]
        want[f"f{k}"] = brute_matching(a, b, 0.75, 0.5)
    schema = "filename string, event_label string, onset double, offset double"
    got = intervals.match_events(spark.createDataFrame(ref, schema), spark.createDataFrame(sys, schema)).groupBy("filename").count().collect()
    assert {r["filename"]: r["count"] for r in got} == {k: n for k, n in want.items() if n}
    other = spark.createDataFrame([(f, "y", a, b) for f, _, a, b in sys], schema)
    m = intervals.event_metrics(spark.createDataFrame(ref, schema), other, label="event_label").first()
    assert (m["tp"], m["fn"]) == (0, len(ref))


def test_ranked_numbers_a_table_beyond_any_sample(spark):
    n = 1_200_000
    df = spark.range(n).select(F.expr("(id * 7919) % 1200007").alias("v"), F.repeat(F.lit("pay"), 5).alias("load"), F.uuid().alias("noise"))
    got = relational.ranked(df, F.col("v"), parts=8)
    placed = got.join(df.select("v").distinct(), "v").agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(placed) == (n, n, 1, n)
    steps = got.alias("a").join(got.alias("b"), F.col("b.n") == F.col("a.n") + 1).where("b.v <= a.v")
    assert steps.count() == 0


def test_prefixes_of_any_length(spark):
    names = spark.createDataFrame([("call_00001_1.wav",), ("call_10001_1.wav",), ("a",), (None,), ("",)], "name string")
    p = spark.createDataFrame([("call_0",), ("a",), (None,)], "p string")
    assert sorted(str(r[0]) for r in relational.without_prefix(names, "name", p, "p").collect()) == ["", "None", "call_10001_1.wav"]
    assert relational.without_prefix(names, "name", p.limit(0), "p").count() == 5


def test_an_override_takes_one_newer_row_as_a_whole(spark):
    base = spark.createDataFrame([("a", 0, 0), ("b", 5, 5)], "k string, x int, y int")
    newer = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("c", 1, 1)], "k string, x int, y int")
    assert sorted(tuple(r) for r in relational.override(base, newer, "k", ["x", "y"]).collect()) == [("a", 2, 3), ("b", 5, 5)]


def test_distant_peaks_equal_a_plain_suppression(spark):
    from sonorant.operators import smoothing

    rng = random.Random(3)
    cases = [sorted(rng.sample(range(60), rng.randint(0, 20))) for _ in range(20)]
    rows = [(k, i, rng.choice([0.3, 0.5, 0.7, 0.9])) for k, c in enumerate(cases) for i in c]
    want = set()
    for k in range(20):
        mine = sorted(((x, i) for kk, i, x in rows if kk == k), reverse=True)
        kept = []
        for x, i in mine:
            if all(abs(i - j) >= 5 for j in kept):
                kept.append(i)
        want |= {(k, i) for i in kept}
    got = smoothing.distant_peaks(spark.createDataFrame(rows, "k int, i int, x double"), "k", "x").collect()
    assert {(r["k"], r["i"]) for r in got} == want


def test_silhouette_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(40, 3)), [0] * 20 + [1] * 19 + [2]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i in range(40):
        mean = {c: np.mean([d[i, j] for j in range(40) if label[j] == c and j != i]) for c in set(label) if not (c == label[i] and label.count(c) == 1)}
        a, b = mean.get(label[i]), min(v for c, v in mean.items() if c != label[i])
        values.append(0.0 if a is None else (b - a) / max(a, b))
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id int, features array<double>, label int")
    monkeypatch.setattr(clustering, "BLOCK", 7)
    assert abs(clustering.silhouette(df, "id", "features", "label").first()[0] - np.mean(values)) < 1e-9


def test_super_embeddings_refuse_keys_that_do_not_agree(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0])], "id int, features array<double>")
    b = spark.createDataFrame([(1, [1.0]), (3, [3.0])], "id int, features array<double>")
    assert len(vectors.super_embedding(a, a, "id", "features").first()["features"]) == 4
    with pytest.raises(Exception, match="keys do not agree"):
        vectors.super_embedding(a, b, "id", "features").collect()


def test_components_of_few_rows_are_the_columns_themselves(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0), (2, 5.0, 6.0, 7.0, 8.0)], "id int, a double, b double, c double, d double")
    got = clustering.top_components(df, ["a", "b", "c", "d"], "pc").orderBy("id").collect()
    assert [tuple(r)[5:] for r in got] == [(1.0, 2.0, 3.0), (5.0, 6.0, 7.0)]


def test_choice_and_assignment(spark):
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.3, (60, 2)), rng.normal([0, 6], 0.3, (60, 2))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    out = clustering.choose_and_refit(df, "features", range(1, 6), "tied", [0.5, 1.0]).toPandas()
    assert set(out.thr) == {0.5, 1.0} and (out.groupby("thr").id.nunique() == 180).all()
    half = out[out.thr == 0.5].sort_values("id")
    assert half.k.iloc[0] == 3 and all(half.cluster.iloc[s : s + 60].nunique() == 1 for s in (0, 60, 120))


def test_variational_mixtures_drop_what_they_do_not_need():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, 200), rng.normal(12, 1, 200)]
    r = clustering.bayesian_1d(x, np.ones(400))
    low, high = r[:200].mean(axis=0), r[200:].mean(axis=0)
    assert np.allclose(r.sum(axis=1), 1) and np.minimum(low, high).max() < 1e-3
    assert np.allclose(clustering.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890])


def test_silences_split_recordings(spark):
    cases = {"a": "oo....oooo..oo", "b": "....", "c": "oooo", "d": "....oo....", "e": "o...o"}
    df = spark.createDataFrame([(k, i, c == ".") for k, s in cases.items() for i, c in enumerate(s)], "k string, i bigint, quiet boolean")
    got = {}
    for r in runs.split_at_silence(df, "k", F.col("quiet"), 3, 1).orderBy("k", "seg").collect():
        got.setdefault(r["k"], []).append((r["start_f"], r["end_f"]))
    assert got == {"a": [(0, 2), (5, 13)], "c": [(0, 3)], "d": [(3, 6)], "e": [(0, 1), (3, 4)]}


def test_scalar_functions_of_edges(spark):
    from sonorant.functions import numeric

    row = spark.range(1).select(
        numeric.to_uint8(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("flat"), numeric.or_zeros(F.lit(None).cast("array<double>"), 3).alias("none"),
        numeric.or_zeros(F.array(F.lit(2.0)), 3).alias("some"), numeric.jittered(F.lit(1.0), 3).alias("j"), numeric.quantised(F.lit(9.0)).alias("q"),
    ).first()
    assert (row["flat"], row["none"], row["some"], row["q"]) == (0, [0.0] * 3, [2.0], 255) and 0 < abs(row["j"] - 1) < 1e-4


def test_intervals_of_a_named_tier(spark):
    row = spark.range(1).select(F.expr("array(named_struct('name', 'Calls', 'intervals', array(named_struct('minTime', 0d, 'maxTime', 1d, 'mark', ''), named_struct('minTime', 1d, 'maxTime', 1d, 'mark', 'x'))), named_struct('name', 'other', 'intervals', array(named_struct('minTime', 5d, 'maxTime', 6d, 'mark', 'y'))))").alias("t"))
    assert [tuple(x)[:2] for x in row.select(intervals.class_labels(F.col("t"), "calls").alias("x")).first()["x"]] == [(0.0, 1.0)]


def test_silhouette_deals_out_no_rows_and_counts_rows_of_a_key_as_one(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(60, 4)), rng.choice(["a", "b", None], 60, p=[0.5, 0.3, 0.2]).tolist()
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id int, features array<double>, label string").repartition(5)
    monkeypatch.setattr(clustering, "BLOCK", 9)
    rows, joins = clustering.kept, []
    monkeypatch.setattr(clustering, "kept", lambda d: joins.append(d) or rows(d))
    got = clustering.silhouette(df, "id", "features", "label")
    assert "Exchange" not in got._jdf.queryExecution().toString() and len(joins) == 1
    own = [i for i in range(60) if label[i]]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i in own:
        mean = {c: np.mean([d[i, j] for j in own if label[j] == c and j != i]) for c in "ab"}
        a, b = mean[label[i]], mean["b" if label[i] == "a" else "a"]
        values.append((b - a) / max(a, b))
    assert abs(got.first()[0] - np.mean(values)) < 1e-9
    assert clustering.silhouette(df.where("label = 'a'"), "id", "features", "label").first()[0] is None
    assert clustering.silhouette(df.limit(0), "id", "features", "label").first()[0] is None


def test_contrastive_loss_meets_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(50, 5)), rng.integers(0, 4, 50).tolist()
    x[7], label[9] = 0, None
    keys = [*range(48), 3, None]  # a key twice, and one that is missing
    df = spark.createDataFrame([(i % 2, k, v.tolist(), c) for i, (k, v, c) in enumerate(zip(keys, x, label, strict=True))], "b int, k int, f array<double>, l int")
    monkeypatch.setattr(vectors, "PIECE", 4)
    monkeypatch.setattr(vectors, "TILE", 3)
    got = {r["b"]: r["loss"] for r in vectors.contrastive_loss(df, "b", "k", "l", "f").collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    for b in (0, 1):
        rows, sums = [i for i in range(49) if i % 2 == b], {}
        for i in rows:
            e, own = sums.setdefault(keys[i], ([], []))
            for j in rows:
                if keys[i] != keys[j]:
                    s = unit[i] @ unit[j] / 0.1
                    e.append(np.exp(s))
                    if label[i] is not None and label[i] == label[j]:
                        own.append(s)
        assert abs(got[b] - np.mean([np.log(sum(e)) - np.mean(o) for e, o in sums.values() if o])) < 1e-9
    plan = vectors.contrastive_loss(df, "b", "k", "l", "f")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # before: every pair of rows was a row of a join
