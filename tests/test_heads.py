"""Heads and densities: gradients against finite differences, held-out rows, kernel sums written out."""

import numpy as np

from sonorant.operators import heads, surfaces


def test_gradient_equals_finite_differences(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(0, 1, 3).tolist(), [None if rng.random() < 0.3 else float(rng.random() < 0.5) for _ in range(2)], float(rng.choice([1.0, 5.0]))) for _ in range(40)]
    df = spark.createDataFrame(rows, "x array<double>, t array<double>, w double").selectExpr("x", "transform(t, v -> coalesce(v, double('nan'))) AS t", "w").repartition(3).cache()
    loss = heads._loss(df, (3, 2), 0.1)
    at = rng.normal(0, 1, 8)
    f, g = loss(at)
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-5
        assert np.isclose(g[k], (loss(at + step)[0] - loss(at - step)[0]) / 2e-5, atol=1e-6)
    want = 0.0
    coef = at.reshape(4, 2)
    for x, t, w in rows:
        z = np.array(x) @ coef[:-1] + coef[-1]
        each = [np.log1p(np.exp(-z[k])) if v == 1 else np.log1p(np.exp(z[k])) for k, v in enumerate(t) if v is not None]
        want += w * np.mean(each) if each else 0
    assert np.isclose(f, want / 40 + 0.05 * (coef[:-1] ** 2).sum())


def test_a_head_learns_and_takes_unknown_labels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 6))
    truth = x @ rng.normal(0, 2, (6, 3)) > 0.5
    rows = [(i, v.tolist(), [None if rng.random() < 0.2 else int(b) for b in t], 1.0) for i, (v, t) in enumerate(zip(x, truth, strict=True))] + [(900, None, [1, 0, 1], 1.0), (901, [0.0] * 6, [None] * 3, 5.0)]
    df = spark.createDataFrame(rows, "id int, f array<double>, labels array<int>, w double")
    coef = heads.fit(df.where("id < 300 OR id >= 900"), "f", "labels", "w")
    got = {r["id"]: r["logits"] for r in heads.scored(df, "f", coef).collect()}
    right = np.mean([(np.array(got[i]) > 0) == truth[i] for i in range(300, 400)])
    assert coef.shape == (7, 3) and right > 0.93 and got[900] is None


def test_densities_equal_written_out_sums(spark):
    rng = np.random.default_rng(2)
    points = np.r_[rng.normal([0, 5], [1, 3], (200, 2)), rng.normal(0, 1, (9, 2))]
    rows = [("a" if i < 200 else "few", float(u), float(v)) for i, (u, v) in enumerate(points)] + [("line", 1.0, float(k)) for k in range(12)] + [("a", None, 1.0)] + [(None, float(u), float(v)) for u, v in points[:20]]
    out = surfaces.kernel_density(spark.createDataFrame(rows, "species string, u double, v double"), "species", "u", "v", bins=120).collect()
    own = {k: [r for r in out if r["species"] == k] for k in ("a", None)}
    assert len(out) == 2 * 120 * 120
    for name, p in (("a", points[:200]), (None, points[:20])):
        h = p.std(axis=0, ddof=1) * len(p) ** (-1 / 6) * 0.5
        g = np.array([(r["x"], r["y"]) for r in own[name]])
        want = np.exp(-0.5 * (((g[:, None] - p[None]) / h) ** 2).sum(axis=2)).sum(axis=1) / (len(p) * 2 * np.pi * h.prod())
        got = np.array([r["density"] for r in own[name]])
        assert np.abs(got - want).max() < 0.05 * want.max()  # points stand in the middle of their cells
        cell = np.ptp(g, axis=0) / 119
        assert np.isclose((got * cell.prod()).sum(), 1, atol=0.01)
