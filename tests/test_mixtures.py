"""EM of all kinds against a plain loop, scans, full refits and Dirichlet-process mixtures."""

import numpy as np
import pytest

from sonorant.operators import _sums, clustering, dirichlet


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (120, 3)), rng.normal([5, 0, 1], [0.4, 1, 2], (100, 3)), rng.normal([0, 6, -3], 0.7, (80, 3))]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>").repartition(5).cache()


def plain_em(x, fit, kind, rounds, reg=1e-4):
    """Densities written out, one row and component at a time."""
    n, d = x.shape
    w, m, c = fit.weights, fit.means, fit.cov
    for _ in range(rounds):
        cov = [np.diag(c[j]) if kind == "diag" else c if kind == "tied" else c[j] for j in range(len(w))]
        joint = np.array([[w[j] * np.exp(-0.5 * (v - m[j]) @ np.linalg.inv(cov[j]) @ (v - m[j])) / np.sqrt((2 * np.pi) ** d * np.linalg.det(cov[j])) for j in range(len(w))] for v in x])
        ll, r = np.log(joint.sum(axis=1)).sum(), joint / joint.sum(axis=1, keepdims=True)
        w, m = r.mean(axis=0), (r.T @ x) / r.sum(axis=0)[:, None]
        each = [((x - m[j]).T * r[:, j]) @ (x - m[j]) for j in range(len(w))]
        if kind == "tied":
            c = sum(each) / n + reg * np.eye(d)
        else:
            full = np.array([e / q for e, q in zip(each, r.sum(axis=0), strict=True)])
            c = full + reg * np.eye(d) if kind == "full" else np.array([np.diag(f) for f in full]) + reg
    return w, m, c, ll


@pytest.mark.parametrize("kind", ["diag", "tied", "full"])
def test_em_equals_a_plain_loop_and_never_falls(blobs, kind):
    x, df = blobs
    begin = clustering.em(df, "features", 3, kind, rounds=1)
    seen = []
    more = clustering.em_all(df, "features", [3], kind, rounds=4, tol=-np.inf, watch=lambda ll: seen.append(ll[3]))[3]
    w, m, c, ll = plain_em(x, begin, kind, 3)
    assert np.allclose(more.weights, w) and np.allclose(more.means, m) and np.allclose(more.cov, c) and np.isclose(more.loglik, ll)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)) and len(seen) == 4 and not more.settled


def test_a_scan_settles_or_says_that_it_has_not(blobs):
    _, df = blobs
    rows = {r["k"]: r for r in clustering.bic_scan(df, "features", range(1, 6), "diag").collect()}
    assert all(r["settled"] and 1 < r["rounds"] < clustering.ROUNDS for r in rows.values()) and min(rows, key=lambda k: rows[k]["bic"]) == 3
    assert not clustering.em(df, "features", 4, "diag", rounds=2).settled
    table = {r["k"]: r["within"] for r in clustering.within(clustering.bic_scan(df, "features", range(1, 6), "diag"), [0.0, 100.0]).collect()}
    assert table[3] == [0.0, 100.0] and table[1] == [100.0]
    assert clustering.em_all(df.limit(0), "features", [2], "diag") == {}


def test_the_refit_has_full_covariances(blobs, spark):
    rng = np.random.default_rng(1)
    long = np.array([[3.0, 2.9], [2.9, 3.0]])  # two crossed ridges, which one covariance for both cannot follow
    x = np.r_[rng.multivariate_normal([0, 0], long, 150), rng.multivariate_normal([0, 0], long * [[1, -1], [-1, 1]], 150)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    fit = clustering.em(df, "features", 2, "full")
    assert sorted(np.sign(c[0, 1]) for c in fit.cov) == [-1, 1]
    out = clustering.choose_and_refit(df, "features", [2], "tied", [0.5, 1.0])
    got = {(r["thr"], r["id"]): r for r in out.collect()}
    assert len(got) == 600
    first = clustering.assigned(df, "features", *fit[:3], "full").collect()
    assert all(got[1.0, r["id"]]["cluster"] == r["cluster"] and np.allclose(got[0.5, r["id"]]["probs"], r["probs"]) for r in first)


def test_sums_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(_sums, "FAN", 3)
    monkeypatch.setattr(_sums, "BLOCK", 4)
    df = spark.range(1000).selectExpr("array(cast(id as double), 1d) AS x").repartition(11)
    got = _sums.totals(df, 10, lambda b: np.repeat(_sums.matrix(b.column(0)).sum(axis=0), 5))
    assert got.tolist() == [499500.0] * 5 + [1000.0] * 5


def test_dirichlet_process_drops_components_and_its_bound_never_falls(blobs):
    x, df = blobs
    seen = []
    p = dirichlet.fit(df, "features", 8, watch=seen.append, tol=1e-5)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:], strict=False)) and p.settled and len(seen) == p.rounds > 2
    w = p.weights()
    assert (w > 0.05).sum() == 3 and np.isclose(w.sum(), 1, atol=0.05)
    rows = sorted(dirichlet.assigned(df, "features", p).collect(), key=lambda r: r["id"])
    label = np.array([r["cluster"] for r in rows])
    for part in (slice(0, 120), slice(120, 220), slice(220, 300)):
        assert np.bincount(label[part]).max() >= 0.95 * len(label[part])
    assert all(np.isclose(sum(r["probs"]), 1) for r in rows)


def test_dirichlet_posteriors_equal_the_formulas_for_one_component(spark):
    x = np.random.default_rng(0).normal([1, -2], [1, 3], (50, 2))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    p = dirichlet.fit(df, "features", 1)
    cov = np.cov(x.T, bias=True) + 1e-6 * np.eye(2)
    assert np.allclose(p.m[0], x.mean(axis=0)) and p.kappa[0] == 51 and p.nu[0] == 52
    assert np.allclose(p.inverse[0], 2 * cov + (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
    # with one component the bound is the exact evidence
    d, n = 2, 50
    evidence = -0.5 * n * d * np.log(np.pi) + 0.5 * d * np.log(1 / 51) + 0.5 * 2 * np.linalg.slogdet(2 * cov)[1] - 0.5 * 52 * np.linalg.slogdet(p.inverse[0])[1]
    evidence += sum(dirichlet.log_gamma(np.array([(52 - i) / 2]))[0] - dirichlet.log_gamma(np.array([(2 - i) / 2]))[0] for i in range(d))
    sticks = dirichlet.log_gamma(np.array([51.0]))[0] + dirichlet.log_gamma(np.array([1.0 + 1]))[0] - dirichlet.log_gamma(np.array([52.0]))[0]  # the share of the only stick is integrated out
    assert np.isclose(p.bound, evidence + sticks, rtol=1e-6)
