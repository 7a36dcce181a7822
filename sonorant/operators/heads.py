"""Multi-label heads on given feature vectors: masked, weighted logistic loss, minimised by sums over the partitions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sums import matrix, totals


def row_losses(x: np.ndarray, t: np.ndarray, w: np.ndarray, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's weighted mean loss over its known labels (NaN: unknown), and its derivative by the scores; 0 for a row without any."""
    z = x @ coef[:-1] + coef[-1]
    known = ~np.isnan(t)
    t = np.where(known, t, 0.0)
    each = np.where(known, np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z))), 0.0)
    n = np.maximum(known.sum(axis=1, keepdims=True), 1)
    share = w[:, None] / n
    return (each * share).sum(axis=1), np.where(known, 0.5 * (1 + np.tanh(z / 2)) - t, 0.0) * share


def _loss(df: DataFrame, shape: tuple[int, int], penalty: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss of the rows ``(x, t, w)`` and its gradient; a call is one pass."""
    d, c = shape

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        coef = flat.reshape(d + 1, c)

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x, t, w = matrix(batch.column(0)), matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            loss, slope = row_losses(x, t, w, coef)
            return np.concatenate([(x.T @ slope).ravel(), slope.sum(axis=0), [loss.sum(), len(x)]])

        s = totals(df, (d + 1) * c + 2, partial)
        n = max(s[-1], 1)
        shrunk = coef.copy()
        shrunk[-1] = 0  # the intercept is free
        return float(s[-2] / n + 0.5 * penalty * (shrunk**2).sum()), s[:-2] / n + penalty * shrunk.ravel()

    return at


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], begin: np.ndarray, rounds: int, tol: float, memory: int = 8) -> tuple[np.ndarray, float, bool]:
    """Place and value of a minimum by limited-memory quasi-Newton steps with halved step lengths, and whether it settled."""
    x, (f, g) = begin, loss(begin)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(rounds):
        if np.abs(g).max() < tol:
            return x, f, True
        q, steps = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            steps.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(steps), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        length = 1.0 if pairs else 1 / max(np.abs(g).max(), 1)
        while length > 1e-10:
            new = x - length * q
            f_new, g_new = loss(new)
            if f_new <= f - 1e-4 * length * (g @ q):
                break
            length /= 2
        else:
            return x, f, True  # no step is an improvement any more
        if (g_new - g) @ (new - x) > 1e-12:
            pairs.append((new - x, g_new - g))
        x, f, g = new, f_new, g_new
    return x, f, False


def fit(df: DataFrame, features: str, labels: str, weight: str | None = None, penalty: float = 1e-4, rounds: int = 60, tol: float = 1e-4) -> np.ndarray:
    """Coefficients (d + 1, labels), the last row intercepts. ``labels``: array of 0, 1 or null for not known; rows without features or labels are left out."""
    unknown = F.transform(labels, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    rows = df.where(f"size({features}) > 0 AND size({labels}) > 0").select(F.col(features).cast("array<double>").alias("x"), unknown.alias("t"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).persist()
    try:
        one = rows.select(F.size("x"), F.size("t")).first()
        if one is None:
            raise ValueError("there are no rows")
        flat, _, _ = minimised(_loss(rows, tuple(one), penalty), np.zeros((one[0] + 1) * one[1]), rounds, tol)
    finally:
        rows.unpersist()
    return flat.reshape(one[0] + 1, one[1])


def scored(df: DataFrame, features: str, coef: np.ndarray) -> DataFrame:
    """Adds ``logits``, which ``numeric.head_labels`` and ``head_class`` decode; null without features."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(features)

    def run(batches):
        for batch in batches:
            known = np.flatnonzero(batch.column(at).is_valid().to_numpy(zero_copy_only=False))
            z = np.full((batch.num_rows, coef.shape[1]), np.nan)
            if len(known):
                z[known] = matrix(batch.column(at).take(pa.array(known))) @ coef[:-1] + coef[-1]
            there = set(known.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tolist() if k in there else None for k, row in enumerate(z)], pa.list_(pa.float64()))], [*batch.schema.names, "logits"])

    return df.mapInArrow(run, f"{kinds}, logits array<double>")
