"""Dirichlet-process mixtures of Gaussians in many dimensions, by variational passes over the rows.

Weights are broken off a stick, means and precisions have normal-Wishart posteriors. A pass reduces each partition
to sufficient statistics (masses, sums, outer products, the entropy of the responsibilities), so only the
posteriors' parameters are on the driver. The lower bound is computed in full and must not fall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ._sums import matrix, totals
from .clustering import STARTS, digamma, starts


class Posterior(NamedTuple):
    """Of each component: stick (a, b), mean ``m`` with strength ``kappa``, degrees ``nu``, inverse scale ``inverse`` (d x d)."""

    a: np.ndarray
    b: np.ndarray
    m: np.ndarray
    kappa: np.ndarray
    nu: np.ndarray
    inverse: np.ndarray
    bound: float = -np.inf
    rounds: int = 0
    settled: bool = False

    def weights(self) -> np.ndarray:
        """Expected share of each component."""
        v = self.a / (self.a + self.b)
        return v * np.r_[1, np.cumprod(1 - v)[:-1]]


def log_gamma(z: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(z)


def _log_wishart(logdet_inverse: np.ndarray, nu: np.ndarray, d: int) -> np.ndarray:
    """Log of the normalising factor of Wishart densities with these inverse scales."""
    return 0.5 * nu * logdet_inverse - (0.5 * nu * d * math.log(2) + 0.25 * d * (d - 1) * math.log(math.pi) + sum(log_gamma(0.5 * (nu - i)) for i in range(d)))


def _log_det(nu: np.ndarray, logdet_inverse: np.ndarray, d: int) -> np.ndarray:
    """Expected log determinant of the precision."""
    return sum(digamma(0.5 * (nu - i)) for i in range(d)) + d * math.log(2) - logdet_inverse


def responsibilities(x: np.ndarray, p: Posterior) -> tuple[np.ndarray, np.ndarray]:
    """Share of each component in each row, and the rows' entropies of them."""
    d = x.shape[1]
    roots = np.linalg.cholesky(p.inverse)
    logdet = 2 * np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)
    stick, rest = digamma(p.a) - digamma(p.a + p.b), digamma(p.b) - digamma(p.a + p.b)
    far = np.stack([nu * (np.linalg.solve(root, (x - m).T) ** 2).sum(axis=0) for nu, root, m in zip(p.nu, roots, p.m, strict=True)], axis=1)
    log_r = stick + np.r_[0, np.cumsum(rest)[:-1]] + 0.5 * (_log_det(p.nu, logdet, d) - d / p.kappa - d * math.log(2 * math.pi) - far)
    log_r -= log_r.max(axis=1, keepdims=True)
    r = np.exp(log_r)
    r /= r.sum(axis=1, keepdims=True)
    return r, -(r * np.log(np.maximum(r, 1e-300))).sum(axis=1)


def _updated(mass: np.ndarray, first: np.ndarray, second: np.ndarray, prior: Posterior, concentration: float) -> Posterior:
    """Posteriors from the sufficient statistics; sticks are broken in the order of the components."""
    m0, k0, nu0, w0 = prior.m[0], prior.kappa[0], prior.nu[0], prior.inverse[0]
    kappa = k0 + mass
    m = (k0 * m0 + first) / kappa[:, None]
    inverse = w0 + second + k0 * np.outer(m0, m0) - kappa[:, None, None] * m[:, :, None] * m[:, None, :]
    inverse = 0.5 * (inverse + inverse.transpose(0, 2, 1))
    return Posterior(1 + mass, concentration + np.r_[np.cumsum(mass[::-1])[::-1][1:], 0], m, kappa, nu0 + mass, inverse)


def _bound(mass: np.ndarray, first: np.ndarray, second: np.ndarray, entropy: float, p: Posterior, prior: Posterior, concentration: float) -> float:
    """Evidence lower bound of ``p`` with the responsibilities that the statistics come from."""
    d = p.m.shape[1]
    m0, k0, nu0, w0 = prior.m[0], prior.kappa[0], prior.nu[0], prior.inverse[0]
    scale = np.linalg.inv(p.inverse)
    logdet = np.linalg.slogdet(p.inverse)[1]
    log_det = _log_det(p.nu, logdet, d)
    stick, rest = digamma(p.a) - digamma(p.a + p.b), digamma(p.b) - digamma(p.a + p.b)
    scatter = second - p.m[:, :, None] * first[:, None, :] - first[:, :, None] * p.m[:, None, :] + mass[:, None, None] * p.m[:, :, None] * p.m[:, None, :]
    rows = 0.5 * (mass * (log_det - d / p.kappa - d * math.log(2 * math.pi)) - p.nu * np.einsum("kde,ked->k", scale, scatter))
    sticks = mass * stick + np.r_[np.cumsum(mass[::-1])[::-1][1:], 0] * rest
    beta = lambda a, b: log_gamma(a) + log_gamma(b) - log_gamma(a + b)
    one = np.ones_like(p.a)
    on_sticks = (1 - p.a) * stick + (concentration - p.b) * rest + beta(p.a, p.b) - beta(one, one * concentration)
    off = p.m - m0
    on_means = 0.5 * (d * np.log(k0 / p.kappa) + d - d * k0 / p.kappa - k0 * p.nu * np.einsum("kd,kde,ke->k", off, scale, off))
    prior_norm = _log_wishart(np.full(len(p.nu), np.linalg.slogdet(w0)[1]), np.full(len(p.nu), float(nu0)), d)
    on_scales = prior_norm - _log_wishart(logdet, p.nu, d) + 0.5 * (nu0 - p.nu) * log_det - 0.5 * p.nu * np.einsum("de,ked->k", w0, scale) + 0.5 * p.nu * d
    return float((rows + sticks + on_sticks + on_means + on_scales).sum() + entropy)


def fit(
    df: DataFrame, features: str, k: int = 20, concentration: float | None = None, rounds: int = 500, tol: float = 1e-3, seed: int = 0,
    watch: Callable[[float], None] | None = None,
) -> Posterior:
    """Posterior of at most ``k`` components; ``concentration`` 1 / k if not given. Priors: the rows' mean and covariance, one row's strength.

    Ends when the bound gains less than ``tol`` a row, or after ``rounds`` (then not ``settled``).
    """
    rows, concentration = df.select(F.col(features).alias("x")), concentration or 1 / k
    some = np.array([r[0] for r in rows.orderBy(F.xxhash64("x")).limit(STARTS).collect()])
    if not len(some):
        raise ValueError("there are no rows")
    d = some.shape[1]
    whole = totals(rows, 1 + d + d * d, lambda b: np.concatenate([[len(x := matrix(b.column(0)))], x.sum(axis=0), (x.T @ x).ravel()]))
    n, mean = whole[0], whole[1 : 1 + d] / whole[0]
    cov = whole[1 + d :].reshape(d, d) / n - np.outer(mean, mean) + 1e-6 * np.eye(d)
    prior = Posterior(np.ones(k), np.full(k, concentration), np.tile(mean, (k, 1)), np.ones(k), np.full(k, float(d)), np.tile(cov * d, (k, 1, 1)))
    centres = starts(some, k, np.random.default_rng(seed))
    # begin with each row in its nearest centre's component
    width = k * (1 + d + d * d) + 1

    def summed(share: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        def partial(batch) -> np.ndarray:
            x = matrix(batch.column(0))
            r, entropy = share(x)
            return np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), *[((x * q[:, None]).T @ x).ravel() for q in r.T], [entropy.sum()]])

        s = totals(rows, width, partial)
        return s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d : -1].reshape(k, d, d), float(s[-1])

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
        return np.eye(k)[far.argmin(axis=1)], np.zeros(len(x))

    statistics = summed(nearest)
    now = _updated(*statistics[:3], prior, concentration)
    for done in range(1, rounds + 1):
        order = np.argsort(-(now.nu - prior.nu), kind="stable")  # the heaviest first makes the sticks' bound greatest
        now = Posterior(now.a, now.b, now.m[order], now.kappa[order], now.nu[order], now.inverse[order], now.bound)
        mass = now.nu - prior.nu
        now = now._replace(a=1 + mass, b=concentration + np.r_[np.cumsum(mass[::-1])[::-1][1:], 0])
        mass, first, second, entropy = summed(lambda x: responsibilities(x, now))  # noqa: B023
        new = _updated(mass, first, second, prior, concentration)
        bound = _bound(mass, first, second, entropy, new, prior, concentration)
        settled = bound - now.bound < tol * n
        now = new._replace(bound=bound, rounds=done, settled=settled)
        if watch:
            watch(bound)
        if settled:
            break
    return now


def assigned(df: DataFrame, features: str, p: Posterior) -> DataFrame:
    """Adds ``cluster`` and ``probs``."""
    schema = StructType([*df.schema.fields, StructField("cluster", IntegerType()), StructField("probs", ArrayType(DoubleType()))])

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r, _ = responsibilities(np.stack(pdf[features].to_numpy()), p)
                yield pdf.assign(cluster=r.argmax(axis=1).astype("int32"), probs=list(r))

    return df.mapInPandas(run, schema)
