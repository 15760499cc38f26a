"""Newton fits of penalised likelihoods on counted covariate patterns.

A pass sums the log likelihood, its gradient and its Hessian over the patterns: every task over its own, in numpy, so that
one short row of sums for each partition comes to the driver, which adds them and solves for the step. The
parameters are the intercept at the mean of the covariates, one slope for each covariate, and what else a family
needs. Priors are normal: ``sd`` on slopes, ``intercept_sd`` on that intercept, as usual for models written
with centred covariates; the intercept is given back for covariates of zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship

MAX_STEPS = 60
TOLERANCE = 1e-10
LOG_RANGE = 25.0  # of parameters on the log scale: a deviation of nothing, as of data without noise, ends there


class Prior(NamedTuple):
    slope_sd: float
    intercept_sd: float = 10.0


class Fit(NamedTuple):
    intercept: np.ndarray  # for covariates of zero, one for each linear predictor
    slopes: np.ndarray  # predictors x covariates
    extra: dict[str, float]
    means: np.ndarray  # of the covariates: where the prior holds the intercept
    value: float  # of the penalised log likelihood
    steps: int


# -- families: log likelihood, gradient and Hessian of each row -------------------------------------------
class Terms(NamedTuple):
    """Of the patterns: their log likelihood, the derivatives by each linear predictor and each extra parameter (in
    that order), and the second derivatives (i, j), i <= j."""
    value: np.ndarray
    first: list[np.ndarray]
    second: dict[tuple[int, int], np.ndarray]


def bernoulli(eta: np.ndarray, y: np.ndarray, extra: dict[str, float]) -> Terms:
    e = eta[:, 0]
    p = 1 / (1 + np.exp(-e))
    return Terms(y * e - np.logaddexp(0, e), [y - p], {(0, 0): -p * (1 - p)})


def gaussian(eta: np.ndarray, y: np.ndarray, extra: dict[str, float]) -> Terms:
    """With the standard deviation as a parameter, on the log scale."""
    log_sd = extra["log_sigma"]
    r, v = y - eta[:, 0], math.exp(-2 * log_sd)
    return Terms(-log_sd - 0.5 * math.log(2 * math.pi) - 0.5 * v * r * r, [v * r, v * r * r - 1.0],
                 {(0, 0): np.full_like(r, -v), (0, 1): -2 * v * r, (1, 1): -2 * v * r * r})


def beta(eta: np.ndarray, y: np.ndarray, extra: dict[str, float]) -> Terms:
    """Beta(mu phi, (1 - mu) phi), mu by a logit, phi on the log scale. Expected second derivatives, so
    that every step is uphill."""
    phi, mu = math.exp(extra["log_phi"]), 1 / (1 + np.exp(-eta[:, 0]))
    a, b, slope = mu * phi, (1 - mu) * phi, mu * (1 - mu)
    log_y, log_z = np.log(y), np.log1p(-y)
    value = math.lgamma(phi) - _lgamma(a) - _lgamma(b) + (a - 1) * log_y + (b - 1) * log_z
    da, db, ta, tb = _digamma(a), _digamma(b), _trigamma(a), _trigamma(b)
    by_phi = _digamma(phi) + mu * (log_y - da) + (1 - mu) * (log_z - db)
    return Terms(value, [phi * (log_y - log_z - da + db) * slope, phi * by_phi],
                 {(0, 0): -phi * phi * (ta + tb) * slope * slope, (0, 1): -phi * phi * (ta * mu - tb * (1 - mu)) * slope,
                  (1, 1): -phi * phi * (ta * mu * mu + tb * (1 - mu) * (1 - mu) - _trigamma(phi))})


def categorical(eta: np.ndarray, y: np.ndarray, extra: dict[str, float]) -> Terms:
    """Class 0 is the reference; predictor i belongs to class i + 1."""
    k = eta.shape[1]
    top = np.maximum(0.0, eta.max(axis=1))
    weights = np.exp(eta - top[:, None])
    total = weights.sum(axis=1) + np.exp(-top)
    p, is_ = weights / total[:, None], y[:, None] == np.arange(1, k + 1)
    second = {(i, j): -p[:, i] * ((1.0 if i == j else 0.0) - p[:, j]) for i in range(k) for j in range(i, k)}
    return Terms((is_ * eta).sum(axis=1) - top - np.log(total), list((is_ - p).T), second)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _digamma(x):
    """Ten steps of the recurrence, then the asymptotic series."""
    z = x + 10
    r = 1 / (z * z)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760 - r / 12))))))
    return np.log(z) - 0.5 / z - series - sum(1 / (x + i) for i in range(10))


def _trigamma(x):
    z = x + 10
    r = 1 / (z * z)
    series = (1 + r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66 - r * (691 / 2730 - r * 7 / 6))))))) / z
    return series + 0.5 * r + sum(1 / ((x + i) * (x + i)) for i in range(10))


class Extra(NamedTuple):
    """A parameter beside the predictors, on the log scale: where it starts, and its log prior density (of the
    parameter itself) with two derivatives by its log."""
    start: float
    prior: object


def gamma_prior(shape: float, rate: float):
    """Log density of gamma(shape, rate) at exp(t), up to a constant, and its derivatives by t."""
    return lambda t: ((shape - 1) * t - rate * math.exp(t), (shape - 1) - rate * math.exp(t), -rate * math.exp(t))


def half_cauchy_prior(scale: float):
    def at(t: float) -> tuple[float, float, float]:
        q = (math.exp(t) / scale) ** 2
        return -math.log1p(q), -2 * q / (1 + q), -4 * q / (1 + q) ** 2
    return at


# -- the solver -----------------------------------------------------------------------------------------
def covariate_means(patterns: DataFrame, xs: Sequence[str]) -> tuple[float, np.ndarray]:
    """Rows in all, and the means of the covariates over them."""
    r = patterns.agg(F.sum("weight"), *[F.sum(F.col(x) * F.col("weight")) for x in xs]).first()
    n = float(r[0] or 0)
    return n, np.array([float(v or 0) / n if n else 0.0 for v in r[1:]])


def derivatives(patterns: DataFrame, xs: Sequence[str], family, theta: np.ndarray, means: np.ndarray,
                extra: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and Hessian by all parameters, from one pass."""
    k, p, size = len(theta), len(xs) + 1, theta.size + len(extra)
    xs = list(xs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + size + size * size)
        for batch in batches:
            column = lambda c: batch[c].to_numpy(zero_copy_only=False).astype(float)
            design = np.column_stack([np.ones(batch.num_rows), *[column(x) - m for x, m in zip(xs, means)]])
            w, t = column("weight"), family(design @ theta.T, column("label"), extra)
            parts = [design] * k + [np.ones((batch.num_rows, 1))] * len(extra)  # what a linear predictor or parameter is multiplied by
            start = np.cumsum([0, *[d.shape[1] for d in parts]])
            gradient, hessian = np.zeros(size), np.zeros((size, size))
            for i, d in enumerate(parts):
                gradient[start[i]:start[i + 1]] = (w * t.first[i]) @ d
            for (i, j), h in t.second.items():
                block = (parts[i] * (w * h)[:, None]).T @ parts[j]
                hessian[start[i]:start[i + 1], start[j]:start[j + 1]] = block
                hessian[start[j]:start[j + 1], start[i]:start[i + 1]] = block.T
            sums += np.concatenate([[w @ t.value], gradient, hessian.ravel()])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    found = patterns.select(*xs, "label", "weight").mapInArrow(work, "sums array<double>").collect()  # a row for each partition
    total = np.sum([r["sums"] for r in found], axis=0) if found else np.zeros(1 + size + size * size)
    hessian = total[1 + size:].reshape(size, size)
    return float(total[0]), total[1:1 + size], (hessian + hessian.T) / 2


def fit(patterns: DataFrame, xs: Sequence[str], family, prior: Prior, predictors: int = 1,
        extra: dict[str, Extra] | None = None) -> Fit:
    """The mode of the penalised likelihood. ``patterns`` has the covariates ``xs``, ``label`` and ``weight``, and is
    read once for each step."""
    ship(patterns.sparkSession)
    extra = extra or {}
    n, means = covariate_means(patterns, xs)
    k, p = predictors, len(xs) + 1
    theta = np.zeros(k * p + len(extra))
    theta[k * p:] = [e.start for e in extra.values()]
    if not n:
        return Fit(np.zeros(k), np.zeros((k, p - 1)), {name: math.exp(e.start) for name, e in extra.items()}, means, 0.0, 0)
    ridge = np.concatenate([np.tile([prior.intercept_sd ** -2, *[prior.slope_sd ** -2] * (p - 1)], k), np.zeros(len(extra))])

    def at(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, g, h = derivatives(patterns, xs, family, t[:k * p].reshape(k, p), means, dict(zip(extra, t[k * p:])))
        value, g, h = value - 0.5 * float(ridge @ (t * t)), g - ridge * t, h - np.diag(ridge)
        for i, e in enumerate(extra.values(), start=k * p):
            v, first, second = e.prior(float(t[i]))
            value, g[i], h[i, i] = value + v, g[i] + first, h[i, i] + min(second, 0.0)
        return value, g, h

    value, gradient, hessian = at(theta)
    steps = 0
    while steps < MAX_STEPS:
        # a Hessian that is not negative definite, far from the mode, is bent until the step is uphill
        unit = np.sqrt(np.maximum(np.abs(np.diag(hessian)), 1e-300))  # parameters on one scale
        size, vectors = np.linalg.eigh(-hessian / unit / unit[:, None])
        step = vectors @ ((vectors.T @ (gradient / unit)) / np.maximum(np.abs(size), 1e-10)) / unit
        step[k * p:] = np.clip(step[k * p:], -3.0, 3.0)
        steps += 1
        scale = 1.0
        while True:
            trial = theta + scale * step
            trial[k * p:] = np.clip(trial[k * p:], -LOG_RANGE, LOG_RANGE)
            new = at(trial)
            if new[0] >= value - 1e-12 * abs(value) or scale < 1e-3:
                break
            scale /= 2
        if new[0] < value - 1e-12 * abs(value):
            break  # as near as the numbers allow
        moved = np.abs(trial - theta).max()
        theta, (value, gradient, hessian) = trial, new
        if moved <= TOLERANCE * (1 + np.abs(theta).max()):
            break
    b = theta[:k * p].reshape(k, p)
    return Fit(b[:, 0] - b[:, 1:] @ means, b[:, 1:], {name: math.exp(v) for name, v in zip(extra, theta[k * p:])}, means, value, steps)
