"""Gamma functions as columns, and tail probabilities and quantiles of the beta family.

The incomplete beta function is an integral over an angle, x = sin²: its integrand has no peak at the borders and falls
from the given x on, so that a fixed double-exponential rule over as much of it as counts gives about eleven digits
for parameters of any size, up to 1e15; where terms would cancel, their difference is written out. As an expression
of the JVM the rule makes plans that take seconds to optimise, so that it is an Arrow UDF: vectorised over a batch,
and only ever on aggregated rows (one per test), never on the log itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .scalar import as_col

_SHIFT = 10


def digamma(x: Column) -> Column:
    """Derivative of the log gamma function for x > 0: ten steps of the recurrence, then the asymptotic series."""
    z = x + _SHIFT
    r = 1 / (z * z)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760 - r / 12))))))
    return F.log(z) - 0.5 / z - series - sum((1 / (x + i) for i in range(_SHIFT)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    """Derivative of ``digamma`` for x > 0."""
    z = x + _SHIFT
    r = 1 / (z * z)
    series = (1 + r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66 - r * (691 / 2730 - r * 7 / 6))))))) / z
    return series + 0.5 * r + sum((1 / ((x + i) * (x + i)) for i in range(_SHIFT)), F.lit(0.0))


def stirling_rest(x: Column) -> Column:
    """log Γ(x) less (x - 1/2) log x - x + log(2π)/2, for x of ten or more."""
    r = 1 / (x * x)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * (691 / 360360 - r / 156)))))) / x


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for x > 0."""
    z = x + _SHIFT
    product = math.prod(((x + i) for i in range(1, _SHIFT)), start=x)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + stirling_rest(z) - F.log(product)


def _rule(step: float = 0.09, reach: float = 3.3) -> tuple[np.ndarray, np.ndarray]:
    """Places in (0, 1) and weights of the double-exponential rule."""
    t = np.arange(-int(reach / step), int(reach / step) + 1) * step
    q = np.exp(-np.pi * np.sinh(t))
    weights = step * np.pi * np.cosh(t) * q / (1 + q) ** 2
    kept = weights > 1e-18
    return (1 / (1 + q))[kept], weights[kept]


_PLACES, _WEIGHTS = _rule()
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _rest_np(x: np.ndarray) -> np.ndarray:
    """``stirling_rest``."""
    r = 1 / (x * x)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * (691 / 360360 - r / 156)))))) / x


def _log_excess(x: np.ndarray) -> np.ndarray:
    """x - log(1 + x), without cancellation near zero."""
    series = np.full_like(x, 1 / 12)
    for k in range(11, 1, -1):
        series = 1 / k - x * series
    return np.where(np.abs(x) < 0.03, x * x * series, x - np.log1p(np.maximum(x, -1 + 1e-300)))


def _log_power(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log of x^a y^b / B(a, b), where y = 1 - x."""
    p, q = np.minimum(a, b), np.maximum(a, b)
    off = np.where(x <= 0.5, a - (a + b) * x, (a + b) * y - b)  # how far x is from the mean
    both = (0.5 * np.log(a / (a + b) * b / (2 * math.pi)) - a * _log_excess(-off / a) - b * _log_excess(off / b)
            - (_rest_np(a) + _rest_np(b) - _rest_np(a + b)))
    small = _lgamma(np.minimum(p, 10.0))
    one = small + _rest_np(q) - _rest_np(p + q) + p - p * np.log(p + q) + (q - 0.5) * np.log1p(-p / (p + q))
    few = np.minimum(q, 10.0)
    none = small + _lgamma(few) - _lgamma(np.minimum(p, 10.0) + few)
    log_x = np.where(x < 0.5, np.log(x), np.log1p(-np.minimum(y, 1 - 1e-16)))
    log_y = np.where(y < 0.5, np.log(y), np.log1p(-np.minimum(x, 1 - 1e-16)))
    return np.where(p >= 10, both, a * log_x + b * log_y - np.where(q >= 10, one, none))


def _tail(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I_x(a, b) for x below the mean a / (a + b)."""
    power_x, power_y, cot, tan = 2 * a - 1, 2 * b - 1, np.sqrt(y / x), np.sqrt(x / y)
    slope = np.maximum(power_x * cot - power_y * tan, 1e-300)
    bend = np.maximum(np.abs(power_x) / x + np.abs(power_y) / y, 1e-300)
    reach = np.minimum(np.arctan2(np.sqrt(x), np.sqrt(y)), np.minimum(45 / slope, np.sqrt(90 / bend)))
    s = reach[:, None] * _PLACES
    fall, sine = 2 * np.sin(s / 2) ** 2, np.sin(s)
    down = np.log1p(np.maximum(-fall - cot[:, None] * sine, -1 + 1e-15))
    up = np.log1p(tan[:, None] * sine - fall)
    area = np.exp(power_x[:, None] * down + power_y[:, None] * up) @ _WEIGHTS
    return 2 * np.exp(_log_power(a, b, x, y) - 0.5 * (np.log(x) + np.log(y))) * reach * area


def _beta_inc_np(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    lower = np.where(x < 0.5, x * (a + b) <= a, y * (a + b) >= b)
    inner = (x > 0) & (y > 0)
    with np.errstate(all="ignore"):
        part = _tail(np.where(lower, a, b), np.where(lower, b, a), np.where(inner, np.where(lower, x, y), 0.5), np.where(inner, np.where(lower, y, x), 0.5))
    return np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, np.where(lower, part, 1 - part)))


def _beta_quantile_np(prob: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Newton steps for log I by the log odds of x, where it is concave, so that they close in from one side; above
    one half, by the other tail."""
    turned = prob > 0.5
    p, q, share = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - prob, prob)
    odds = np.log(p / q)
    with np.errstate(all="ignore"):
        for _ in range(40):
            x, y = 1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(odds))
            value = np.maximum(_beta_inc_np(p, q, x, y), 1e-300)
            step = (np.log(share) - np.log(value)) * value / np.exp(_log_power(p, q, x, y))
            odds = odds + np.nan_to_num(step, nan=0.0, posinf=1.0, neginf=-1.0)
            if np.abs(step).max(initial=0.0) < 1e-13:
                break
    return np.where(turned, 1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds)))


def _where_valid(fn, *inputs: pd.Series) -> pd.Series:
    """Apply ``fn`` to the rows without a NULL; the others give NULL."""
    values = np.column_stack([x.to_numpy("float64", na_value=np.nan) for x in inputs])
    ok = ~np.isnan(values).any(axis=1)
    out = np.full(len(values), None, dtype=object)
    if ok.any():
        out[ok] = fn(*values[ok].T)
    return pd.Series(out)


@pandas_udf(DoubleType())
def _beta_inc(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return _where_valid(_beta_inc_np, a, b, x, y)


def beta_inc(a: Column, b: Column, x: Column, y: Column | None = None) -> Column:
    """Regularised incomplete beta I_x(a, b) for a, b of one half or more; NULL in, NULL out. ``y`` is 1 - x, where that
    is known more closely than by subtraction."""
    return _beta_inc(a.cast("double"), b.cast("double"), x.cast("double"), (1 - x if y is None else y).cast("double"))


@pandas_udf(DoubleType())
def beta_quantile(prob: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """x with I_x(a, b) = prob; NULL in, NULL out."""
    return _where_valid(_beta_quantile_np, prob, a, b)


@pandas_udf(DoubleType())
def _t_quantile(prob: pd.Series, df: pd.Series) -> pd.Series:
    def solve(prob: np.ndarray, df: np.ndarray) -> np.ndarray:
        # the two-sided tail is convex, so that steps from below its root stay below
        tail, half = 2 * (1 - prob), np.full_like(df, 0.5)
        t = np.ones_like(df)
        with np.errstate(all="ignore"):
            for _ in range(200):
                x, y = df / (df + t * t), t * t / (df + t * t)
                step = (_beta_inc_np(df / 2, half, x, y) - tail) * t / (2 * np.exp(_log_power(df / 2, half, x, y)))
                t = np.maximum(t + step, t / 2)
                if np.all(np.abs(step) <= 1e-13 * t):
                    break
        return t
    return _where_valid(solve, prob, df)


def student_t_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided p value of Student's t, df of one or more."""
    t, df = as_col(t).cast("double"), as_col(df).cast("double")
    return beta_inc(df / 2.0, F.lit(0.5), df / (df + t * t), t * t / (df + t * t))


def binomial_half_p(successes: Column | str, total: Column | str) -> Column:
    """Exact two-sided binomial p value against one half; NULL when total is 0."""
    k, n = as_col(successes), as_col(total)
    low = F.least(k, n - k)
    # Spark hands every row to the function, whatever surrounds it
    tail = beta_inc(F.when(n > 0, n - low), low + 1, F.lit(0.5), F.lit(0.5))
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * tail))


def student_t_quantile(prob: Column, df: Column) -> Column:
    """Quantile of Student's t for prob above one half, df of one or more."""
    return _t_quantile(prob, df.cast("double"))
