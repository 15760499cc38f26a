"""Array arithmetic with higher-order functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import as_col


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; NULL when either vector has no length. Norms may be passed in
    when they are already at hand, so that they are not worked out per pair."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.try_divide(dot(a, b), length)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it. Inside
    lambdas Spark shares no common subexpressions, so a bound lambda variable does it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax_tau(arr: Column | str, tau: float = 1.0) -> Column:
    """Softmax of ``arr / tau``, shifted by the maximum so that it cannot overflow."""
    def weights(a):
        return let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp((x - top) / F.lit(float(tau)))))

    def shares(w):
        return let(_total(w), lambda total: F.transform(w, lambda x: x / total))

    return let(as_col(arr), lambda a: let(weights(a), shares))


def argmax(arr: Column | str) -> Column:
    """0-based index of the first largest element."""
    return let(as_col(arr), lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))
