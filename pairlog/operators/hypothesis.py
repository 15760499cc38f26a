"""Tests from mergeable sufficient statistics and closed-form p values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import significance_stars
from ..functions.special import beta_quantile, binomial_half_p, student_t_p, student_t_quantile
from .claims import CONDITION, relation_filter


def sem(value: Column | str) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def _t_columns(df: DataFrame, n: Column, mean: Column, sd: Column) -> DataFrame:
    """estimate, statistic, parameter and p_value; NULL where there is no spread or n < 2."""
    usable = F.when((n > 1) & (sd > 0), sd)
    return (df.withColumn("estimate", mean)
            .withColumn("_se", usable / F.sqrt(n))
            .withColumn("statistic", F.col("estimate") / F.col("_se"))
            .withColumn("parameter", F.when(F.col("_se").isNotNull(), (n - 1).cast("double")))
            .withColumn("p_value", student_t_p("statistic", "parameter")))


def t_test_one_sample(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean of each group against zero."""
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    out = _t_columns(m, F.col("n"), F.col("_mean"), F.col("_sd"))
    return out.select(*keys, "n", "estimate", "statistic", "parameter", "p_value")


def t_test_from_sums(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from n, sx and sxx of integers, whose sums are exact."""
    n = F.col("n")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    spread = (wide("n") * wide("sxx") - wide("sx") * wide("sx")).cast("double")
    sd = F.sqrt(spread / F.when(n > 1, n.cast("double") * (n - 1)))
    df = moments.withColumn("_sd", sd)
    out = _t_columns(df, n, F.col("sx") / n, F.col("_sd"))
    return out.select(*keys, "n", "estimate", "statistic", "parameter", "p_value", "_se")


def with_t_interval(tested: DataFrame, level: float = 0.95) -> DataFrame:
    q = student_t_quantile(F.lit(0.5 + level / 2), F.col("parameter"))
    return (tested.withColumn("_q", q)
            .withColumn("conf_low", F.col("estimate") - F.col("_q") * F.col("_se"))
            .withColumn("conf_high", F.col("estimate") + F.col("_q") * F.col("_se"))
            .drop("_q", "_se"))


def t_test_ci(moments: DataFrame, keys: Sequence[str] = (*CONDITION, "cause_topic", "effect_topic")) -> DataFrame:
    return with_t_interval(t_test_from_sums(moments, keys))


def welch_t_test(df: DataFrame, value: str, side: str, left: str, right: str, keys: Sequence[str]) -> DataFrame:
    """Unequal-variance t test of two sides within each group."""
    aggs = []
    for name, level in (("1", left), ("2", right)):
        x = F.when(F.col(side) == level, F.col(value))
        aggs += [F.count(x).alias(f"n{name}"), F.avg(x).alias(f"m{name}"), F.var_samp(x).alias(f"v{name}")]
    m = df.groupBy(*keys).agg(*aggs)
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (e1 + e2 > 0)
    out = (m.withColumn("statistic", F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)))
           .withColumn("parameter", F.when(ok, (e1 + e2) * (e1 + e2)
                                           / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))))
           .withColumn("p_value", student_t_p("statistic", "parameter")))
    return out.select(*keys, "n1", "n2", "m1", "m2", "statistic", "parameter", "p_value",
                      significance_stars("p_value").alias("stars"))


def binom_test_exact(df: DataFrame, positive: str = "unique_positive_count", negative: str = "unique_negative_count",
                     level: float = 0.95) -> DataFrame:
    """Exact two-sided test of equal shares, with the Clopper-Pearson interval; NULL for
    no trials."""
    k, n = F.col(positive), F.col(positive) + F.col(negative)
    tail = (1 - level) / 2
    some = n > 0
    low = F.when(some & (k == 0), F.lit(0.0)).otherwise(
        beta_quantile(F.lit(tail), F.when(some & (k > 0), k).cast("double"), (n - k + 1).cast("double")))
    high = F.when(some & (k == n), F.lit(1.0)).otherwise(
        beta_quantile(F.lit(1 - tail), (k + 1).cast("double"), F.when(some & (k < n), n - k).cast("double")))
    return (df.withColumn("p_value", binomial_half_p(k, n))
            .withColumn("estimate", F.when(some, k / n))
            .withColumn("conf_int_low", low).withColumn("conf_int_high", high))


def bh_adjust(df: DataFrame, p: str = "p_value", family: Sequence[str] = CONDITION, name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within a family of tests (a family is a list of hypotheses, not
    of observations). Rows without a p value take no part."""
    order = W.partitionBy(*family).orderBy(p)
    n = F.count(p).over(W.partitionBy(*family))
    ranked = df.where(F.col(p).isNotNull()).withColumn("_raw", F.col(p) * n / F.row_number().over(order))
    above = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(above))).drop("_raw")


def fdr_by_condition(tests: DataFrame) -> DataFrame:
    """The modelled relations, those without a p value dropped, adjusted per condition."""
    modelled = tests.where(relation_filter()).where(F.col("p_value").isNotNull())
    return bh_adjust(modelled)


def significant(tests: DataFrame, p: str = "p_value", level: float = 0.05) -> DataFrame:
    return tests.where(F.col(p) < level)
