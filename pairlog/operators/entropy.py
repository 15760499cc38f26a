"""Answer entropy per trial, its curves and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalar import log_base
from .interactions import CONDITION, RESPONSE, RUN, TRIAL, response_counts


def entropy_of_counts(counts: DataFrame, keys: Sequence[str], n: str = "n", base: str | float = "e") -> DataFrame:
    """Shannon entropy of count rows: ln N - (Σ c ln c) / N, in units of ``base``.

    Both sums merge, so a trial with any number of answers is combined map-side and there
    is no window. One-answer trials give exactly zero."""
    agg = counts.groupBy(*keys).agg(
        F.sum(n).alias("N"), F.max(n).alias("top"),
        F.sum(F.col(n) * log_base(F.col(n), base)).alias("s"))
    h = F.when(F.col("top") == F.col("N"), F.lit(0.0)).otherwise(log_base(F.col("N"), base) - F.col("s") / F.col("N"))
    return agg.select(*keys, F.col("N").alias("respondents"), h.alias("entropy"))


def trial_profile(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL), base: str | float = 2) -> DataFrame:
    """Entropy and dominant answer of each trial from the same two aggregates: the log is
    counted once, and both come out of the counts. Missing answers are left out."""
    counts = response_counts(df, keys).withColumn("_best", F.struct((-F.col("n")).alias("neg"), F.col(RESPONSE).alias("r")))
    agg = counts.groupBy(*keys).agg(
        F.sum("n").alias("N"), F.min("_best").alias("b"),
        F.sum(F.col("n") * log_base(F.col("n"), base)).alias("s"))
    top = -F.col("b.neg")
    h = F.when(top == F.col("N"), F.lit(0.0)).otherwise(log_base(F.col("N"), base) - F.col("s") / F.col("N"))
    return agg.select(*keys, h.alias("entropy"), F.col("b.r").alias("DomResponse"), top.alias("DomResponseCount"),
                      (top / F.col("N")).alias("DomResponseProp"))


def trial_entropy(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL), base: str | float = "e") -> DataFrame:
    """Entropy of a trial's answers; missing answers are left out of the counts."""
    return entropy_of_counts(response_counts(df, keys), keys, base=base)


def normalized_entropy(entropy: DataFrame, sizes: DataFrame) -> DataFrame:
    """Base-2 entropy over its maximum log2(network size)."""
    return entropy.join(sizes, RUN).withColumn(
        "normalized", F.try_divide(F.col("entropy"), F.log2(F.col("Size").cast("double"))))


def condition_mean_curve(df: DataFrame, value: str = "normalized",
                         keys: Sequence[str] = (*CONDITION, TRIAL)) -> DataFrame:
    """Mean of the per-run curves, each run weighing the same."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))


def condition_rollup(df: DataFrame, value: str, dims: Sequence[str] = ("Content", "Structure", "Size"),
                     keep: Sequence[str] = (TRIAL,)) -> DataFrame:
    """The same mean at every grain of a hierarchy, from one aggregation. ``grain`` counts
    the dimensions which are rolled up (0 is the finest)."""
    sets = [[*keep, *dims[:i]] for i in range(len(dims), -1, -1)]
    grain = sum((F.grouping(d).cast("int") for d in dims), F.lit(0))
    return df.groupingSets(sets, *keep, *dims).agg(
        grain.alias("grain"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def diff_successive(df: DataFrame, value: str = "entropy", name: str = "delta") -> DataFrame:
    """Change from the run's previous trial."""
    w = W.partitionBy(RUN).orderBy(TRIAL)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def entropy_delta_mean(df: DataFrame, value: str = "entropy", keys: Sequence[str] = (TRIAL,)) -> DataFrame:
    """Mean over runs of the successive differences."""
    return (diff_successive(df, value).where(F.col("delta").isNotNull())
            .groupBy(*keys).agg(F.avg("delta").alias("mean_delta")))


def entropy_shift(df: DataFrame, value: str = "entropy") -> DataFrame:
    """Entropy less the entropy of the run's first trial."""
    w = W.partitionBy(RUN).orderBy(TRIAL).rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.first(value).over(w)
    return df.withColumn("StartingEntropy", start).withColumn("EntropyDifference", F.col(value) - F.col("StartingEntropy"))


def linear_trend(df: DataFrame, value: str = "entropy", keys: Sequence[str] = (RUN,)) -> DataFrame:
    """Least-squares line of a value on the trial number."""
    y, x = F.col(value), F.col(TRIAL).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
