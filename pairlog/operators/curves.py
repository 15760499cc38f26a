"""Distances between curves and the choice of a sweep value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

CONDITION = ("Structure", "Content")


def curve_distance(curves: DataFrame, target: DataFrame, curve: Sequence[str], condition: Sequence[str],
                   point: str = "TrialNumber") -> DataFrame:
    """L2 norm of each curve's ``value`` against its condition's ``target``. A point which the
    curve lacks counts as zero, so a curve missing altogether lies at its target's norm."""
    names = [*curve, *condition]
    wanted = curves.select(*names).distinct().join(target, list(condition))
    both = wanted.join(curves.select(*names, point, "value"), [*names, point], "left")
    d = F.col("target") - F.coalesce(F.col("value"), F.lit(0.0))
    return both.groupBy(*names).agg(F.sqrt(F.sum(d * d)).alias("distance"))


def sweep_summary(distances: DataFrame, keys: Sequence[str] = (*CONDITION, "alpha")) -> DataFrame:
    """Mean distance per sweep value, pooled over runs."""
    return distances.groupBy(*keys).agg(F.avg("distance").alias("distance"))


def normalised_sweep(summary: DataFrame) -> DataFrame:
    """Per condition over its maximum, mean over structures, over the maximum again. Works on
    the sweep table: one row per condition and grid value."""
    own = F.col("distance") / F.max("distance").over(W.partitionBy(*CONDITION))
    mean = (summary.withColumn("_x", own).groupBy("Content", "alpha").agg(F.avg("_x").alias("_x")))
    return mean.select("Content", "alpha", (F.col("_x") / F.max("_x").over(W.partitionBy("Content"))).alias("normalized"))


def select_alpha(summary: DataFrame) -> DataFrame:
    """Sweep value of the smallest normalised distance per content; ties to the smaller."""
    n = normalised_sweep(summary).withColumn("normalized", F.round("normalized", 9))
    best = n.groupBy("Content").agg(F.min(F.struct("normalized", "alpha")).alias("b"))
    return best.select("Content", F.col("b.alpha").alias("alpha"), F.col("b.normalized").alias("normalized"))


def model_comparison_table(long: DataFrame, models: Sequence[str], structures: Sequence[str],
                           contents: Sequence[str]) -> DataFrame:
    """Mean curves side by side, one column per "Model Structure Content"."""
    names = [f"{m} {s} {c}" for c in contents for s in structures for m in models]
    label = F.concat_ws(" ", "Model", "Structure", "Content")
    return (long.withColumn("_label", label).groupBy(F.col("TrialNumber").alias("Trial"))
            .pivot("_label", names).agg(F.avg("value")))


def difference_curves(long: DataFrame, reference: str) -> DataFrame:
    """|reference - model| per trial and condition. A cell holds one row per model, and each
    picks up the reference of its own cell, so that the curves are worked out once."""
    ref = F.max(F.when(F.col("Model") == reference, F.col("Entropy"))).over(
        W.partitionBy("Trial", "Structure", "Content"))
    gaps = long.withColumn("gap", F.abs(ref - F.col("Entropy")))
    return (gaps.where((F.col("Model") != reference) & F.col("gap").isNotNull())
            .select("Trial", "Model", "Structure", "Content", "gap"))


def mean_abs_gap(differences: DataFrame) -> DataFrame:
    g = F.col("gap")
    return differences.groupBy("Model", "Structure", "Content").agg(
        F.avg(g).alias("mean_gap"), F.sqrt(F.sum(g * g)).alias("l2_gap"))
