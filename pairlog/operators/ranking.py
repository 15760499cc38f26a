"""Positions, ranks and top lists without sorting a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import as_col


def bucketed_row_number(df: DataFrame, bucket: Column, order: Sequence[Column | str],
                        partition: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """0-based position of each row in ``order`` within ``partition``.

    ``bucket`` must grow with ``order`` (a coarse version of its first key). Rows are
    numbered within (partition, bucket); the start of each bucket is the running sum of
    bucket sizes, worked out on one row per bucket. So the largest sort is one bucket,
    not one partition, and a partition which holds most rows is still spread. Rows with NULL
    keys are numbered like all others: NULL is a partition, and the first bucket.
    """
    # the keys as one struct, which is never NULL itself and equals another one with the same NULLs
    keyed = df.withColumn("_key", F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(partition)], bucket.alias("bucket")))
    # The sizes ask for whole rows, so that both branches read one and the same exchange below and the
    # source is scanned once; a branch pruned to the keys would be a second scan and shuffle.
    rest = [F.col(f"`{c}`") for c in df.columns]
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(F.lit(1), *rest)).alias("_all")) \
        .where(F.col("_all").isNotNull()).drop("_all")
    before = W.partitionBy(*[F.col(f"_key.p{i}") for i in range(len(partition))]).orderBy("_key.bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = W.partitionBy("_key").orderBy(*[as_col(c) for c in order])
    joined = keyed.join(starts, "_key")
    return joined.withColumn(name, F.col("_start") + F.row_number().over(local) - 1).drop("_key", "_start")


def top_k_with_ties(df: DataFrame, by: str, k: int, partition: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``by`` is among the ``k`` largest of their partition, ties kept.

    The rank filter is pushed under the shuffle by Catalyst (window group limit), so each
    task sends at most the top rows of a partition. Without a partition the k-th value
    is found by a distributed top-k and used as a threshold: no global window.
    """
    if partition:
        rank = F.rank().over(W.partitionBy(*partition).orderBy(F.desc(by)))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    threshold = df.select(by).orderBy(F.desc(by)).limit(k).agg(F.min(by)).scalar()
    return df.where(F.col(by) >= threshold)


def top_k_strict(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """Exactly ``k`` rows at most; ties fall to the smaller ``tie`` value."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def sort_desc(df: DataFrame, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie))


def unfold(df: DataFrame, levels: DataFrame, width: int = 1000) -> DataFrame:
    """Every row of ``df`` with every row of ``levels`` (one column of distinct values), for results that
    are such a table by definition. The levels are packed into arrays of about ``width``, dealt by hash; a
    row is repeated once for each array, meets it by an equi join, and unfolds it. Counts the levels."""
    name = levels.columns[0]
    parts = max(1, -(-levels.count() // width))
    part = F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    packed = levels.groupBy(part.alias("_part")).agg(F.collect_list(F.struct(name)).alias("_levels"))
    rows = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.join(packed, "_part").withColumn("_level", F.explode("_levels")) \
        .select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"_level.{name}").alias(name))


def level_arrays(df: DataFrame, cols: Sequence[str], limit: int) -> DataFrame:
    """The observed distinct values of columns of bounded cardinality, as one row with one
    sorted array per column, from one pass. More than ``limit`` values in all raise at run time."""
    named = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x"))
    few = named.where(F.col("x.v").isNotNull()).select("x.c", "x.v").distinct().limit(limit + 1)
    packed = few.agg(F.count(F.lit(1)).alias("n"), *[
        F.sort_array(F.collect_list(F.when(F.col("c") == c, F.col("v")))).alias(c) for c in cols])
    kind = {c: df.schema[c].dataType.simpleString() for c in cols}
    checked = lambda c: F.when(F.col("n") > limit, F.raise_error(F.lit(f"more than {limit} levels"))).otherwise(
        F.col(c).cast(f"array<{kind[c]}>"))
    return packed.select(*[checked(c).alias(c) for c in cols])
