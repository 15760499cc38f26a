"""Connected components of an edge table, by alternating stars; every round is written, so that no round
recomputes the ones before it and a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import truncate_lineage


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (any comparable type). Returns node, root: the smallest node of its component.

    Large star: every node hands its larger neighbours to the smallest node near it; small star: the same
    for the smaller ones. A node's minimum is a mergeable aggregate and comes back by an equi join, so a
    node with very many neighbours is not gathered. Stops when nothing changes (a count and a hash sum).
    """
    now = truncate_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours all point to the smallest of them
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(low, "a")
        now = truncate_lineage(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                               .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    # a star forest now: leaves point to roots
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
