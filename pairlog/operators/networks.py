"""Random networks, made by switching edges until they are simple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import truncate_lineage
from .ranking import bucketed_row_number
from .reshape import edge_canonical

MAX_STEPS = 200


def _circles(nodes: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """(id, u, v): k / 2 circles, each through all nodes in a hashed order of its own; for odd k every other edge of one
    more. Ids count from 0 without gaps."""
    whole, half = k // 2, k % 2
    seats = nodes.select(F.col("node").cast("bigint").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(whole + half - 1))).alias("slot"))
    h = F.xxhash64(F.col("node"), F.col("slot"), F.lit(seed))
    seated = bucketed_row_number(seats.withColumn("_h", h), F.shiftright("_h", 52), ["_h", "node"], ["slot"])
    # every node is the tail of the edge of its own seat, and the head of the one before
    ends = seated.select("slot", "node", F.explode(F.array(
        F.struct(F.col("pos").alias("seat"), F.lit(True).alias("tail")),
        F.struct(F.pmod(F.col("pos") - 1, F.lit(n)).alias("seat"), F.lit(False).alias("tail")))).alias("x"))
    edges = ends.groupBy("slot", "x.seat").agg(F.max(F.when(F.col("x.tail"), F.col("node"))).alias("u"),
                                               F.max(F.when(~F.col("x.tail"), F.col("node"))).alias("v"))
    edges = edges.where((F.col("slot") < whole) | (F.col("seat") % 2 == 0))
    place = F.when(F.col("slot") < whole, F.col("seat")).otherwise(F.floor(F.col("seat") / 2))
    return edges.select((F.col("slot") * F.lit(n).cast("bigint") + place).alias("id"), "u", "v")


def _faults(edges: DataFrame) -> DataFrame:
    """Ids of loops, and of all but the first of edges with the same ends."""
    same = edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.array_sort(F.collect_list("id")).alias("ids"))  # at most k edges end in a node
    loop = F.col("a") == F.col("b")
    return same.where(loop | (F.col("c") > 1)).select(F.explode(F.when(loop, F.col("ids")).otherwise(F.slice("ids", 2, F.size("ids")))).alias("id"))


def _switches(faults: DataFrame, edges: DataFrame, m: int, salt: Column) -> DataFrame:
    """(id, u, v): new ends of edges. A faulty edge trades ends with one drawn by hash; of trades that share an edge the
    first in a random order is made."""
    drawn = faults.select("id", F.pmod(F.xxhash64("id", salt), F.lit(m)).alias("other"), F.xxhash64("id", salt, F.lit(1)).alias("order")) \
        .where(F.col("id") != F.col("other"))
    trade = F.struct("order", "id", "other")
    first = drawn.select(F.explode(F.array("id", "other")).alias("edge"), trade.alias("t")).groupBy("edge").agg(F.min("t").alias("t"))
    made = first.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("t.id", "t.other")
    mine = edges.select("id", F.col("u").alias("u1"), F.col("v").alias("v1"))
    others = edges.select(F.col("id").alias("other"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    both = made.join(mine, "id").join(others, "other")
    turned = F.xxhash64("id", salt, F.lit(2)) % 2 == 0
    ends = [F.when(turned, F.col("u2")).otherwise(F.col("v2")), F.when(turned, F.col("v2")).otherwise(F.col("u2"))]
    return both.select(F.explode(F.array(
        F.struct(F.col("id").alias("id"), F.col("u1").alias("nu"), ends[0].alias("nv")),
        F.struct(F.col("other").alias("id"), F.col("v1").alias("nu"), ends[1].alias("nv")))).alias("x")).select("x.*")


def random_regular_edges(nodes: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """(u, v): a random simple network in which every node has ``k`` neighbours; the number of nodes times k is even.

    Random circles through all nodes give every node its degree, but now and then the same edge twice. Such an edge
    and a random other one trade an end each, which changes no degree, until no fault is left; the number of
    faults does not grow with the network. Needs more than 2 k nodes, so that there is room."""
    n = nodes.count()
    if n * k % 2 or n <= 2 * k or k < 1:
        raise ValueError(f"no random network of {n} nodes with {k} neighbours each: an even product and more than {2 * k} nodes are needed")
    m = n * k // 2
    edges = truncate_lineage(_circles(nodes, n, k, seed), "circles")
    for step in range(MAX_STEPS):
        faults = truncate_lineage(_faults(edges), "faults")
        if faults.isEmpty():
            return edge_canonical(edges)
        new = _switches(faults, edges, m, F.lit(seed * MAX_STEPS + step))
        edges = truncate_lineage(edges.join(new, "id", "left").select("id", F.coalesce("nu", "u").alias("u"), F.coalesce("nv", "v").alias("v")), "circles")
    raise RuntimeError(f"faults left after {MAX_STEPS} steps")
