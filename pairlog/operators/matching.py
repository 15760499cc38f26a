"""Random matchings along the edges of any network, a new one for every round.

A network of up to ``held`` edges is dealt out once for each round, and a task draws a round from memory
(``blossom.largest_matching``); its matchings are as large as any, and rounds run side by side.

Beyond that, no task holds a network. All rounds are drawn together. Every node without a partner is the root of a
tree; the trees of a round grow at once, each step by one edge and the pair behind it, so that a tree holds paths which
alternate between edges outside and inside the matching. Where the ends of two trees touch, the path from root to root has one pair
more when it is swapped. Of the paths that touch, those are taken whose hashed priority is the smallest at both
of their trees; their trees are given up, all others grow on. At the start every node is a root, so the first
steps are those of a random greedy matching; what greed leaves over is then repaired by longer and longer swaps.

A step is a few equi joins and aggregates over (round, node), all of them mergeable, so a hub may hold any
share of the edges. Its state is written to the work folder and read back, so a step depends on the one
before it alone. Steps grow with the logarithm of the network, plus the distance between the last nodes
left over; paths travel with the nodes of their trees and are as long as that distance. On a ring, with hubs or
without, that is a share of the network.

A node left over after the last step has no partner in its round. Where trees met only themselves, in cycles
of odd length, they are grown again in another random order, ``attempts`` times before the node is given up.
Without such cycles, the matching is known to be as large as any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship, truncate_lineage
from .blossom import largest_matching
from .reshape import edge_canonical

HELD = 1 << 22  # edges of a network that one task may hold: a few hundred MB of its Python
IDLE = 3  # thinned steps in a row without a find, before the trees are grown anew


def _hash(*parts: Column | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def _roots(state: DataFrame) -> DataFrame:
    """Every node without a mate as a tree of its own; no other trees."""
    free = F.col("mate").isNull()
    return state.select("Trial", "node", "mate", F.when(free, F.col("node")).alias("root"), free.alias("even"),
                        F.when(free, F.array("node")).alias("path"))


def _touching(state: DataFrame, ends: DataFrame, salt: int, thin: bool) -> DataFrame:
    """Edges from the even nodes of trees: (Trial, u, root, path) and, of the node v at the other end, its state.
    ``thin`` leaves out a random half of them."""
    even = state.where("even").select("Trial", F.col("node").alias("u"), "root", "path")
    out = even.join(ends, "u")
    if thin:
        out = out.where(F.pmod(_hash(F.col("Trial"), F.col("u"), F.col("v"), salt), F.lit(2)) == 0)
    at = state.select("Trial", F.col("node").alias("v"), F.col("mate").alias("v_mate"), F.col("root").alias("v_root"),
                      F.col("even").alias("v_even"), F.when(F.col("even"), F.col("path")).alias("v_path"))
    return out.join(at, ["Trial", "v"])


_MEETS = "v_even AND v_root <> root"
_GROWS = "v_root IS NULL"


def _chosen(touching: DataFrame, seed: int) -> DataFrame:
    """Swaps to make: of the paths between two trees the one first in a random order, where it is first for both."""
    low, high = F.least("root", "v_root"), F.greatest("root", "v_root")
    meets = touching.where(_MEETS).where(F.col("root") < F.col("v_root"))  # each edge is there from both ends
    swap = F.struct(_hash(F.col("Trial"), low, high, seed).alias("order"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"),
                    low.alias("low"), high.alias("high"), F.concat("path", F.reverse("v_path")).alias("path"))
    first = meets.select("Trial", swap.alias("s"), F.explode(F.array(low, high)).alias("tree")).groupBy("Trial", "tree").agg(F.min("s").alias("s"))
    both = first.groupBy("Trial", "s.low", "s.high", "s.a", "s.b").agg(F.count(F.lit(1)).alias("n"), F.min("s.path").alias("path")).where("n = 2")
    return both.select("Trial", "low", "high", "path")


def _claims(touching: DataFrame, salt: int) -> DataFrame:
    """Pairs that join a tree: one claim for each, the first in a random order. Two rows for each pair: the node at
    which it is entered, and its mate, where the tree may go on."""
    claim = F.struct(_hash(F.col("Trial"), F.col("u"), F.col("v"), salt).alias("order"), F.col("u"), F.col("v"), F.col("v_mate").alias("mate"), "root",
                     F.concat("path", F.array("v", "v_mate")).alias("path"))
    first = touching.where(_GROWS).groupBy("Trial", F.least("v", "v_mate").alias("pair")).agg(F.min(claim).alias("c"))
    return first.select("Trial", F.explode(F.array(
        F.struct(F.col("c.v").alias("node"), F.col("c.root").alias("new_root"), F.lit(False).alias("new_even"),
                 F.lit(None).cast("array<bigint>").alias("new_path")),
        F.struct(F.col("c.mate").alias("node"), F.col("c.root").alias("new_root"), F.lit(True).alias("new_even"),
                 F.col("c.path").alias("new_path")))).alias("x")).select("Trial", "x.*")


def _step(state: DataFrame, claims: DataFrame, chosen: DataFrame) -> DataFrame:
    """The state after the trees have grown and the chosen swaps are made."""
    place = F.posexplode("path").alias("i", "node")
    partner = F.element_at("path", F.when(F.col("i") % 2 == 0, F.col("i") + 2).otherwise(F.col("i")))
    swapped = chosen.select("Trial", "path", place).select("Trial", "node", partner.alias("new_mate"))
    given_up = chosen.select("Trial", F.explode(F.array("low", "high")).alias("tree"), F.lit(True).alias("_over"))
    grown = state.join(claims, ["Trial", "node"], "left").join(swapped, ["Trial", "node"], "left") \
        .withColumn("tree", F.coalesce("new_root", "root", "node")).join(given_up, ["Trial", "tree"], "left")
    over = F.col("_over").isNotNull()  # a node in no tree stands under its own name there, which is no tree's
    return grown.select(
        "Trial", "node", F.coalesce("new_mate", "mate").alias("mate"), F.when(~over, F.coalesce("new_root", "root")).alias("root"),
        F.when(over, False).otherwise(F.coalesce("new_even", "even", F.lit(False))).alias("even"),
        F.when(~over, F.coalesce("new_path", "path")).alias("path"))


def _held(plain: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(Trial, node, mate) where a task holds the network; one task for each round."""
    ship(plain.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        trial, u, v = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in range(3))
        del rows
        for t in np.unique(trial).tolist():
            own = trial == t
            nodes, mate = largest_matching(u[own], v[own], np.random.default_rng((seed % 2**64, t)))
            for at in range(0, len(nodes), 1 << 16):
                node, to = nodes[at:at + (1 << 16)], mate[at:at + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(node), t, np.int32)), pa.array(node), pa.array(nodes[to], mask=to < 0)], ["Trial", "node", "mate"])

    dealt = plain.select(F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("Trial"), "u", "v").repartitionById(rounds, F.col("Trial") - 1)
    return truncate_lineage(dealt.mapInArrow(work, "Trial int, node bigint, mate bigint"), "matching")


def matched_nodes(edges: DataFrame, rounds: int, seed: int = 0, attempts: int = 3, u: str = "u", v: str = "v", held: int = HELD) -> DataFrame:
    """(Trial, node, mate) of every node of the network in every round; mate is NULL for a node left over.

    ``edges`` are any two columns of whole numbers; loops, repeated edges and NULL ends do not count. ``attempts``
    matter for networks of more than ``held`` edges only."""
    plain = truncate_lineage(edge_canonical(edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(
        F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v"))), "edges")
    if rounds >= 1 and plain.count() <= held:
        return _held(plain, rounds, seed)
    ends = plain.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
    nodes = ends.select(F.col("u").alias("node")).distinct()
    state = nodes.select(F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("Trial"), "node", F.lit(None).cast("bigint").alias("mate"))
    if rounds < 1:
        return state.where("false")
    state, attempt, step, idle = truncate_lineage(_roots(state), "matching"), 0, 0, 0
    while True:
        step += 1
        touching = _touching(state, ends, seed + 7919 * step, thin=attempt > 0).persist()
        chosen = truncate_lineage(_chosen(touching, seed), "swaps")
        swaps = not chosen.isEmpty()
        if not swaps and _open(state).isEmpty():
            touching.unpersist()
            return state.select("Trial", "node", "mate")
        if swaps or not touching.where(_GROWS).isEmpty():
            state = truncate_lineage(_step(state, _claims(touching, seed + step), chosen), "matching")
            attempt, idle = 0 if swaps else attempt, 0
        elif attempt and idle < IDLE:
            idle += 1  # the next step leaves out other edges
        elif attempt < attempts and _stuck(state, ends):
            attempt, idle = attempt + 1, 0
            state = truncate_lineage(_roots(state), "matching")
        else:
            touching.unpersist()
            return state.select("Trial", "node", "mate")
        touching.unpersist()


def _open(state: DataFrame) -> DataFrame:
    """Rounds with two nodes or more left over."""
    return state.where("mate IS NULL").groupBy("Trial").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("Trial")


def _stuck(state: DataFrame, ends: DataFrame) -> bool:
    """Whether in a round with two nodes or more left over some tree touches itself, so that another order of growing may
    find more."""
    some = state.join(_open(state), "Trial", "left_semi")
    return not _touching(some, ends, 0, False).where("v_even AND v_root = root AND v <> u").isEmpty()


def random_matching(edges: DataFrame, rounds: int, seed: int = 0, attempts: int = 3, u: str = "u", v: str = "v", held: int = HELD) -> DataFrame:
    """(Trial, Node1, Node2): a random matching of the network for each round, Node1 < Node2."""
    seats = matched_nodes(edges, rounds, seed, attempts, u, v, held)
    return seats.where(F.col("node") < F.col("mate")).select("Trial", F.col("node").alias("Node1"), F.col("mate").alias("Node2"))


def left_over(edges: DataFrame, schedule: DataFrame, rounds: int, u: str = "u", v: str = "v") -> DataFrame:
    """(Trial, node): nodes of the network without a partner in a round, whoever made the schedule."""
    nodes = edges.select(F.explode(F.array(F.col(u).cast("bigint"), F.col(v).cast("bigint"))).alias("node")).where("node IS NOT NULL").distinct()
    seats = schedule.select(F.col("Trial").cast("int").alias("Trial"), F.explode(F.array("Node1", "Node2")).alias("node"))
    every = nodes.withColumn("Trial", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return every.join(seats, ["Trial", "node"], "left_anti").select("Trial", "node")
