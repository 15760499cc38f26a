"""Networks and pairing schedules as table generators, and checks on them.

Nodes come as a table with a dense 1-based ``node`` column, and ``n`` is their number (a
literal or a scalar subquery). Generators are arithmetic on that table: linear in nodes
times rounds, and narrow unless said otherwise. The complete graph is never listed: every
pair is an edge of it, and ``round_robin`` draws its matchings directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import bucketed_row_number
from .reshape import edge_canonical

Number = Column | int


def _n(n: Number) -> Column:
    return F.lit(n).cast("bigint") if isinstance(n, int) else n.cast("bigint")


def node_count(nodes: DataFrame) -> Column:
    return nodes.agg(F.count(F.lit(1))).scalar()


def _rounds(nodes: DataFrame, n: Number, rounds: int, keep: Column | None = None) -> DataFrame:
    d = nodes.select(F.col("node").cast("bigint").alias("node"), _n(n).alias("n"))
    if keep is not None:
        d = d.where(keep)
    return d.withColumn("Trial", F.explode(F.sequence(F.lit(1), F.lit(rounds))))


def _need(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Stop with a plain message when the number of nodes does not fit the design."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def _ordered(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.select("Trial", F.least(a, b).alias("Node1"), F.greatest(a, b).alias("Node2"))


def ring_edges(nodes: DataFrame, n: Number, k: int = 4) -> DataFrame:
    """Each node with its k nearest on a ring; listed once, from the node before. The clean-up
    for tiny rings, where the two directions meet, is part of ``edge_canonical``."""
    d = nodes.select(F.col("node").cast("bigint").alias("a"), _n(n).alias("n"),
                     F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("step"))
    b = F.pmod(F.col("a") - 1 + F.col("step"), F.col("n")) + 1
    return edge_canonical(d.select(F.col("a").alias("u"), b.alias("v")))


def hub_edges(nodes: DataFrame, n: Number, hubs: int, k: int = 4) -> DataFrame:
    """Ring plus ``hubs`` first nodes linked to all; an edge is listed once."""
    spokes = nodes.select(F.col("node").cast("bigint").alias("v"),
                          F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(hubs).cast("bigint"))).alias("u"))
    return edge_canonical(ring_edges(nodes, n, k).unionByName(spokes))


def regular_edges(nodes: DataFrame, n: Number, k: int = 4, seed: int = 0) -> DataFrame:
    """Random k-regular simple graph, k even: nodes take hash-shuffled seats on a circle and
    are linked at k/2 distinct seat distances, one per slot of the possible ones. Never a
    loop or a double edge, so nothing is retried. The seat order is a distributed rank."""
    h = F.xxhash64(F.col("node"), F.lit(seed))
    seated = bucketed_row_number(nodes.select("node").withColumn("_h", h), F.shiftright("_h", 52), ["_h", "node"])
    width = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") - 1) / 2) / (k // 2)))
    slot = F.col("slot")
    distance = F.when(slot == 0, F.lit(1)).otherwise(1 + slot * width + F.pmod(F.xxhash64(F.lit(seed), slot), width))
    d = (seated.withColumn("n", _n(n)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k // 2 - 1))))
         .withColumn("distance", distance))
    ends = d.select("slot", "node", F.explode(F.array(
        F.struct(F.col("pos").alias("seat"), F.lit(True).alias("tail")),
        F.struct(F.pmod(F.col("pos") - F.col("distance"), F.col("n")).alias("seat"), F.lit(False).alias("tail")),
    )).alias("x"))
    return edge_canonical(ends.groupBy("slot", "x.seat").agg(
        F.max(F.when(F.col("x.tail"), F.col("node"))).alias("u"),
        F.max(F.when(~F.col("x.tail"), F.col("node"))).alias("v")))


def round_robin(nodes: DataFrame, n: Number, rounds: int) -> DataFrame:
    """Matchings of the complete graph by the circle method: no pair comes back before all
    have met. With odd n one node rests per round."""
    # m is n rounded up to even; seat 0 pairs the fixed last player
    d = _rounds(nodes, n, rounds, F.col("node") <= F.floor((F.col("n") + 1) / 2))
    m1 = F.col("n") + F.pmod("n", F.lit(2)) - 1
    seat, turn = F.col("node") - 1, F.pmod(F.col("Trial") - 1, m1)
    a = F.pmod(turn + seat, m1) + 1
    b = F.when(seat == 0, m1 + 1).otherwise(F.pmod(turn - seat, m1) + 1)
    return _ordered(d, a, b).where(F.col("Node2") <= _n(n))


def ring_schedule(nodes: DataFrame, n: Number, rounds: int) -> DataFrame:
    """The four fixed matchings of a ring, in turn: neighbours, next-but-one, neighbours
    shifted by one, next-but-one shifted. n is even."""
    half = F.floor(F.col("n") / 2)
    d = _need(_rounds(nodes, n, rounds, F.col("node") <= half), F.pmod("n", F.lit(2)) == 0, "a ring schedule wants an even number of nodes") \
        .withColumn("s", F.col("node") - 1)
    s, n_, odd_half = F.col("s"), F.col("n"), F.pmod(F.floor(F.col("n") / 2), F.lit(2)) == 1
    last = s == F.floor(n_ / 2) - 1
    wide = lambda i: 4 * F.floor(i / 2) + 1 + F.pmod(i, F.lit(2))
    shapes = [
        (2 * s + 1, 2 * s + 2),
        (F.when(odd_half & last, n_ - 1).otherwise(wide(s)), F.when(odd_half & last, n_).otherwise(wide(s) + 2)),
        (F.when(s == 0, F.lit(1)).otherwise(2 * s), F.when(s == 0, n_).otherwise(2 * s + 1)),
        (F.when(s == 0, F.lit(1)).when(odd_half & last, n_ - 3).otherwise(wide(s - 1) + 1),
         F.when(s == 0, n_ - 1).when(odd_half & last, n_).otherwise(wide(s - 1) + 3)),
    ]
    kind = F.pmod(F.col("Trial") - 1, F.lit(4))
    pick = lambda j: F.coalesce(*[F.when(kind == i, shape[j]) for i, shape in enumerate(shapes)])
    return _ordered(d, pick(0), pick(1))


def random_matching(nodes: DataFrame, n: Number, rounds: int, seed: int = 0) -> DataFrame:
    """A random perfect matching of the ring lattice (k = 4, n even) per round. The ring is
    cut in fours from a hashed starting point, and each four pairs either as neighbours or
    next-but-one by a hashed coin. Perfect by construction: nothing is resampled."""
    d = _need(_rounds(nodes, n, rounds), F.pmod("n", F.lit(2)) == 0, "a perfect matching wants an even number of nodes")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("Trial")), F.col("n"))
    seat = F.pmod(F.col("node") - 1 - start, F.col("n"))
    d = d.withColumn("start", start).withColumn("seat", seat)
    block, place = F.floor(F.col("seat") / 4), F.pmod("seat", F.lit(4))
    whole = block * 4 + 3 < F.col("n")
    far = whole & (F.pmod(F.xxhash64(F.lit(seed), F.col("Trial"), block), F.lit(2)) == 1)
    opens = F.when(far, place < 2).otherwise(F.pmod(place, F.lit(2)) == 0)
    partner = F.pmod(F.col("seat") + F.when(far, 2).otherwise(1) + F.col("start"), F.col("n")) + 1
    return _ordered(d.where(opens), F.col("node"), partner)


def schedule_to_pairs(people: DataFrame, schedule: DataFrame, keys: Sequence[str] = ("Identifier", "TrialNumber"),
                      node: str = "id") -> DataFrame:
    """Pair id of every participant and trial: the smaller node of the pair. One equi join on
    (run, trial, node); people without a pair get -1."""
    seats = schedule.select(*keys, F.col("Node1").alias("grp"), F.explode(F.array("Node1", "Node2")).alias(node))
    return (people.join(seats, [*keys, node], "left")
            .withColumn("grp", F.coalesce(F.col("grp"), F.lit(-1))))


def pairs_of_log(df: DataFrame, keys: Sequence[str] = ("Identifier", "TrialNumber")) -> DataFrame:
    """The schedule a log was played on: both members of every complete pair."""
    return (df.groupBy(*keys, "grp").agg(F.min("id").alias("Node1"), F.max("id").alias("Node2"))
            .where(F.col("Node1") < F.col("Node2")))


def group_pairs_by_trial(schedule: DataFrame, keys: Sequence[str] = ("Identifier", "TrialNumber"),
                         block: int = 1024) -> DataFrame:
    """Pairs of each trial in order, as rows with a 1-based position: a trial may have any
    number of pairs, so they are not gathered in one list."""
    d = bucketed_row_number(schedule, F.floor(F.col("Node1") / block), ["Node1", "Node2"], keys)
    return d.select(*keys, (F.col("pos") + 1).alias("position"), "Node1", "Node2")


def absent_rounds(schedule: DataFrame, rounds: int, keys: Sequence[str] = ("Trial",)) -> DataFrame:
    """Rounds from 1 to ``rounds`` without any pair: the last key counts rounds, those before it tell
    schedules apart. A schedule without any row is only known where there are no such keys."""
    *own, trial = keys
    each = schedule.select(*own).distinct() if own else schedule.sparkSession.range(1).select()
    kind = schedule.schema[trial].dataType
    every = each.withColumn(trial, F.explode(F.sequence(F.lit(1).cast(kind), F.lit(rounds).cast(kind))))
    there = schedule.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    return every.join(there, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left_anti").select(*keys)


def validate_schedule(schedule: DataFrame, keys: Sequence[str] = ("Trial",), n: Number | None = None,
                      k: int | None = None, rounds: int | None = None) -> DataFrame:
    """Violations: (keys, node, problem). A node seated twice in a round, ends out of order; given n and k,
    ring partners further apart than k/2; given ``rounds``, rounds that are absent (without node)."""
    seats = schedule.select(*keys, F.explode(F.array("Node1", "Node2")).alias("node"))
    out = (seats.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
           .select(*keys, "node", F.lit("repeated_node").alias("problem")))
    order = schedule.where(F.col("Node1") >= F.col("Node2")).select(
        *keys, F.col("Node1").alias("node"), F.lit("end_order").alias("problem"))
    out = out.unionByName(order)
    if n is not None and k is not None:
        gap = F.col("Node2") - F.col("Node1")
        far = schedule.where(F.least(gap, _n(n) - gap) > k // 2).select(
            *keys, F.col("Node1").alias("node"), F.lit("too_far").alias("problem"))
        out = out.unionByName(far)
    if rounds is not None:
        absent = absent_rounds(schedule, rounds, keys).withColumn("node", F.lit(None).cast(schedule.schema["Node1"].dataType))
        out = out.unionByName(absent.withColumn("problem", F.lit("absent_round")))
    return out


def missing_seats(schedule: DataFrame, n: Number, keys: Sequence[str] = ("Trial",), rounds: int | None = None) -> DataFrame:
    """Rounds in which fewer than n nodes are seated; given ``rounds``, absent ones with none."""
    seats = schedule.select(*keys, F.explode(F.array("Node1", "Node2")).alias("node")).distinct()
    few = seats.groupBy(*keys).agg(F.count(F.lit(1)).alias("seated")).where(F.col("seated") < _n(n))
    if rounds is None:
        return few
    return few.unionByName(absent_rounds(schedule, rounds, keys).withColumn("seated", F.lit(0).cast("bigint")))


def pair_repeats(schedule: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often each pair meets."""
    return schedule.groupBy(*keys, "Node1", "Node2").agg(F.count(F.lit(1)).alias("meetings"))


def schedule_coverage(schedule: DataFrame, keys: Sequence[str] = (), trial: str = "Trial") -> DataFrame:
    """Per node: meetings, distinct partners, and the trial by which the last of them was first met."""
    ends = schedule.select(*keys, F.col(trial).alias("_t"), F.explode(F.array(
        F.struct(F.col("Node1").alias("node"), F.col("Node2").alias("partner")),
        F.struct(F.col("Node2").alias("node"), F.col("Node1").alias("partner")))).alias("x"))
    met = ends.groupBy(*keys, "x.node", "x.partner").agg(F.min("_t").alias("first"), F.count(F.lit(1)).alias("m"))
    return met.groupBy(*keys, "node").agg(
        F.sum("m").alias("meetings"), F.count(F.lit(1)).alias("partners"), F.max("first").alias("all_met_by"))


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def reissue_duplicate_ids(people: DataFrame, record: str, id_col: str = "participant_id", seed: int = 0) -> DataFrame:
    """The first record (smallest ``record``) of an id keeps it; any other gets a hashed
    five-digit id, widened by its record key where that is taken. ``record`` is unique. The
    keeper is found by a mergeable minimum, so one id may cover any share of the rows."""
    owner = people.groupBy(id_col).agg(F.min(record).alias("_owner"))
    fresh = (F.lit(10000) + F.pmod(F.xxhash64(F.col(record), F.lit(seed)), F.lit(90000))).cast("string")
    kept = people.join(owner, id_col, "left")  # a record without id keeps none
    out = kept.withColumn("_candidate", F.when(F.col(record) != F.col("_owner"), fresh)).drop("_owner")
    # a candidate is free when no participant holds it and no smaller record wants it
    wanted = (out.where(F.col("_candidate").isNotNull())
              .groupBy("_candidate").agg(F.min(record).alias("_first")))
    taken = people.select(F.col(id_col).cast("string").alias("_candidate")).distinct().withColumn("_held", F.lit(True))
    # both lookup tables have at most one row per id, and candidates at most 90 000 values
    # keepers have no candidate; they get keys of their own instead of sharing the NULL one
    key = F.coalesce(F.col("_candidate"), F.concat(F.lit("#"), F.col(record).cast("string")))
    lookup = wanted.join(taken, "_candidate", "left").withColumnRenamed("_candidate", "_key")
    joined = out.withColumn("_key", key).join(lookup, "_key", "left")
    free = F.col("_held").isNull() & (F.col("_first") == F.col(record))
    new_id = (F.when(F.col("_candidate").isNull(), F.col(id_col).cast("string"))
              .when(free, F.col("_candidate"))
              .otherwise(F.concat_ws("-", F.col("_candidate"), F.col(record).cast("string"))))
    return joined.withColumn("new_id", new_id).drop("_candidate", "_first", "_held", "_key")


def hub_matching(nodes: DataFrame, n: Number, rounds: int, hubs: int, seed: int = 0) -> DataFrame:
    """A random perfect matching of ring plus hubs (n even) per round. Each hub draws a partner
    from a slot of its own among the other nodes, never the slot's last one, so that two drawn
    partners are never neighbours; the nodes left over pair up in ring order, which spans at
    most one drawn partner. Needs n >= 4 * hubs."""
    d = _need(_rounds(nodes, n, rounds), (F.pmod("n", F.lit(2)) == 0) & (F.col("n") >= 4 * hubs),
              f"a hub matching with {hubs} hubs wants an even number of nodes, {4 * hubs} at least")
    width = F.floor((F.col("n") - hubs) / hubs)
    drawn = [F.lit(hubs + 1) + (j * width) + F.pmod(F.xxhash64(F.lit(seed), F.col("Trial"), F.lit(j)), width - 1)
             for j in range(hubs)]
    d = d.withColumn("drawn", F.array(*drawn))
    taken = lambda node: F.array_contains("drawn", node)
    below = F.size(F.filter("drawn", lambda p: p < F.col("node")))
    rank = F.col("node") - hubs - 1 - below
    is_hub = F.col("node") <= hubs
    after = F.col("node") + F.when(taken(F.col("node") + 1), 2).otherwise(1)
    partner = F.when(is_hub, F.get("drawn", (F.col("node") - 1).cast("int"))).otherwise(after)
    opens = is_hub | (~taken(F.col("node")) & (F.pmod(rank, F.lit(2)) == 0))
    return _ordered(d.where(opens), F.col("node"), partner)
