"""Networks over the customers, schedules, and the schedule a log was played on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interactions as I, matching as M, networks as N, pairing as P, reshape as R
from ..sources.files import sample_schedule
from .registry import query

ROUNDS = 40
_N = "(SELECT count(*) FROM customer)"
_RING = f"""
    SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v
    FROM (SELECT c_custkey + 1 AS a, (c_custkey + s) % {_N} + 1 AS b FROM customer, range(1, 3) g(s)) WHERE a <> b"""


def people(t):
    """Customers as nodes 1..n; keys are dense from 0."""
    nodes = t.table("customer").select((F.col("c_custkey") + 1).alias("node"))
    return nodes, P.node_count(nodes)


def log_pairs(t):
    return P.pairs_of_log(t.interactions())


@query("ring_edges", _RING)
def _(t):
    return P.ring_edges(*people(t))


@query("hub_edges", f"""
    SELECT u, v FROM ({_RING}) UNION SELECT h, c_custkey + 1 FROM customer, range(1, 3) g(h) WHERE c_custkey + 1 > h""")
def _(t):
    return P.hub_edges(*people(t), hubs=2)


@query("degree", f"""
    SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ({_RING}) UNION ALL SELECT v FROM ({_RING})) GROUP BY ALL""")
def _(t):
    return P.degree(P.ring_edges(*people(t)))


@query("regular_edges")
def _(t):
    return P.regular_edges(*people(t), seed=7)


@query("regular_edges_degrees", "SELECT 4::BIGINT AS degree, count(*) AS nodes FROM customer")
def _(t):
    d = P.degree(P.regular_edges(*people(t), seed=7))
    return d.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("random_regular_edges", """
    SELECT 4::BIGINT AS degree, count(*) AS nodes, 2 * count(*) AS edges, 0::BIGINT AS faults FROM customer""")
def _(t):
    """Degrees of a random network over the customers, and its edges that are loops or there twice."""
    edges = N.random_regular_edges(people(t)[0], 4, seed=11)
    faults = edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        (F.count(F.lit(1)) - F.when(F.col("a") == F.col("b"), 0).otherwise(1)).alias("f")).agg(F.sum("f")).scalar()
    d = P.degree(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))
    return d.withColumn("edges", edges.agg(F.count(F.lit(1))).scalar()).withColumn("faults", faults)


@query("round_robin", f"""
    SELECT CAST(r + 1 AS INT) AS "Trial", least(a, b) AS Node1, greatest(a, b) AS Node2 FROM (
      SELECT r, (r + c_custkey) % ({_N} - 1) + 1 AS a,
             CASE WHEN c_custkey = 0 THEN {_N} ELSE (r - c_custkey + 10 * ({_N} - 1)) % ({_N} - 1) + 1 END AS b
      FROM customer, range(0, {ROUNDS}) g(r) WHERE c_custkey < {_N} / 2)""")
def _(t):
    return P.round_robin(*people(t), rounds=ROUNDS)


@query("ring_schedule", f"""
    SELECT CAST(r + 1 AS INT) AS "Trial", node AS Node1,
           CASE r % 4 WHEN 0 THEN node + 1 WHEN 1 THEN CASE WHEN odd_half AND node = n - 1 THEN n ELSE node + 2 END
                WHEN 2 THEN CASE WHEN node = 1 THEN n ELSE node + 1 END
                ELSE CASE WHEN node = 1 THEN n - 1 WHEN odd_half AND node = n - 3 THEN n ELSE node + 2 END END AS Node2
    FROM (SELECT c_custkey + 1 AS node, {_N} AS n, {_N} % 4 = 2 AS odd_half FROM customer), range(0, {ROUNDS}) g(r)
    WHERE CASE r % 4 WHEN 0 THEN node % 2 = 1 WHEN 1 THEN node % 4 IN (1, 2) AND node < n
          WHEN 2 THEN node = 1 OR (node % 2 = 0 AND node < n) ELSE node = 1 OR (node % 4 IN (2, 3) AND node < n - 1) END""")
def _(t):
    return P.ring_schedule(*people(t), rounds=ROUNDS)


@query("random_matching")
def _(t):
    return P.random_matching(*people(t), rounds=ROUNDS, seed=3)


@query("random_matching_violations", """
    SELECT 0 AS "Trial", 0::BIGINT AS node, '' AS problem FROM customer WHERE c_custkey < 0""")
def _(t):
    nodes, n = people(t)
    return P.validate_schedule(P.random_matching(nodes, n, ROUNDS, seed=3), n=n, k=4)


@query("random_matching_seats", f"""
    SELECT CAST(r AS INT) AS "Trial", count(*) AS seated FROM customer, range(1, {ROUNDS + 1}) g(r) GROUP BY ALL""")
def _(t):
    d = P.random_matching(*people(t), rounds=ROUNDS, seed=3)
    seats = d.select("Trial", F.explode(F.array("Node1", "Node2")).alias("node")).distinct()
    return seats.groupBy("Trial").agg(F.count(F.lit(1)).alias("seated"))


def seating(schedule, edges, rounds):
    """Of each round: pairs, distinct nodes seated, pairs off the network, nodes left over."""
    off = schedule.join(edges.select(F.least("u", "v").alias("Node1"), F.greatest("u", "v").alias("Node2"), F.lit(0).alias("off")).distinct(),
                        ["Node1", "Node2"], "left").groupBy("Trial").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.coalesce("off", F.lit(1))).alias("off_graph"))
    seats = schedule.select("Trial", F.explode(F.array("Node1", "Node2")).alias("node")).distinct().groupBy("Trial").agg(F.count(F.lit(1)).alias("seated"))
    left = M.left_over(edges, schedule, rounds).groupBy("Trial").agg(F.count(F.lit(1)).alias("alone"))
    return off.join(seats, "Trial").join(left, "Trial", "left").select("Trial", "pairs", "seated", "off_graph", F.coalesce("alone", F.lit(0)).alias("alone"))


_SEATING = """
    SELECT CAST(r AS INT) AS "Trial", pairs, 2 * pairs AS seated, 0::BIGINT AS off_graph, nodes - 2 * pairs AS alone FROM ({}), range(1, {}) g(r)"""


@query("edge_matching_regular", _SEATING.format("SELECT CAST(floor(count(*) / 2) AS BIGINT) AS pairs, count(*) AS nodes FROM customer", 11))
def _(t):
    """A random network in which everybody can find a partner, and does in every round."""
    edges = P.regular_edges(*people(t), seed=7)
    return seating(M.random_matching(edges, 10, seed=3), edges, 10)


@query("edge_matching_orders", _SEATING.format(
    "SELECT count(DISTINCT o_custkey) AS pairs, count(DISTINCT o_custkey) + count(*) AS nodes FROM orders", 4))
def _(t):
    """Customers and their orders: a customer takes one of them, and all other orders are left over."""
    edges = t.table("orders").select((-1 - F.col("o_custkey")).alias("u"), F.col("o_orderkey").alias("v"))
    return seating(M.random_matching(edges, 3, seed=3), edges, 3)


@query("edge_matching_hubs", _SEATING.format("SELECT CAST(floor(count(*) / 2) AS BIGINT) AS pairs, count(*) AS nodes FROM customer", 6))
def _(t):
    """A ring on which two nodes know everybody."""
    edges = P.hub_edges(*people(t), hubs=2)
    return seating(M.random_matching(edges, 5, seed=5), edges, 5)


@query("hub_matching")
def _(t):
    return P.hub_matching(*people(t), rounds=ROUNDS, hubs=2, seed=3)


@query("hub_matching_seats", f"""
    SELECT CAST(r AS INT) AS "Trial", count(*) AS seated, 0::BIGINT AS off_graph FROM customer, range(1, {ROUNDS + 1}) g(r) GROUP BY ALL""")
def _(t):
    """Everybody sits once per round, and along edges of the network only."""
    nodes, n = people(t)
    d = P.hub_matching(nodes, n, ROUNDS, hubs=2, seed=3)
    edges = P.hub_edges(nodes, n, hubs=2).select(F.col("u").alias("Node1"), F.col("v").alias("Node2"), F.lit(0).alias("off"))
    seats = (d.join(edges, ["Node1", "Node2"], "left").select("Trial", F.coalesce("off", F.lit(1)).alias("off"),
             F.explode(F.array("Node1", "Node2")).alias("node")))
    once = seats.groupBy("Trial", "node").agg(F.sum("off").alias("off"))
    return once.groupBy("Trial").agg(F.count(F.lit(1)).alias("seated"), F.sum("off").alias("off_graph"))


@query("edge_canonical", """
    SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem WHERE l_partkey <> l_suppkey""")
def _(t):
    return R.edge_canonical(t.table("lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("adjacency_to_edges", """
    SELECT vec_id AS u, CAST(i - 1 AS INT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
    WHERE embedding[i] > 0""")
def _(t):
    row = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return R.adjacency_to_edges(t.table("embeddings").select(F.col("vec_id").alias("node"), row.alias("row")))


@query("neighbour_lists", f"""
    SELECT u, array_to_string(list_sort(list(v)), ',') AS neighbours FROM ({_RING}) GROUP BY ALL""")
def _(t):
    return R.neighbour_lists(P.ring_edges(*people(t))).select("u", F.array_join("neighbours", ",").alias("neighbours"))


@query("schedule_to_pairs", """
    SELECT l.Identifier, l.TrialNumber, l.id, coalesce(p.Node1, -1) AS grp
    FROM v_log l LEFT JOIN v_pairs p ON p.Identifier = l.Identifier AND p.TrialNumber = l.TrialNumber AND l.id IN (p.Node1, p.Node2)""")
def _(t):
    log = t.interactions()
    return P.schedule_to_pairs(log.select(I.RUN, I.TRIAL, "id"), P.pairs_of_log(log))


@query("group_pairs_by_trial", """
    SELECT Identifier, TrialNumber, row_number() OVER (PARTITION BY Identifier, TrialNumber ORDER BY Node1) AS position, Node1, Node2 FROM v_pairs""")
def _(t):
    return P.group_pairs_by_trial(log_pairs(t))


@query("validate_schedule", """
    SELECT Identifier, TrialNumber, node, 'repeated_node' AS problem FROM (
      SELECT Identifier, TrialNumber, Node1 AS node FROM v_pairs UNION ALL SELECT Identifier, TrialNumber, Node2 FROM v_pairs)
    GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT Identifier, TrialNumber, Node1, 'end_order' FROM v_pairs WHERE Node1 >= Node2""")
def _(t):
    return P.validate_schedule(log_pairs(t), (I.RUN, I.TRIAL))


@query("schedule_violations_in_trade", """
    SELECT l_orderkey AS "Trial", node, 'repeated_node' AS problem FROM (
      SELECT l_orderkey, l_partkey AS node FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem)
    GROUP BY l_orderkey, node HAVING count(*) > 1
    UNION ALL SELECT l_orderkey, l_partkey, 'end_order' FROM lineitem WHERE l_partkey >= l_suppkey""")
def _(t):
    """Order lines read as part-supplier pairs: a schedule with many violations."""
    d = t.table("lineitem").select(F.col("l_orderkey").alias("Trial"), F.col("l_partkey").alias("Node1"), F.col("l_suppkey").alias("Node2"))
    return P.validate_schedule(d)


@query("absent_rounds", """
    SELECT l_orderkey AS "Order", CAST(r AS INT) AS "Trial" FROM (SELECT DISTINCT l_orderkey FROM lineitem), range(1, 8) g(r)
    WHERE (l_orderkey, r) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem)""")
def _(t):
    """Orders read as schedules of seven rounds, a line as a pair: rounds without a line."""
    d = t.table("lineitem").select(F.col("l_orderkey").alias("Order"), F.col("l_linenumber").cast("int").alias("Trial"),
                                   F.col("l_partkey").alias("Node1"), F.col("l_suppkey").alias("Node2"))
    return P.absent_rounds(d, 7, ("Order", "Trial"))


@query("missing_seats", """
    SELECT Identifier, TrialNumber, 2 * count(*) AS seated FROM v_pairs GROUP BY ALL HAVING 2 * count(*) < (SELECT max(Size) FROM v_sizes)""")
def _(t):
    log = t.interactions()
    full = I.run_sizes(t.log()).agg(F.max("Size")).scalar()
    return P.missing_seats(P.pairs_of_log(log), full, (I.RUN, I.TRIAL))


@query("pair_repeats", "SELECT Identifier, Node1, Node2, count(*) AS meetings FROM v_pairs GROUP BY ALL")
def _(t):
    return P.pair_repeats(log_pairs(t), (I.RUN,))


@query("schedule_coverage", """
    SELECT Identifier, node, CAST(sum(m) AS BIGINT) AS meetings, count(*) AS partners, max(first) AS all_met_by FROM (
      SELECT Identifier, node, partner, count(*) AS m, min(TrialNumber) AS first FROM (
        SELECT Identifier, TrialNumber, Node1 AS node, Node2 AS partner FROM v_pairs
        UNION ALL SELECT Identifier, TrialNumber, Node2, Node1 FROM v_pairs) GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return P.schedule_coverage(log_pairs(t), (I.RUN,), I.TRIAL)


@query("reissue_duplicate_ids")
def _(t):
    """Events as records, their user as the id claimed: all but one of a user get a new id."""
    people_ = t.table("events").select("event_id", F.col("user_id").alias("participant_id"))
    return P.reissue_duplicate_ids(people_, "event_id")


@query("reissue_duplicate_ids_unique", """
    SELECT count(*) AS records, count(*) AS ids, count(DISTINCT user_id) AS kept FROM events""")
def _(t):
    people_ = t.table("events").select("event_id", F.col("user_id").alias("participant_id"))
    d = P.reissue_duplicate_ids(people_, "event_id").select(
        "new_id", (F.col("new_id") == F.col("participant_id").cast("string")).cast("int").alias("same"))
    per_id = d.groupBy("new_id").agg(F.count(F.lit(1)).alias("n"), F.max("same").alias("same"))
    return per_id.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("ids"), F.sum("same").cast("bigint").alias("kept"))


@query("sample_schedule")
def _(t):
    log = t.interactions()
    sizes = I.run_sizes(t.log())
    schedules = (P.pairs_of_log(log).join(sizes, I.RUN)
                 .select(F.col("Size").alias("n"), (F.pmod("TrialNumber", F.lit(10)) + 1).alias("seed"),
                         F.col("TrialNumber").alias("Trial"), "Node1", "Node2"))
    return sample_schedule(sizes, schedules)
