"""Random matchings on any network, against brute force."""

import functools
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlog.operators import matching as M, pairing as P
from pairlog.operators.blossom import largest_matching


def network(spark, edges):
    return spark.createDataFrame(list(edges), "u bigint, v bigint")


def largest(edges):
    """Pairs of a largest matching of a small network."""
    @functools.cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        out = best(rest)
        for x in rest:
            if (first, x) in edges:
                out = max(out, 1 + best(tuple(y for y in rest if y != x)))
        return out
    return best(tuple(sorted({n for e in edges for n in e})))


def schedule_of(rows, rounds):
    out = {r: [] for r in range(1, rounds + 1)}
    for r in rows:
        assert r.Node1 < r.Node2
        out[r.Trial].append((r.Node1, r.Node2))
    for pairs in out.values():
        seats = [n for p in pairs for n in p]
        assert len(seats) == len(set(seats))
    return out


def small_networks():
    rng = random.Random(8)
    for k in range(14):
        n = rng.randrange(2, 10)
        share = rng.choice([0.2, 0.35, 0.6])
        yield {(100 * k + a, 100 * k + b) for a, b in itertools.combinations(range(n), 2) if rng.random() < share}
    for n in (5, 7):  # odd cycles with a tail at one or two places
        base = 100_000 + 100 * n
        ring = {tuple(sorted((base + i, base + (i + 1) % n))) for i in range(n)}
        yield ring | {(base, base + 50)}
        yield {(a + 20, b + 20) for a, b in ring} | {(base + 20, base + 71), (base + 22, base + 72), (base + 71, base + 73)}


def test_as_large_as_any(spark):
    """Many small networks side by side, odd cycles among them: every part has a largest matching in every round."""
    parts = [p for p in small_networks() if p]
    edges = set().union(*parts)
    # both directions, loops, repetitions and NULL ends change nothing
    table = network(spark, [*edges, *[(b, a) for a, b in edges], *[(a, a) for a, _ in edges], *list(edges)[:9], (None, 3), (7, None)])
    found = schedule_of(M.random_matching(table, 2, seed=1, attempts=3).collect(), 2)
    for pairs in found.values():
        assert set(pairs) <= edges
        for p in parts:
            nodes = {n for e in p for n in e}
            assert sum(a in nodes for a, _ in pairs) == largest(frozenset(p))
    assert found[1] != found[2]


@pytest.mark.parametrize("n", [8, 21])
def test_perfect_on_regular_networks(spark, n):
    nodes = spark.range(1, n + 1).withColumnRenamed("id", "node")
    edges = P.regular_edges(nodes, n, seed=2)
    schedule = M.random_matching(edges, 4, seed=9)
    a = schedule.collect()
    found = schedule_of(a, 4)
    assert all(len(p) == n // 2 for p in found.values())
    assert {tuple(r) for r in a} == {tuple(r) for r in M.random_matching(edges, 4, seed=9).collect()}
    assert M.left_over(edges, schedule, 4).count() == 4 * (n % 2)
    assert len({tuple(sorted(p)) for p in found.values()}) == 4


def test_a_long_way_between_the_last_nodes(spark):
    """A path whose only perfect matching greed hardly ever finds."""
    n = 16
    edges = network(spark, [(i, i + 1) for i in range(n - 1)])
    found = schedule_of(M.random_matching(edges, 2, seed=4).collect(), 2)
    assert all(sorted(p) == [(i, i + 1) for i in range(0, n, 2)] for p in found.values())


def test_hub_and_nothing(spark):
    star = network(spark, [(0, i) for i in range(1, 2000)])
    found = schedule_of(M.random_matching(star, 5, seed=1).collect(), 5)
    assert all(len(p) == 1 for p in found.values()) and len({p[0] for p in found.values()}) > 1
    assert M.left_over(star, spark.createDataFrame([(r, *p[0]) for r, p in found.items()], "Trial int, Node1 bigint, Node2 bigint"), 5).count() == 5 * 1998
    assert M.random_matching(star.limit(0), 3).count() == 0
    assert M.random_matching(star, 0).count() == 0


def test_rounds_differ_in_all_edges(spark):
    """Over many rounds every edge of a small complete network is drawn."""
    edges = network(spark, itertools.combinations(range(6), 2))
    drawn = defaultdict(int)
    for r in M.random_matching(edges, 60, seed=3).collect():
        drawn[r.Node1, r.Node2] += 1
    assert len(drawn) == 15 and min(drawn.values()) >= 3 and sum(drawn.values()) == 180


@pytest.fixture
def writes(monkeypatch):
    """What goes to the work folder while a schedule is drawn: (purpose, table)."""
    out = []
    monkeypatch.setattr(M, "truncate_lineage", lambda df, purpose, f=M.truncate_lineage: out.append((purpose, f(df, purpose))) or out[-1][1])
    return out


@pytest.mark.parametrize("n", [600, 601])
def test_a_ring_with_hubs_takes_no_steps(spark, writes, n):
    """The last nodes left over are far apart; the work does not grow with the distance between them."""
    edges = P.hub_edges(spark.range(1, n + 1).withColumnRenamed("id", "node"), n, hubs=2)
    found = schedule_of(M.random_matching(edges, 3, seed=5).collect(), 3)
    assert [purpose for purpose, _ in writes] == ["edges", "matching"]
    there = {tuple(r) for r in edges.collect()}
    assert all(len(p) == n // 2 and set(p) <= there for p in found.values())
    assert len({tuple(sorted(p)) for p in found.values()}) == 3


def test_a_regular_network_takes_no_steps(spark, writes):
    n = 501
    edges = P.regular_edges(spark.range(1, n + 1).withColumnRenamed("id", "node"), n, seed=7)
    schedule = M.random_matching(edges, 4, seed=3)
    assert [purpose for purpose, _ in writes] == ["edges", "matching"]
    assert all(len(p) == n // 2 for p in schedule_of(schedule.collect(), 4).values())
    assert [r.Trial for r in M.left_over(edges, schedule, 4).orderBy("Trial").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("seed", range(4))
def test_shrunken_cycles(seed):
    """Random networks with many odd cycles, against brute force; the order of the edges is of no account."""
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(2, 12)
        edges = [e for e in itertools.combinations([7 * i - 20 for i in range(n)], 2) if rng.random() < rng.choice([0.15, 0.3, 0.5])]
        if not edges:
            continue
        draw = lambda e: largest_matching(*np.array(e, np.int64).T, np.random.default_rng(seed))
        nodes, mate = draw(edges)
        assert nodes.tolist() == sorted({x for e in edges for x in e})
        pairs = {(int(nodes[i]), int(nodes[j])) for i, j in enumerate(mate) if i < j}
        assert all(mate[j] == i for i, j in enumerate(mate) if j >= 0) and pairs <= set(edges) and len(pairs) == largest(frozenset(edges))
        assert (draw(rng.sample(edges, len(edges)))[1] == mate).all()


def test_long_searches_and_failed_ones():
    """Flowers on a path of thousands of pairs, and leaves that hang on few nodes."""
    n = 4000
    path = [(i, i + 1) for i in range(n - 1)]
    flowers = [(i, i + 2) for i in range(0, n - 2, 3)]
    leaves = [(i % 7, n + i) for i in range(3000)]
    for edges, most in ((path, n // 2), (path + flowers, n // 2), (leaves, 7), (path + flowers + leaves, (n - 8) // 2 + 7)):
        _, mate = largest_matching(*np.array(edges, np.int64).T, np.random.default_rng(1))
        assert (mate >= 0).sum() == 2 * most


def test_same_draw_on_other_partitions(spark):
    table = network(spark, [(a, b) for a, b in itertools.combinations(range(40), 2) if (a * b) % 5])
    one = set(map(tuple, M.random_matching(table.coalesce(1), 3, seed=-4).collect()))
    assert one == set(map(tuple, M.random_matching(table.repartition(7), 3, seed=-4).collect()))
    assert one != set(map(tuple, M.random_matching(table, 3, seed=4).collect()))


def test_step_by_step(spark, writes):
    """Networks that no task may hold: trees over all tasks."""
    parts = [p for p in small_networks() if p][-8:]
    table = network(spark, set().union(*parts))
    found = schedule_of(M.random_matching(table, 2, seed=1, held=0).collect(), 2)
    assert sum(purpose == "swaps" for purpose, _ in writes) > 1
    for pairs in found.values():
        assert [sum(a in {n for e in p for n in e} for a, _ in pairs) for p in parts] == [largest(frozenset(p)) for p in parts]
    assert M.random_matching(table, 0, held=0).count() == M.random_matching(table.limit(0), 2, held=0).count() == 0


def test_one_node_left_over_ends_the_steps(spark, writes):
    """Nobody is left for it to find, however far its tree could grow."""
    edges = network(spark, [(i, i + 1) for i in range(24)])
    found = schedule_of(M.random_matching(edges, 1, seed=3, held=0).collect(), 1)
    assert len(found[1]) == 12
    empty = [table.isEmpty() for purpose, table in writes if purpose == "swaps"]
    assert empty[-1] and not empty[-2]


def test_absent_rounds(spark):
    s = spark.createDataFrame([(1, 2, 1), (1, 2, 3)], "Node1 int, Node2 int, Trial int")
    assert [(r.Trial, r.node, r.problem) for r in P.validate_schedule(s, n=2, k=2, rounds=3).collect()] == [(2, None, "absent_round")]
    assert {(r.Trial, r.seated) for r in P.missing_seats(s, 2, rounds=4).collect()} == {(2, 0), (4, 0)}
    assert P.validate_schedule(s).count() == 0
    assert [r.Trial for r in P.absent_rounds(s.where("false"), 2).orderBy("Trial").collect()] == [1, 2]
    runs = s.withColumn("run", F.lit(None).cast("string"))
    assert [(r.run, r.Trial) for r in P.absent_rounds(runs, 3, ("run", "Trial")).collect()] == [(None, 2)]
