from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairlog.operators import networks as N, pairing as P


def nodes(spark, n):
    return spark.range(1, n + 1).withColumnRenamed("id", "node")


def perfect(schedule, n, rounds):
    seats = defaultdict(list)
    for r in schedule.collect():
        assert r.Node1 < r.Node2
        seats[r.Trial] += [r.Node1, r.Node2]
    assert set(seats) == set(range(1, rounds + 1))
    return all(sorted(s) == list(range(1, n + 1)) for s in seats.values())


@pytest.mark.parametrize("n", [6, 20, 50])
def test_ring_schedule(spark, n):
    s = P.ring_schedule(nodes(spark, n), n, 8)
    assert perfect(s, n, 8)
    by_trial = defaultdict(set)
    for r in s.collect():
        by_trial[r.Trial].add((r.Node1, r.Node2))
    assert by_trial[1] == by_trial[5] and by_trial[4] == by_trial[8]
    assert (1, 2) in by_trial[1] and (1, 3) in by_trial[2] and (1, n) in by_trial[3] and (1, n - 1) in by_trial[4]
    if n == 50:
        assert (49, 50) in by_trial[2] and {(46, 48), (47, 50)} <= by_trial[4]


@pytest.mark.parametrize("n", [4, 20, 50])
def test_round_robin(spark, n):
    s = P.round_robin(nodes(spark, n), n, n - 1)
    assert perfect(s, n, n - 1)
    assert P.pair_repeats(s).where("meetings > 1").count() == 0
    cover = P.schedule_coverage(s).collect()
    assert all(r.partners == n - 1 and r.meetings == n - 1 for r in cover)


def test_round_robin_odd(spark):
    s = P.round_robin(nodes(spark, 5), 5, 5)
    assert s.count() == 10 and P.pair_repeats(s).count() == 10
    assert P.validate_schedule(s).count() == 0 and P.missing_seats(s, 5).count() == 5


@pytest.mark.parametrize("n", [6, 20, 50])
def test_random_matching(spark, n):
    s = P.random_matching(nodes(spark, n), n, 12, seed=5)
    assert perfect(s, n, 12)
    assert P.validate_schedule(s, n=n, k=4).count() == 0
    assert {tuple(r) for r in s.collect()} == {tuple(r) for r in P.random_matching(nodes(spark, n), n, 12, seed=5).collect()}
    assert {tuple(r) for r in s.collect()} != {tuple(r) for r in P.random_matching(nodes(spark, n), n, 12, seed=6).collect()}


@pytest.mark.parametrize("n,hubs", [(8, 1), (20, 1), (20, 2), (50, 3)])
def test_hub_matching(spark, n, hubs):
    s = P.hub_matching(nodes(spark, n), n, 12, hubs, seed=2)
    assert perfect(s, n, 12)
    edges = {tuple(r) for r in P.hub_edges(nodes(spark, n), n, hubs=hubs).collect()}
    assert {(r.Node1, r.Node2) for r in s.collect()} <= edges
    assert len({r.Node2 for r in s.collect() if r.Node1 == 1}) > 1


def test_ring_and_hubs(spark):
    ring = {tuple(r) for r in P.ring_edges(nodes(spark, 6), 6).collect()}
    assert len(ring) == 12 and (1, 6) in ring and (1, 5) in ring and (1, 4) not in ring
    hub = {tuple(r) for r in P.hub_edges(nodes(spark, 10), 10, hubs=2).collect()}
    assert {(1, v) for v in range(2, 11)} <= hub and {(2, v) for v in range(3, 11)} <= hub
    assert P.degree(P.ring_edges(nodes(spark, 20), 20)).where("degree <> 4").count() == 0


@pytest.mark.parametrize("n,k", [(11, 4), (20, 4), (500, 4), (30, 6)])
def test_regular_edges(spark, n, k):
    e = P.regular_edges(nodes(spark, n), n, k, seed=9)
    assert e.count() == n * k // 2
    assert P.degree(e).where(F.col("degree") != k).count() == 0 and P.degree(e).count() == n


def test_violations_are_reported(spark):
    bad = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (4, 1, 2), (1, 4, 3)], "Node1 int, Node2 int, Trial int")
    got = {(r.Trial, r.node, r.problem) for r in P.validate_schedule(bad, n=6, k=2).collect()}
    assert (1, 2, "repeated_node") in got and (2, 4, "end_order") in got and (3, 1, "too_far") in got


def test_schedule_to_pairs(spark):
    schedule = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 3)], "Identifier string, TrialNumber int, Node1 int, Node2 int")
    people = spark.createDataFrame([("a", t, i) for t in (1, 2) for i in (1, 2, 3)], "Identifier string, TrialNumber int, id int")
    got = {(r.TrialNumber, r.id): r.grp for r in P.schedule_to_pairs(people, schedule).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): -1, (2, 1): -1, (2, 2): 2, (2, 3): 2}
    listed = P.group_pairs_by_trial(schedule).collect()
    assert all(r.position == 1 for r in listed)


def test_reissue_with_a_hot_id(spark):
    rows = [(i, "777" if i % 3 == 0 else str(i)) for i in range(3000)]
    d = spark.createDataFrame(rows, "rec int, participant_id string")
    got = P.reissue_duplicate_ids(d, "rec").collect()
    assert len(got) == len({r.new_id for r in got}) == 3000
    kept = {r.participant_id: r.rec for r in got if r.new_id == r.participant_id}
    assert kept["777"] == 0 and kept["1"] == 1
    assert all(len(r.new_id) >= 5 for r in got if r.new_id != r.participant_id)


@pytest.mark.parametrize("draw,n", [(lambda d, n: P.ring_schedule(d, n, 3), 7), (lambda d, n: P.random_matching(d, n, 3), 7),
                                    (lambda d, n: P.hub_matching(d, n, 2, 3), 6)])
def test_sizes_that_do_not_fit_raise(spark, draw, n):
    nodes = spark.range(1, n + 1).withColumnRenamed("id", "node")
    with pytest.raises(Exception, match="wants an even number"):
        draw(nodes, n).collect()


def test_records_without_id_stay(spark):
    people = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "record int, participant_id string")
    got = {r.record: r.new_id for r in P.reissue_duplicate_ids(people, "record").collect()}
    assert got[1] == "a" and got[2] is None and got[4] is None and got[3] not in ("a", None)


def triangles(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return sum(len(near[a] & near[b]) for a, b in edges) // 3


@pytest.mark.parametrize("n,k", [(10, 4), (300, 4), (200, 3), (101, 6), (40, 15)])
def test_random_regular_edges(spark, n, k):
    found = [sorted(tuple(r) for r in N.random_regular_edges(nodes(spark, n), k, seed=s).collect()) for s in (1, 2, 1)]
    assert found[0] == found[2] != found[1]
    for edges in found:
        assert len(edges) == len(set(edges)) == n * k // 2 and all(a < b for a, b in edges)
        seats = defaultdict(int)
        for e in edges:
            for x in e:
                seats[x] += 1
        assert len(seats) == n and set(seats.values()) == {k}


def test_random_networks_differ_in_shape(spark):
    """Not one network with other names: the numbers of triangles differ."""
    counts = {triangles([tuple(r) for r in N.random_regular_edges(nodes(spark, 60), 6, seed=s).collect()]) for s in range(5)}
    assert len(counts) > 1
    for n, k in ((7, 3), (8, 4), (5, 0)):
        with pytest.raises(ValueError):
            N.random_regular_edges(nodes(spark, n), k)
