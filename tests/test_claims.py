import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairlog.operators import claims as C, hypothesis as H, models as M


@pytest.fixture(scope="module")
def claims(spark):
    rng = random.Random(2)
    rows = []
    for person in range(24):
        s, c = ("Spatial", "Homogeneous")[person % 2], ("Face", "Hashtag")[person // 2 % 2]
        for phase in ("pre", "post"):
            for _ in range(rng.randrange(0, 7)):
                rows.append((s, c, 20, person, phase, rng.choice([0, 6, 11, 18]), rng.choice([3, 7, 19])))
    return C.with_topics(spark.createDataFrame(
        rows, "Structure string, Content string, Size int, random_id int, Phase string, cause_cluster int, effect_cluster int"))


def test_topics(spark):
    d = spark.createDataFrame([(18,), (7,), (19,), (-1,), (99,)], "c int")
    got = [r.t for r in d.select(C.collapse_topics(C.map_topics("c")).alias("t")).collect()]
    assert got == ["Tsunami", "Nuclear Disaster", "Health Issues", "No Cluster", None]


def test_counting_before_the_join_equals_the_join(spark):
    tweets = spark.createDataFrame(
        [("Spatial", "Face", 20, i, ph, text) for i, ph, text in
         [(1, "pre", "a"), (1, "post", "b"), (2, "pre", "a"), (2, "post", "none"), (3, "pre", "a")]], C_TWEETS)
    claims = spark.createDataFrame([("a", "x", "y")] * 3 + [("b", "x", "z")], "text string, cause string, effect string")
    joined = C.claims_with_authors(claims, tweets).groupBy(*C.AUTHOR, "Phase").agg(F.count("*").alias("n"))
    counts = C.claim_counts(claims, tweets)
    rows = lambda d: sorted(tuple(r) for r in d.select(*C.AUTHOR, "Phase", "n").collect())
    assert rows(joined) == rows(counts) and len(rows(counts)) == 4
    full = rows(C.claim_counts_filled(claims, tweets))
    assert len(full) == 5 and ("Spatial", "Face", 20, 2, "post", 0) in full
    diffs = {r.random_id: r.difference for r in C.prepost_difference(C.claim_counts_filled(claims, tweets)).collect()}
    assert diffs == {1: -2, 2: -3}  # the third wrote in one phase only


C_TWEETS = "Structure string, Content string, Size int, random_id int, Phase string, Response string"


def test_complete_size(claims):
    counts = C.relation_counts(claims)
    full = C.complete(counts, C.AUTHOR, ["Phase", "cause_topic", "effect_topic"], "count")
    people = counts.select(*C.AUTHOR).distinct().count()
    levels = [counts.select(c).distinct().count() for c in ("Phase", "cause_topic", "effect_topic")]
    assert full.count() == people * levels[0] * levels[1] * levels[2]
    assert full.agg(F.sum("count")).first()[0] == claims.count()
    few = C.complete(counts, C.AUTHOR, ["cause_topic"], "count", max_levels=1)  # beyond the arrays' bound: another way
    assert few.count() == people * levels[1] and few.agg(F.sum("count")).first()[0] == claims.count()


def test_sparse_moments_equal_the_dense_test(claims):
    rel = C.relation_counts(claims)
    sparse = H.t_test_ci(C.relation_moments(C.relation_shifts(claims)))
    full = C.complete(rel, C.AUTHOR, ["Phase", "cause_topic", "effect_topic"], "count")
    dense = H.t_test_one_sample(C.relation_shifts(full, "count"), "difference", [*C.CONDITION, "cause_topic", "effect_topic"])
    key = lambda r: (r.Structure, r.Content, r.cause_topic, r.effect_topic)
    a, b = ({key(r): r for r in d.collect()} for d in (sparse, dense))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].n == b[k].n and a[k].estimate == pytest.approx(b[k].estimate)
        assert (a[k].p_value is None) == (b[k].p_value is None)
        if a[k].p_value is not None:
            assert a[k].p_value == pytest.approx(b[k].p_value)
            assert a[k].conf_low < a[k].estimate < a[k].conf_high
            assert (a[k].p_value < 0.05) == (a[k].conf_low > 0 or a[k].conf_high < 0)


def test_degenerate_groups(spark):
    d = spark.createDataFrame([("const", 2), ("const", 2), ("one", 3), ("ok", 1), ("ok", 2), ("ok", 3)], "g string, x int")
    got = {r.g: r for r in H.t_test_one_sample(d, "x", ["g"]).collect()}
    assert got["const"].p_value is None and got["one"].p_value is None
    assert got["ok"].statistic == pytest.approx(2 / (1 / 3**0.5)) and got["ok"].p_value == pytest.approx(0.0741799, abs=1e-6)


def test_welch(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    d = spark.createDataFrame([("g", "A", x) for x in a] + [("g", "B", x) for x in b], "k string, side string, v double")
    r = H.welch_t_test(d, "v", "side", "A", "B", ["k"]).first()
    e1, e2 = statistics.variance(a) / 4, statistics.variance(b) / 5
    assert r.statistic == pytest.approx((2.5 - 6.0) / (e1 + e2) ** 0.5)
    assert r.parameter == pytest.approx((e1 + e2) ** 2 / (e1**2 / 3 + e2**2 / 4))
    assert 0.05 < r.p_value < 0.1 and r.stars == ""


def test_bh(spark):
    d = spark.createDataFrame([("f", p) for p in (0.01, 0.04, 0.03, 0.80)] + [("g", 0.2), ("g", None)], "k string, p double")
    got = sorted((r.k, r.p, round(r.q, 6)) for r in H.bh_adjust(d, "p", ["k"], "q").collect())
    assert got == [("f", 0.01, 0.04), ("f", 0.03, 0.053333), ("f", 0.04, 0.053333), ("f", 0.8, 0.8), ("g", 0.2, 0.2)]


def test_binomial_interval(spark):
    d = spark.createDataFrame([(8, 2), (0, 5), (5, 0), (0, 0)], "unique_positive_count int, unique_negative_count int")
    r = {(x.unique_positive_count, x.unique_negative_count): x for x in H.binom_test_exact(d).collect()}
    assert r[8, 2].p_value == pytest.approx(0.109375) and r[8, 2].conf_int_low == pytest.approx(0.4439045, abs=1e-6)
    assert r[8, 2].conf_int_high == pytest.approx(0.9747893, abs=1e-6)
    assert r[0, 5].conf_int_low == 0.0 and r[0, 5].conf_int_high == pytest.approx(0.5218238, abs=1e-6)
    assert r[5, 0].conf_int_high == 1.0 and r[5, 0].p_value == pytest.approx(0.0625)
    assert r[0, 0].p_value is None and r[0, 0].estimate is None and r[0, 0].conf_int_low is None


def test_signers(claims):
    shifts = C.relation_shifts(claims)
    up, down = defaultdict(set), defaultdict(set)
    for r in shifts.collect():
        k = (r.Structure, r.Content, r.cause_topic, r.effect_topic)
        (up if r.difference > 0 else down if r.difference < 0 else defaultdict(set))[k].add(r.random_id)
    for r in C.unique_signers(shifts).collect():
        k = (r.Structure, r.Content, r.cause_topic, r.effect_topic)
        assert (r.unique_positive_count, r.unique_negative_count) == (len(up[k]), len(down[k]))


def test_clusters(claims):
    one_pass = {r.ID: (r.cause_counts, r.effect_counts) for r in C.cluster_counts(claims).collect()}
    assert one_pass[0][1] is None and one_pass[3][0] is None
    table = {r.ID: r for r in C.diverging_table(C.cluster_counts(claims)).collect()}
    assert table[18].cause_counts == -one_pass[18][0] and table[18].topic_label == "Tsunami (mispelt)"


def test_hurdle(spark):
    d = spark.createDataFrame([("S", "F", x) for x in (0, 0, 2, 4)] + [("H", "F", x) for x in (0, -1, -3)],
                              "Structure string, Content string, difference int")
    fit = {r.Structure: r for r in M.hurdle_expected(M.hurdle_gaussian(d)).collect()}
    assert fit["S"].mu == 3 and fit["H"].mu == -2 and fit["S"].hu == pytest.approx(3 / 7)
    assert fit["S"].sigma == pytest.approx(1.0) and fit["H"].expected == pytest.approx(-2 * 4 / 7)
    drawn = M.hurdle_predict(d, M.hurdle_gaussian(d))
    assert drawn.count() == 7 and drawn.where("predicted is null").count() == 0


def test_histogram(spark):
    d = spark.createDataFrame([("S", "F", x) for x in (-1, 0, 0, 1)], "Structure string, Content string, difference int")
    assert {r.bin: r.n for r in C.difference_histogram(d).collect()} == {-1.5: 1, -0.5: 2, 0.5: 1}


def test_many_topics_without_caps(spark):
    """More levels than the arrays take: the unfolded form gives the same table."""
    rng = random.Random(2)
    rows = [("S", "C", 20, p, rng.choice(["pre", "post"]), f"c{rng.randrange(40)}", f"e{rng.randrange(30)}") for p in range(6) for _ in range(30)]
    claims = spark.createDataFrame(rows, "Structure string, Content string, Size int, random_id int, Phase string, cause_topic string, effect_topic string")
    counted = C.relation_counts(claims)
    keys = ["Phase", "cause_topic", "effect_topic"]
    arrays = C.complete(counted, C.AUTHOR, keys, "count")
    joined = C.complete(counted, C.AUTHOR, keys, "count", max_levels=5)
    assert sorted(map(tuple, arrays.select(*C.AUTHOR, *keys, "count").collect())) == sorted(map(tuple, joined.select(*C.AUTHOR, *keys, "count").collect()))


def test_five_thousand_topics(spark):
    rows = [("S", "C", 20, p, "post", f"c{i}", "e") for i in range(5000) for p in (i % 3,)]
    claims = spark.createDataFrame(rows, "Structure string, Content string, Size int, random_id int, Phase string, cause_topic string, effect_topic string")
    shifts = C.relation_shifts(claims)
    moments = C.relation_moments(shifts)
    assert moments.count() == 5000 and moments.where("n = 3 AND sx = 1 AND sxx = 1").count() == 5000
    assert C.unique_signers(shifts).where("unique_positive_count = 1 AND unique_negative_count = 0").count() == 5000


@pytest.mark.parametrize("levels", [1000, 0])
def test_complete_keeps_rows_without_a_level(spark, levels):
    """The packed form and the joined form give the same rows, NULL topics included."""
    d = spark.createDataFrame([("p", "x", "y", 2), ("p", None, "y", 3), ("q", "x", None, 1), ("q", "z", "y", 4), (None, "z", "w", 5), ("p", None, None, 7)],
                              "person string, cause string, effect string, n int")
    got = {(r.person, r.cause, r.effect): r.n for r in C.complete(d, ["person"], ["cause", "effect"], "n", max_levels=levels).collect()}
    seen = {("p", "x", "y"): 2, ("p", None, "y"): 3, ("q", "x", None): 1, ("q", "z", "y"): 4, (None, "z", "w"): 5, ("p", None, None): 7}
    cells = {(p, c, e): 0 for p in ("p", "q", None) for c in ("x", "z") for e in ("y", "w")}
    assert got == cells | seen
