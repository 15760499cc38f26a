import datetime as dt
import os

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairlog.operators import entropy as E, interactions as I, ranking as K, reshape as R


def by_cell(df, *cols):
    return {(r.Identifier, r.TrialNumber, r.id): tuple(r[c] for c in cols) for r in df.collect()}


def test_partner(log):
    got = by_cell(I.attach_partner(log), "partner_id", "partner_response", "Points")
    assert got["a", 1, 1] == (2, "x", 1) and got["a", 1, 4] == (3, "y", 0)
    assert got["a", 3, 2] == (None, None, 0) and got["a", 3, 3] == (None, None, 0)
    assert got["a", 3, 1] == (4, None, 0) and got["a", 3, 4] == (1, "y", 0)


def test_coordination(log):
    got = by_cell(I.pair_coordination(log), "Coordinate")
    assert got["a", 1, 1] == (1,) and got["a", 1, 3] == (0,)
    assert got["a", 3, 1] == (0,)  # a missing answer is a value of its own
    assert got["a", 3, 2] == (1,)  # alone
    assert got == by_cell(I.attach_partner(log), "Coordinate")


def test_entropy_and_dominance(log):
    e = {(r.Identifier, r.TrialNumber): r.entropy for r in E.trial_entropy(log, base=2).collect()}
    assert e["a", 1] == pytest.approx(1.5) and e["a", 2] == pytest.approx(1.0)
    assert e["a", 3] == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    d = {(r.Identifier, r.TrialNumber): r for r in I.dominant_response(log).collect()}
    tie = d["a", 2]
    assert (tie.DomResponse, tie.DomResponseCount) == ("x", 2)  # alphabetical on ties
    assert d["a", 3].NumRespondents == 4 and d["a", 3].DomResponseProp == pytest.approx(0.5)
    p = {(r.Identifier, r.TrialNumber): r for r in E.trial_profile(log).collect()}
    assert p["a", 3].DomResponseProp == pytest.approx(2 / 3)
    assert all(p[k].entropy == pytest.approx(e[k]) for k in e)


def test_entropy_of_one_answer_is_positive_zero(spark):
    counts = spark.createDataFrame([("a", 1, "x", 7)], "Identifier string, TrialNumber int, Response string, n long")
    h = E.entropy_of_counts(counts, ["Identifier", "TrialNumber"]).first().entropy
    assert h == 0.0 and math.copysign(1, h) == 1


def test_entropy_bounds(log):
    n = E.normalized_entropy(E.trial_entropy(log, base=2), I.run_sizes(log)).collect()
    assert all(0 <= r.normalized <= 1 for r in n) and {r.Size for r in n} == {4}


def test_shift_and_delta(log):
    e = E.trial_entropy(log, base=2)
    s = {(r.Identifier, r.TrialNumber): r.EntropyDifference for r in E.entropy_shift(e).collect()}
    assert s["a", 1] == 0 and s["a", 2] == pytest.approx(-0.5)
    assert {r.TrialNumber for r in E.entropy_delta_mean(e).collect()} == {2, 3}


def test_rollup_has_every_grain(log):
    e = E.trial_entropy(log, (I.RUN, *I.CONDITION, I.TRIAL), base=2)
    r = E.condition_rollup(E.normalized_entropy(e, I.run_sizes(log)), "normalized").collect()
    assert {x.grain for x in r} == {0, 1, 2, 3}
    assert next(x for x in r if x.grain == 3 and x.TrialNumber == 1).n == 2


def test_top_k(spark):
    d = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "r string, n long")
    assert {x.r for x in K.top_k_with_ties(d, "n", 2).collect()} == {"a", "b", "c"}
    g = d.withColumn("g", F.lit("g"))
    assert {x.r for x in K.top_k_with_ties(g, "n", 2, ["g"]).collect()} == {"a", "b", "c"}
    assert [x.r for x in K.top_k_strict(d, "n", 2, "r").collect()] == ["a", "b"]


def test_bucketed_row_number_equals_a_plain_sort(spark):
    rng = random.Random(1)
    # one partition holds most rows
    rows = [("hot" if i % 3 else "cold", rng.randrange(1000), i) for i in range(4000)]
    d = spark.createDataFrame(rows, "p string, v int, i int")
    got = K.bucketed_row_number(d, F.floor(F.col("v") / 50), ["v", "i"], ["p"]).collect()
    want = {}
    for p in ("hot", "cold"):
        for pos, r in enumerate(sorted((r[1:] for r in rows if r[0] == p))):
            want[p, r[1]] = pos
    assert {(r.p, r.i): r.pos for r in got} == want


def test_hot_unpaired_group(spark):
    """A third of a large trial is unpaired under one id; pairs are untouched by it."""
    rows = [("a", 1, i, f"r{i % 7}", -1 if i % 3 == 0 else i // 2 * 2) for i in range(6000)]
    d = spark.createDataFrame(rows, "Identifier string, TrialNumber int, id int, Response string, grp int")
    got = I.attach_partner(d)
    groups = defaultdict(list)
    for _, _, i, r, g in rows:
        if g >= 0:
            groups[g].append((i, r))
    points = sum(2 for g in groups.values() if len(g) == 2 and g[0][1] == g[1][1])
    assert got.agg(F.sum("Points")).first()[0] == points
    assert got.where("grp = -1 and partner_id is not null").count() == 0


def test_shares_and_pivot(log):
    from pairlog.operators.decisions import label_decisions
    d = label_decisions(log)
    shares = I.decision_shares(d).groupBy("Identifier", "TrialNumber").agg(F.sum("DTNormed").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in shares)
    pivot = I.decision_pivot(d).orderBy("Identifier", "TrialNumber").collect()
    assert pivot[0].asDict() == {"Identifier": "a", "TrialNumber": 1, "BN": 4, "EC": 0, "RS": 0, "RP": 0}
    p = I.transition_probs(d.where("DecisionType is not null")).agg(F.sum("p")).first()[0]
    assert p == pytest.approx(1.0)
    cond = I.transition_probs(d.where("DecisionType is not null"), conditional=True)
    assert all(r.s == pytest.approx(1.0) for r in cond.groupBy("from").agg(F.sum("p").alias("s")).collect())


def test_grid_has_every_trial(log):
    g = {(r.Identifier, r.TrialNumber, r.Response): r.n for r in I.trial_response_grid(log, 3).collect()}
    assert len(g) == 2 * 3 * 3
    assert g["a", 1, "z"] == 1 and g["a", 2, "z"] == 0 and g["b", 3, "q"] == 2


def test_response_code(log):
    codes = {(r.Identifier, r.Response): r.code for r in I.response_code(log).collect()}
    assert [codes["a", x] for x in "xyz"] == [0, 1, 2] and [codes["b", x] for x in "pqr"] == [0, 1, 2]


def test_pivot_rejects_duplicates(spark, log):
    wide = R.pivot_wide(log, ["Identifier", "id"], "TrialNumber", "Response", [1, 2, 3])
    assert wide.where("Identifier = 'a' and id = 1").select("TrialNumber_1", "TrialNumber_3").first()[1] == "y"
    twice = log.union(log.limit(1))
    with pytest.raises(Exception, match="duplicate cell"):
        R.pivot_wide(twice, ["Identifier", "id"], "TrialNumber", "Response", [1, 2, 3]).collect()


def test_score_pair(spark):
    rows = [("a", 1, 1, "Emily", 0, 5, None), ("a", 1, 2, "emily", 0, 5, None), ("a", 1, 3, "", 1, 2, None),
            ("a", 1, 4, "", 1, 3, None), ("a", 1, 5, "x", 2, None, 1), ("a", 1, 6, "y", 2, 1, None), ("a", 1, 7, "x", None, 1, 1)]
    d = spark.createDataFrame(rows, "Identifier string, TrialNumber int, id int, name string, grp int, s1 int, s2 int")
    got = by_cell(I.score_pair(d, "name", ["s1", "s2"]), "name_point", "rating_point", "payoff")
    assert got["a", 1, 1] == (1, 1, 2) and got["a", 1, 3] == (0, 0, 0)
    assert got["a", 1, 5] == (0, 0, 0) and got["a", 1, 7] == (0, 0, 0)
    gains = I.decode_payoff("payoff", F.col("name_point") == 1)
    back = I.score_pair(d, "name", ["s1", "s2"]).where("id = 1").select(*[c.alias(k) for k, c in gains.items()]).first()
    assert tuple(back) == (1, 1)


def test_counts_match_python(log):
    want = Counter((r.Identifier, r.TrialNumber, r.Response) for r in log.collect() if r.Response is not None)
    assert {(r.Identifier, r.TrialNumber, r.Response): r.n for r in I.response_counts(log).collect()} == dict(want)


def test_respondents_and_scores(log):
    d = I.respondents(log)
    assert {r.NumRespondents for r in d.collect()} == {4}
    s = by_cell(I.running_score(I.attach_partner(log)), "score")
    assert s["b", 3, 2] == (1,) and s["a", 3, 1] == (2,)


def test_edges(spark):
    e = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (1, 3)], "u long, v long")
    assert {tuple(r) for r in R.edge_canonical(e).collect()} == {(1, 2), (1, 3)}
    m = spark.createDataFrame([(0, [0, 1, 1]), (1, [1, 0, 0])], "node int, row array<int>")
    assert {tuple(r) for r in R.adjacency_to_edges(m).collect()} == {(0, 1), (0, 2), (1, 0)}
    assert {r.u: r.neighbours for r in R.neighbour_lists(R.adjacency_to_edges(m)).collect()} == {0: [1, 2], 1: [0]}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
def test_paired_log_scans_events_once(spark):
    """Bucket sizes and rows of the paired view come from one exchange."""
    from pairlog.sources.canonical import Tables
    paired = I.attach_partner(Tables(spark, "/root/testdata/sf0.001").interactions())
    paired.collect()
    plan = paired._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_sixty_days_lose_nothing(spark, tmp_path):
    """Trials count on over months: every user's last answer of every day is there."""
    from pairlog.sources.canonical import Tables
    start = dt.datetime(2024, 1, 1, 12)
    rows = [(u * 100 + d, start + dt.timedelta(days=d, minutes=u), u, "a", 1.0) for u in range(6) for d in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double") \
        .write.parquet(str(tmp_path / "events.parquet"))
    log = Tables(spark, str(tmp_path)).interactions()
    assert log.count() == 360 and {r[0] for r in log.select("TrialNumber").distinct().collect()} == set(range(1, 61))


def test_rows_without_keys_are_numbered(spark):
    """NULL in a partition or in the bucket's column: no row is lost."""
    from pairlog.operators.ranking import bucketed_row_number
    rows = [("a", 5), ("a", None), ("a", 70), (None, 1), (None, None), (None, 99)]
    d = spark.createDataFrame(rows, "run string, v int")
    got = {(r.run, r.v): r.pos for r in bucketed_row_number(d, F.floor(F.col("v") / 16), ["v"], ["run"]).collect()}
    assert got == {("a", None): 0, ("a", 5): 1, ("a", 70): 2, (None, None): 0, (None, 1): 1, (None, 99): 2}
    assert sorted(r.pos for r in bucketed_row_number(d, F.floor(F.col("v") / 16), ["v"]).collect()) == list(range(6))
