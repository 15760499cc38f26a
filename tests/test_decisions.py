import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairlog.operators import decisions as D, interactions as I


@pytest.fixture(scope="module")
def played(spark):
    """A random game of 3 runs, 8 people, 12 trials, a few people away or silent."""
    rng = random.Random(4)
    rows = []
    for run in range(3):
        for t in range(1, 13):
            people = [p for p in range(8) if rng.random() > 0.1]
            rng.shuffle(people)
            for i, p in enumerate(people):
                rows.append((f"r{run}", "Spatial" if run else "Homogeneous", "Face", p, t,
                             None if rng.random() < 0.05 else rng.choice("abcde"), i // 2))
    return spark.createDataFrame(rows, "Identifier string, Structure string, Content string, id int, TrialNumber int, Response string, grp int")


def brute_force(played):
    pairs, people = defaultdict(dict), defaultdict(list)
    for r in played.collect():
        pairs[r.Identifier, r.TrialNumber, r.grp][r.id] = r.Response
        people[r.Identifier, r.id].append((r.TrialNumber, r.Response, r.grp))
    out = {}
    for (run, p), turns in people.items():
        seen, prev, partner_prev, weights, total, memory = set(), None, None, defaultdict(int), 0, set()
        for t, answer, grp in sorted(turns, key=lambda x: x[0]):
            others = [a for q, a in pairs[run, t, grp].items() if q != p]
            partner = others[0] if others else None
            label = (None if answer is None else "RS" if answer == prev else "RP" if answer == partner_prev
                     else "EC" if answer in seen else "BN")
            won = answer is not None and answer == partner
            out[run, p, t] = dict(label=label, weight=weights[answer] if answer is not None else 0, total=total,
                                  in_memory=partner in memory, partner=partner)
            seen |= {x for x in (answer, partner) if x is not None}
            if partner is not None:
                gain = 50 * t if won else t
                weights[partner] += gain
                total += gain
                memory = {partner} if won else memory | {partner}
            prev, partner_prev = answer, partner
    return out


def test_labels_against_brute_force(played):
    want = brute_force(played)
    got = {(r.Identifier, r.id, r.TrialNumber): r.DecisionType for r in D.label_decisions(played).collect()}
    assert got == {k: v["label"] for k, v in want.items()}
    assert set(got.values()) == {"BN", "EC", "RS", "RP", None}


def test_context_weights_against_brute_force(played):
    want = brute_force(played)
    got = D.context_weights(D.label_decisions(played)).where("Response is not null").collect()
    assert got and all((r.weight, r.total) == (want[r.Identifier, r.id, r.TrialNumber]["weight"],
                                               want[r.Identifier, r.id, r.TrialNumber]["total"]) for r in got)


def test_memory_against_brute_force(played):
    want = brute_force(played)
    got = {(r.Identifier, r.id, r.TrialNumber): r.in_memory for r in D.memory_since_reset(I.attach_partner(played)).collect()}
    assert got == {k: v["in_memory"] for k, v in want.items() if v["partner"] is not None}
    assert set(got.values()) == {True, False}


def test_tie_policies(log):
    rs, rp = (D.label_decisions(log, tie).where("rs_rp_tie").collect() for tie in ("RS", "RP"))
    assert {r.DecisionType for r in rs} == {"RS"} and {r.DecisionType for r in rp} == {"RP"} and len(rs) == len(rp) > 0


def test_propensities_sum_to_one(played):
    p = D.strategy_propensity(D.label_decisions(played), 0.4, 0.7)
    total = p.select((F.col("p_BN") + F.col("p_EC") + F.col("p_RP") + F.col("p_RS")).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in total)
    assert p.where("TrialNumber = 1 and p_EC <> 0").count() == 0


def test_likelihood_against_rows(played):
    """Counting by state gives the sum over rows, the floored ones included."""
    labelled = D.label_decisions(played).where("DecisionType is not null")
    got = {(r.Structure, round(r.alpha, 1)): r.loglik for r in D.propensity_likelihood(labelled).collect()}
    for alpha in (0.0, 0.4, 10.0):
        want = defaultdict(float)
        for r in D.strategy_propensity(labelled, alpha).where("next is not null").collect():
            want[r.Structure] += math.log(max(r[f"p_{r.next}"], D.FLOOR))
        for s, v in want.items():
            assert got[s, alpha] == pytest.approx(v, rel=1e-9)
    best = {r.Structure: r for r in D.propensity_fit(labelled).collect()}
    for s in best:
        assert best[s].loglik == pytest.approx(max(v for (k, _), v in got.items() if k == s), abs=1e-5)


def test_no_extra_shuffle(played):
    """Pairs cost one exchange and participants one, over the log itself."""
    plan = D.context_weights(D.label_decisions(played))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
