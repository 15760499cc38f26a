"""The Newton fits: special functions, derivatives, modes, priors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlog.functions import special as S
from pairlog.functions.scalar import DECISIONS
from pairlog.operators import models as M, regression as R


def column_values(spark, fn, xs):
    d = spark.createDataFrame([(float(x),) for x in xs], "x double")
    return [r[0] for r in d.select(fn(F.col("x"))).collect()]


def test_special_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 55.5, 1e4, 1e8]
    assert column_values(spark, S.log_gamma, xs) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-11)
    euler = 0.57721566490153286
    known = {1.0: -euler, 0.5: -euler - 2 * math.log(2), 2.0: 1 - euler, 0.25: -euler - math.pi / 2 - 3 * math.log(2)}
    assert column_values(spark, S.digamma, known) == pytest.approx(list(known.values()), abs=1e-12)
    known = {1.0: math.pi ** 2 / 6, 0.5: math.pi ** 2 / 2, 2.0: math.pi ** 2 / 6 - 1}
    assert column_values(spark, S.trigamma, known) == pytest.approx(list(known.values()), abs=1e-12)
    assert [R._digamma(x) for x in (0.5, 3.7, 200.0)] == pytest.approx(column_values(spark, S.digamma, [0.5, 3.7, 200.0]), abs=1e-12)
    assert [R._trigamma(x) for x in (0.5, 3.7, 200.0)] == pytest.approx(column_values(spark, S.trigamma, [0.5, 3.7, 200.0]), abs=1e-12)


def patterns(spark, label, n=60):
    rng = random.Random(2)
    rows = [(rng.uniform(-1, 3), float(rng.randrange(2)), label(rng), float(rng.randrange(1, 4))) for _ in range(n)]
    return spark.createDataFrame(rows, "x0 double, x1 double, label double, weight double")


FAMILIES = {
    "bernoulli": (R.bernoulli, 1, [], lambda r: float(r.random() < 0.6)),
    "gaussian": (R.gaussian, 1, ["log_sigma"], lambda r: r.gauss(1, 2)),
    "categorical": (R.categorical, 3, [], lambda r: float(r.randrange(4))),
    "beta": (R.beta, 1, ["log_phi"], lambda r: min(0.99, max(0.01, r.random()))),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_derivatives(spark, name):
    """Gradient and Hessian against differences of the value and of the gradient (the Beta Hessian is an expected one)."""
    family, k, extra, label = FAMILIES[name]
    d = patterns(spark, label, 25).coalesce(1).cache()
    size = 3 * k + len(extra)
    theta = np.linspace(-0.3, 0.4, size)
    at = lambda t: R.derivatives(d, ["x0", "x1"], family, t[:3 * k].reshape(k, 3), np.array([0.5, 0.25]), dict(zip(extra, t[3 * k:])))
    _, g, h = at(theta)
    assert (h == h.T).all()
    for i in range(size):
        e = np.zeros(size)
        e[i] = 1e-5
        up, down = at(theta + e), at(theta - e)
        assert (up[0] - down[0]) / 2e-5 == pytest.approx(g[i], rel=1e-5, abs=1e-5)
        if name != "beta":
            assert (up[1] - down[1]) / 2e-5 == pytest.approx(h[i], rel=1e-4, abs=1e-4)
    assert (np.linalg.eigvalsh(h) < 0).all() or name == "gaussian"


def test_gaussian_mode_is_least_squares(spark):
    d = patterns(spark, lambda r: r.gauss(1, 2), 200)
    f = R.fit(d, ["x0", "x1"], R.gaussian, R.Prior(1e6, 1e6), extra={"log_sigma": R.Extra(0.0, lambda t: (0.0, 0.0, 0.0))})
    rows = np.array([tuple(r) for r in d.collect()])
    x, w = np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 3]
    b = np.linalg.solve((x.T * w) @ x, (x.T * w) @ rows[:, 2])
    sigma = math.sqrt(float(w @ (rows[:, 2] - x @ b) ** 2) / w.sum())
    assert [f.intercept[0], *f.slopes[0], f.extra["log_sigma"]] == pytest.approx([*b, sigma], rel=1e-8)


def test_the_prior_holds_what_the_data_leave_free(spark):
    """A covariate that separates the answers, and one that is constant: finite estimates, and the constant has none."""
    d = spark.createDataFrame([(float(i >= 5), 2.0, float(i >= 5), 1.0) for i in range(10)], "x0 double, x1 double, label double, weight double")
    f = R.fit(d, ["x0", "x1"], R.bernoulli, R.Prior(5.0))
    assert 3 < f.slopes[0, 0] < 30 and abs(f.slopes[0, 1]) < 1e-9 and f.steps < 40
    wide = R.fit(d, ["x0", "x1"], R.bernoulli, R.Prior(50.0))
    assert wide.slopes[0, 0] > f.slopes[0, 0]


def test_nothing_to_fit(spark):
    d = spark.createDataFrame([], "x0 double, label double, weight double")
    f = R.fit(d, ["x0"], R.bernoulli, R.Prior(5.0))
    assert f.intercept.tolist() == [0.0] and f.slopes.tolist() == [[0.0]]


def log(spark, n=1500):
    rng = random.Random(4)
    rows = []
    for _ in range(n):
        t, s, c = rng.randrange(1, 41), rng.choice(["Homogeneous", "Spatial"]), rng.choice(["Face", "Hashtag"])
        d = rng.choices(DECISIONS, [1, 1 + t / 20, 2, 1])[0]
        mu = 1 / (1 + math.exp(1 - 0.05 * t))
        rows.append((t, s, c, rng.choice([20, 50, 100]), d, int(rng.random() < 0.5), rng.gauss(0.1 * t, 1.5), rng.betavariate(8 * mu, 8 * (1 - mu)), 20))
    return spark.createDataFrame(rows, "TrialNumber int, Structure string, Content string, Size int, DecisionType string, Coordinate int, "
                                       "EntropyDifference double, DomResponseProp double, NumRespondents int").cache()


def test_scores_are_zero_at_the_mode(spark):
    d = log(spark)
    for fit, terms, label, family, prior in (
            (M.fit_dominance, M.INTERACTED, M.inner_share(), "beta", "dominance"),
            (M.fit_entropy, M.INTERACTED, F.col("EntropyDifference"), "gaussian", "entropy"),
            (M.fit_coordination, M.INTERACTED, F.col("Coordinate"), "bernoulli", "coordination"),
            (M.fit_decision_type, M.SAMPLED, M.decision_class(), "categorical", "decision"),
            (M.fit_decision_coordination, M.BY_DECISION, F.col("Coordinate"), "bernoulli", "coordination")):
        found = fit(d)
        scores = M.score_equations(d, found, terms, label, family, M.PRIORS[prior]).collect()
        assert len(scores) == (1 + len(terms)) * (3 if family == "categorical" else 1)
        assert all(r.n == 1500 and abs(r.score) < 1e-6 for r in scores), family
        first = found.columns.index("estimate")
        moved = spark.createDataFrame([(*r[:first], r[first] + (0.01 if r.term == "Size" else 0)) for r in found.collect()], found.schema)
        assert max(abs(r.score) for r in M.score_equations(d, moved, terms, label, family, M.PRIORS[prior]).collect()) > 1


def test_beta_recovers(spark):
    d = log(spark, 4000)
    f = {r.term: r.estimate for r in M.fit_dominance(d).collect()}
    assert f["phi"] == pytest.approx(8, rel=0.1) and f["TrialNumber"] == pytest.approx(0.05, abs=0.01)
    assert {r.term for r in M.fit_entropy(d).collect()} == {"Intercept", "sigma", *M.INTERACTED}


def test_shares_of_zero_and_one(spark):
    d = spark.createDataFrame([(0.0, 4), (1.0, 4), (0.5, 4), (1.0, 1), (None, 3)], "DomResponseProp double, NumRespondents int")
    assert [r[0] for r in d.select(M.inner_share()).collect()] == [0.125, 0.875, 0.5, 0.5, None]
