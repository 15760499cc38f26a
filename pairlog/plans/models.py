"""Regression fits over the whole log. SQL has no solver: the twins say that the score equations hold at the estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import DECISIONS
from ..operators import decisions as D, entropy as E, interactions as I, models as M
from .interactions import coordinated
from .registry import query


def full(t):
    d = D.label_decisions(t.interactions())
    return d.join(I.run_sizes(t.log()), I.RUN)


def _terms(names, n: str) -> str:
    """The twin of a fit: every score is zero, over all rows of the log."""
    return f"SELECT unnest({list(names)}) AS term, ({n}) AS n, 0.0::DOUBLE AS score"


def dominance_rows(t):
    log = t.log()
    return I.dominant_response(log).join(I.run_sizes(log), I.RUN)


@query("fit_dominance")
def _(t):
    return M.fit_dominance(dominance_rows(t))


@query("fit_dominance_score", _terms(["Intercept", *M.INTERACTED], "SELECT count(*) FROM (SELECT DISTINCT Identifier, TrialNumber FROM v_log)"))
def _(t):
    d = dominance_rows(t)
    return M.score_equations(d, M.fit_dominance(d), M.INTERACTED, M.inner_share(), "beta", M.PRIORS["dominance"])


def entropy_rows(t):
    log = t.log()
    e = E.entropy_shift(E.trial_entropy(log, (I.RUN, *I.CONDITION, I.TRIAL)))
    return e.join(I.run_sizes(log), I.RUN)


@query("fit_entropy")
def _(t):
    return M.fit_entropy(entropy_rows(t))


@query("fit_entropy_score", _terms(["Intercept", *M.INTERACTED], "SELECT count(*) FROM (SELECT DISTINCT Identifier, TrialNumber FROM v_log WHERE Response IS NOT NULL)"))
def _(t):
    d = entropy_rows(t)
    return M.score_equations(d, M.fit_entropy(d), M.INTERACTED, F.col("EntropyDifference"), "gaussian", M.PRIORS["entropy"])


def coordination_rows(t):
    return coordinated(t).join(I.run_sizes(t.log()), I.RUN)


@query("fit_coordination")
def _(t):
    return M.fit_coordination(coordination_rows(t))


@query("fit_coordination_score", _terms(["Intercept", *M.INTERACTED], "SELECT count(*) FROM v_log"))
def _(t):
    d = coordination_rows(t)
    return M.score_equations(d, M.fit_coordination(d), M.INTERACTED, F.col("Coordinate"), "bernoulli", M.PRIORS["coordination"])


@query("fit_decision_type")
def _(t):
    return M.fit_decision_type(full(t))


@query("fit_decision_type_score", f"""
    SELECT decision, term, n, score FROM ({_terms(["Intercept", *M.SAMPLED], "SELECT count(*) FROM v_dec")}),
      (SELECT unnest({list(DECISIONS[1:])}) AS decision)""")
def _(t):
    d = full(t)
    return M.score_equations(d, M.fit_decision_type(d), M.SAMPLED, M.decision_class(), "categorical", M.PRIORS["decision"])


@query("fit_decision_coordination")
def _(t):
    return M.fit_decision_coordination(full(t))


@query("fit_decision_coordination_score", _terms(["Intercept", *M.BY_DECISION], "SELECT count(*) FROM v_dec"))
def _(t):
    d = full(t)
    return M.score_equations(d, M.fit_decision_coordination(d), M.BY_DECISION, F.col("Coordinate"), "bernoulli", M.PRIORS["coordination"])


@query("conditional_effects")
def _(t):
    d = full(t)
    return M.conditional_effects(d, M.fit_decision_coordination(d), M.BY_DECISION)


@query("design_factors", """
    SELECT TrialNumber, Spatial, Hashtag, TrialNumber * Spatial * Hashtag AS triple, count(*) AS n FROM (
      SELECT TrialNumber, CASE WHEN Structure = 'Spatial' THEN 1.0::DOUBLE ELSE 0 END AS Spatial,
             CASE WHEN Content = 'Hashtag' THEN 1.0::DOUBLE ELSE 0 END AS Hashtag FROM v_log) GROUP BY ALL""")
def _(t):
    p = t.log().groupBy("TrialNumber", "Structure", "Content").agg(F.count(F.lit(1)).alias("n"))
    d = M.design_factors(p, ["Spatial", "Hashtag", "TrialNumber:Spatial:Hashtag"])
    return d.groupBy("TrialNumber", F.col("x0").alias("Spatial"), F.col("x1").alias("Hashtag"), F.col("x2").alias("triple")).agg(
        F.sum("n").alias("n"))
