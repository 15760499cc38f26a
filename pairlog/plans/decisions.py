"""Decision labels, memory, and scoring of the choice model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D, interactions as I
from .interactions import labelled
from .registry import query, r6


@query("label_decisions", """
    SELECT Identifier, id, TrialNumber, Response, DecisionType, CASE WHEN DecisionType = 'BN' THEN 'B' ELSE 'C' END AS BC FROM v_dec""")
def _(t):
    return labelled(t).select(I.RUN, I.PERSON, I.TRIAL, "Response", "DecisionType", "BC")


@query("label_bc", """
    SELECT Identifier, TrialNumber, CASE WHEN DecisionType = 'BN' THEN 'B' ELSE 'C' END AS BC, count(*) AS n FROM v_dec GROUP BY ALL""")
def _(t):
    return labelled(t).groupBy(I.RUN, I.TRIAL, D.label_bc().alias("BC")).agg(F.count(F.lit(1)).alias("n"))


@query("label_decisions_partner_first", """
    SELECT Identifier, id, TrialNumber, coalesce(Response = prev_response AND Response = partner_prev_response, false) AS rs_rp_tie,
           CASE WHEN Response = partner_prev_response THEN 'RP' ELSE DecisionType END AS DecisionType FROM v_dec""")
def _(t):
    return D.label_decisions(t.interactions(), tie="RP").select(I.RUN, I.PERSON, I.TRIAL, "rs_rp_tie", "DecisionType")


@query("label_decisions_split_ties")
def _(t):
    return D.label_decisions(t.interactions(), tie="split").groupBy("DecisionType", "rs_rp_tie").agg(
        F.count(F.lit(1)).alias("n"))


@query("split_ties_merged", """
    SELECT Identifier, id, TrialNumber, CASE WHEN Response = prev_response AND Response = partner_prev_response THEN 'RS or RP'
      ELSE DecisionType END AS label FROM v_dec""")
def _(t):
    """A coin decides ties between RS and RP; all other labels stay, and no other label enters a tie."""
    d = D.label_decisions(t.interactions(), tie="split")
    either = F.col("rs_rp_tie") & F.col("DecisionType").isin("RS", "RP")
    return d.select(I.RUN, I.PERSON, I.TRIAL, F.when(either, "RS or RP").otherwise(F.col("DecisionType")).alias("label"))


@query("earlier_context", """
    SELECT Identifier, id, TrialNumber, seen_before,
           (SELECT min(b.TrialNumber) FROM v_paired b WHERE b.Identifier = a.Identifier AND b.id = a.id
              AND (b.Response = a.Response OR b.partner_response = a.Response)) AS first_seen FROM v_dec a""")
def _(t):
    d = D.earlier_context(I.attach_partner(t.interactions()))
    return d.select(I.RUN, I.PERSON, I.TRIAL, "seen_before", "first_seen")


_GAIN = "CASE WHEN partner_response IS NULL THEN 0 WHEN Points = 1 THEN 50 * TrialNumber ELSE TrialNumber END"
_WEIGHTS = f"""
    SELECT a.Identifier, a.id, a.TrialNumber, a.DecisionType,
           CAST(coalesce(sum(CASE WHEN b.partner_response = a.Response THEN b.gain END), 0) AS BIGINT) AS weight,
           CAST(coalesce(sum(b.gain), 0) AS BIGINT) AS total
    FROM v_dec a LEFT JOIN (SELECT *, {_GAIN} AS gain FROM v_paired) b
      ON b.Identifier = a.Identifier AND b.id = a.id AND b.TrialNumber < a.TrialNumber
    GROUP BY ALL"""


@query("context_weights", f"SELECT Identifier, id, TrialNumber, weight, total FROM ({_WEIGHTS})")
def _(t):
    return D.context_weights(labelled(t)).select(I.RUN, I.PERSON, I.TRIAL, "weight", "total")


@query("context_probability", f"""
    SELECT Identifier, id, TrialNumber, {r6('weight / total')} AS p_context FROM ({_WEIGHTS}) WHERE DecisionType = 'EC'""")
def _(t):
    return D.context_probability(D.context_weights(labelled(t))).select(I.RUN, I.PERSON, I.TRIAL, "p_context")


def _p(alpha: str) -> dict[str, str]:
    points = "(rp_pts + ec_pts + rs_pts)"
    bn = f"({alpha} / (TrialNumber + {alpha} + {points}))"
    ec = f"(CASE WHEN TrialNumber > 1 AND has_memory THEN (ec_pts + 3) / ({points} + 20) ELSE 0 END)"
    rp = "((rp_pts + 1) / (rp_pts + rs_pts + 2))"
    return {"BN": bn, "EC": f"(1 - {bn}) * {ec}", "RP": f"(1 - {bn}) * (1 - {ec}) * {rp}",
            "RS": f"(1 - {bn}) * (1 - {ec}) * (1 - {rp})"}


@query("strategy_propensity", "SELECT Identifier, id, TrialNumber, nxt AS next, " + ", ".join(
    f"{r6(p)} AS p_{d}" for d, p in _p("4.9::DOUBLE").items()) + " FROM v_strategy")
def _(t):
    return D.strategy_propensity(labelled(t), 4.9).select(
        I.RUN, I.PERSON, I.TRIAL, "next", "p_BN", "p_EC", "p_RP", "p_RS")


_LOGLIK = f"""
    SELECT Structure, Content, alpha, sum(ln(greatest(CASE nxt {' '.join(f"WHEN '{d}' THEN {p}" for d, p in _p('alpha').items())} END, 1e-9))) AS loglik,
           count(*) AS n FROM v_strategy CROSS JOIN v_alpha WHERE nxt IS NOT NULL GROUP BY ALL"""


@query("propensity_likelihood", f"SELECT Structure, Content, {r6('alpha')} AS alpha, round(loglik, 6) + 0.0 AS loglik, n FROM ({_LOGLIK})")
def _(t):
    return D.propensity_likelihood(labelled(t))


@query("propensity_fit", f"""
    SELECT Structure, Content, {r6('alpha')} AS alpha, round(loglik, 6) + 0.0 AS loglik FROM (
      SELECT *, row_number() OVER (PARTITION BY Structure, Content ORDER BY round(loglik, 6) DESC, alpha) AS rn FROM ({_LOGLIK}))
    WHERE rn = 1""")
def _(t):
    return D.propensity_fit(labelled(t))


@query("memory_since_reset", """
    SELECT a.Identifier, a.id, a.TrialNumber, a.partner_response, CAST(a.segment AS BIGINT) AS segment,
           EXISTS (SELECT 1 FROM v_memory b WHERE b.Identifier = a.Identifier AND b.id = a.id AND b.TrialNumber < a.TrialNumber
                   AND b.partner_response = a.partner_response
                   AND (b.segment = a.segment OR (b.Points = 1 AND b.segment + 1 = a.segment))) AS in_memory
    FROM v_memory a WHERE a.partner_response IS NOT NULL""")
def _(t):
    return D.memory_since_reset(I.attach_partner(t.interactions())).select(
        I.RUN, I.PERSON, I.TRIAL, "partner_response", "segment", "in_memory")
