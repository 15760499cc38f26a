"""Curves of observed and counterfactual answers, distances, sweep selection.

Three curves per condition stand for human data and two models: the entropy of the answers
given (Observed), of each participant's previous answer (Repeat: everyone repeats), and of
the partner's previous answer (Copy: everyone copies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as V, decisions as D, entropy as E, interactions as I, reshape as R
from .interactions import labelled
from .registry import query, r6

MODELS = {"Observed": "Response", "Repeat": "prev_response", "Copy": "partner_prev_response"}
STRUCTURES, CONTENTS = ["Homogeneous", "Spatial"], ["Hashtag", "Face"]
NAMES = [f"{m} {s} {c}" for c in CONTENTS for s in STRUCTURES for m in MODELS]


def model_entropies(t):
    """(Model, Structure, Content, Identifier, TrialNumber, value): normalised entropy. The
    three answers of a row are unfolded once and counted together."""
    d = I.previous_responses(I.attach_partner(t.interactions()))
    long = d.select(I.RUN, *I.CONDITION, I.TRIAL, F.explode(F.array(*[
        F.struct(F.lit(m).alias("Model"), F.col(c).alias("Response")) for m, c in MODELS.items()])).alias("x"))
    long = long.select(I.RUN, *I.CONDITION, I.TRIAL, "x.Model", "x.Response")
    e = E.trial_entropy(long, ("Model", I.RUN, *I.CONDITION, I.TRIAL), base=2)
    return E.normalized_entropy(e, I.run_sizes(t.log())).withColumn("value", F.col("normalized"))


def wide(t):
    return V.model_comparison_table(model_entropies(t), list(MODELS), STRUCTURES, CONTENTS)


def long(t):
    return R.curves_long(wide(t)).where(F.col("Entropy").isNotNull())


WIDE_SQL = 'SELECT TrialNumber AS "Trial", ' + ", ".join(
    f"""{r6(f"avg(value) FILTER (concat(Model, ' ', Structure, ' ', Content) = '{n}')")} AS "{n}" """ for n in NAMES) + " FROM v_models GROUP BY ALL"


@query("model_comparison_table", WIDE_SQL)
def _(t):
    return wide(t)


@query("pivot_long", f"""
    SELECT TrialNumber AS "Trial", Model, Structure, Content, {r6('avg(value)')} AS Entropy FROM v_models GROUP BY ALL""")
def _(t):
    return long(t)


@query("duplicate_reference_rows", f"""
    SELECT Trial, CASE WHEN Model = 'Observed' THEN m ELSE Model END AS Model, Structure, Content, {r6('Entropy')} AS Entropy,
           CASE WHEN Model = 'Observed' THEN 'Human' ELSE 'Simulation' END AS Marking
    FROM v_curves JOIN (SELECT unnest(['Repeat', 'Copy']) AS m) ON Model = 'Observed' OR m = Model""")
def _(t):
    return R.duplicate_reference_rows(long(t), "Observed", ["Repeat", "Copy"])


_GAP = """SELECT a.Trial, a.Model, a.Structure, a.Content, abs(b.Entropy - a.Entropy) AS gap FROM v_curves a
    JOIN v_curves b ON b.Model = 'Observed' AND a.Model <> 'Observed' AND a.Trial = b.Trial AND a.Structure = b.Structure AND a.Content = b.Content"""


@query("difference_curves", f"SELECT Trial, Model, Structure, Content, {r6('gap')} AS gap FROM ({_GAP})")
def _(t):
    return V.difference_curves(long(t), "Observed")


@query("mean_abs_gap", f"""
    SELECT Model, Structure, Content, {r6('avg(gap)')} AS mean_gap, {r6('sqrt(sum(gap * gap))')} AS l2_gap FROM ({_GAP}) GROUP BY ALL""")
def _(t):
    return V.mean_abs_gap(V.difference_curves(long(t), "Observed"))


@query("curve_distance", f"""
    SELECT Identifier, Structure, Content, {r6('sqrt(sum(power(target - coalesce(value, 0), 2)))')} AS distance
    FROM (SELECT c.Identifier, c.Structure, c.Content, g.target, o.value FROM v_cond c
          JOIN (SELECT Structure, Content, TrialNumber, avg(value) AS target FROM v_models WHERE Model = 'Observed' GROUP BY ALL) g
            ON g.Structure = c.Structure AND g.Content = c.Content
          LEFT JOIN (SELECT * FROM v_models WHERE Model = 'Observed') o ON o.Identifier = c.Identifier AND o.TrialNumber = g.TrialNumber)
    GROUP BY ALL""")
def _(t):
    log = t.log()
    e = E.trial_entropy(log, (I.RUN, *I.CONDITION, I.TRIAL), base=2)
    own = E.normalized_entropy(e, I.run_sizes(log)).select(I.RUN, *I.CONDITION, I.TRIAL, F.col("normalized").alias("value"))
    target = own.groupBy(*I.CONDITION, I.TRIAL).agg(F.avg("value").alias("target"))
    return V.curve_distance(own, target, [I.RUN], list(I.CONDITION))


_SWEEP = """
    SELECT Identifier, Structure, Content, alpha, sqrt(sum(power(o - m, 2))) AS distance FROM (
      SELECT Identifier, Structure, Content, nxt_trial, alpha, avg(CASE WHEN nxt = 'BN' THEN 1.0::DOUBLE ELSE 0 END) AS o,
             avg(alpha / (TrialNumber + rp_pts + ec_pts + rs_pts + alpha)) AS m
      FROM v_strategy CROSS JOIN v_alpha WHERE nxt IS NOT NULL GROUP BY ALL) GROUP BY ALL"""
_SUMMARY = f"SELECT Structure, Content, alpha, avg(distance) AS distance FROM ({_SWEEP}) GROUP BY ALL"


@query("propensity_sweep", f"SELECT Identifier, Structure, Content, {r6('alpha')} AS alpha, {r6('distance')} AS distance FROM ({_SWEEP})")
def _(t):
    return D.propensity_sweep(labelled(t))


@query("sweep_summary", f"SELECT Structure, Content, {r6('alpha')} AS alpha, {r6('distance')} AS distance FROM ({_SUMMARY})")
def _(t):
    return V.sweep_summary(D.propensity_sweep(labelled(t)))


@query("select_alpha", f"""
    SELECT Content, {r6('alpha')} AS alpha, {r6('z')} AS normalized FROM (
      SELECT *, row_number() OVER (PARTITION BY Content ORDER BY round(z, 9), alpha) AS rn FROM (
        SELECT Content, alpha, y / max(y) OVER (PARTITION BY Content) AS z FROM (
          SELECT Content, alpha, avg(x) AS y FROM (
            SELECT *, distance / max(distance) OVER (PARTITION BY Structure, Content) AS x FROM ({_SUMMARY})) GROUP BY ALL)))
    WHERE rn = 1""")
def _(t):
    return V.select_alpha(V.sweep_summary(D.propensity_sweep(labelled(t))))
