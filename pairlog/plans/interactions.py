"""Interaction core: partners, dominance, coordination, entropy, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import DECISIONS, IMPRESSIONS
from ..operators import decisions as D, entropy as E, interactions as I, ranking as K, reshape as R
from .registry import query, r6


def coordinated(t, wide=False):
    return I.pair_coordination(t.interactions(wide))


def labelled(t):
    return D.label_decisions(t.interactions())


@query("trial_summary", f"""
    SELECT c.Identifier, c.TrialNumber, {r6('e.entropy')} AS entropy, {r6('e.entropy / log2(s.Size)')} AS normalized,
           d.Response AS DomResponse, d.n AS DomResponseCount, {r6('d.n / c.N')} AS DomResponseProp
    FROM (SELECT Identifier, TrialNumber, count(*) AS N FROM v_log GROUP BY ALL) c
    JOIN v_entropy2 e USING (Identifier, TrialNumber) JOIN v_sizes s USING (Identifier)
    JOIN (SELECT *, row_number() OVER (PARTITION BY Identifier, TrialNumber ORDER BY n DESC, Response) AS rn FROM v_counts) d
      ON d.Identifier = c.Identifier AND d.TrialNumber = c.TrialNumber AND d.rn = 1""")
def trial_summary(t):
    """Flagship: per run and trial, entropy, its share of the maximum, and the dominant answer."""
    log = t.log()
    return E.normalized_entropy(E.trial_profile(log), I.run_sizes(log)).select(
        I.RUN, I.TRIAL, "entropy", "normalized", "DomResponse", "DomResponseCount", "DomResponseProp")


@query("attach_partner", """
    SELECT Identifier, id, TrialNumber, Response, partner_id, partner_response, Points FROM v_paired""")
def _(t):
    return I.attach_partner(t.interactions()).select(
        "Identifier", "id", "TrialNumber", "Response", "partner_id", "partner_response", "Points")


@query("response_counts", "SELECT Identifier, TrialNumber, Response, n FROM v_counts")
def _(t):
    return I.response_counts(t.log())


@query("trial_entropy_nats", f"SELECT Identifier, TrialNumber, {r6('entropy')} AS entropy FROM v_entropy")
def _(t):
    return E.trial_entropy(t.log()).drop("respondents")


@query("trial_entropy_bits", f"SELECT Identifier, TrialNumber, {r6('entropy')} AS entropy FROM v_entropy2")
def _(t):
    return E.trial_entropy(t.log(), base=2).drop("respondents")


@query("normalized_entropy", f"""
    SELECT Identifier, TrialNumber, {r6('entropy / log2(Size)')} AS normalized FROM v_entropy2 JOIN v_sizes USING (Identifier)""")
def _(t):
    log = t.log()
    return E.normalized_entropy(E.trial_entropy(log, base=2), I.run_sizes(log)).select(I.RUN, I.TRIAL, "normalized")


@query("condition_mean_curve", f"""
    SELECT Structure, Content, TrialNumber, {r6('avg(entropy / log2(Size))')} AS mean
    FROM v_entropy2 JOIN v_sizes USING (Identifier) JOIN v_cond USING (Identifier) GROUP BY ALL""")
def _(t):
    log = t.log()
    e = E.trial_entropy(log, (I.RUN, *I.CONDITION, I.TRIAL), base=2)
    return E.condition_mean_curve(E.normalized_entropy(e, I.run_sizes(log)))


@query("entropy_delta_mean", f"""
    SELECT TrialNumber, {r6('avg(d)')} AS mean_delta
    FROM (SELECT TrialNumber, entropy - lag(entropy) OVER (PARTITION BY Identifier ORDER BY TrialNumber) AS d FROM v_entropy2)
    WHERE d IS NOT NULL GROUP BY ALL""")
def _(t):
    return E.entropy_delta_mean(E.trial_entropy(t.log(), base=2))


@query("diff_successive", f"""
    SELECT Identifier, TrialNumber, {r6('entropy - lag(entropy) OVER (PARTITION BY Identifier ORDER BY TrialNumber)')} AS delta
    FROM v_entropy2""")
def _(t):
    return E.diff_successive(E.trial_entropy(t.log(), base=2)).select(I.RUN, I.TRIAL, "delta")


@query("dominant_response", f"""
    SELECT Identifier, TrialNumber, Structure, Content, Response AS DomResponse, n AS DomResponseCount,
           CAST(N_ AS BIGINT) AS NumRespondents, {r6('n / N_')} AS DomResponseProp
    FROM (SELECT *, row_number() OVER (PARTITION BY Identifier, TrialNumber ORDER BY n DESC, Response) AS rn,
                 sum(n) OVER (PARTITION BY Identifier, TrialNumber) AS N_ FROM v_counts) JOIN v_cond USING (Identifier)
    WHERE rn = 1""")
def _(t):
    return I.dominant_response(t.log())


@query("lag_previous", f"""
    SELECT Identifier, TrialNumber, lag(n) OVER w AS DomResponseCountPrev, {r6('lag(n / N_) OVER w')} AS DomResponsePropPrev
    FROM (SELECT *, row_number() OVER (PARTITION BY Identifier, TrialNumber ORDER BY n DESC, Response) AS rn,
                 sum(n) OVER (PARTITION BY Identifier, TrialNumber) AS N_ FROM v_counts) WHERE rn = 1
    WINDOW w AS (PARTITION BY Identifier ORDER BY TrialNumber)""")
def _(t):
    d = I.dominant_response(t.log(), (I.RUN, I.TRIAL))
    out = I.lag_previous(d, {"DomResponseCount": "DomResponseCountPrev", "DomResponseProp": "DomResponsePropPrev"})
    return out.select(I.RUN, I.TRIAL, "DomResponseCountPrev", "DomResponsePropPrev")


@query("pair_coordination", "SELECT Identifier, id, TrialNumber, Coordinate FROM v_coord")
def _(t):
    return coordinated(t).select(I.RUN, I.PERSON, I.TRIAL, "Coordinate")


@query("coordination_rate", f"""
    SELECT Identifier, TrialNumber, Structure, Content, {r6('avg(Coordinate)')} AS GroupCoordRate FROM v_coord GROUP BY ALL""")
def _(t):
    return I.coordination_rate(coordinated(t))


@query("decision_shares", f"""
    SELECT Identifier, Structure, Content, TrialNumber, DecisionType, count(*) AS DTCounts,
           CAST(sum(count(*)) OVER w AS BIGINT) AS NumRespondants, {r6('count(*) / sum(count(*)) OVER w')} AS DTNormed
    FROM v_dec GROUP BY Identifier, Structure, Content, TrialNumber, DecisionType
    WINDOW w AS (PARTITION BY Identifier, TrialNumber)""")
def _(t):
    return I.decision_shares(labelled(t))


@query("decision_shares_by_condition", f"""
    SELECT TrialNumber, DecisionType, Content, Structure, {r6('avg(m)')} AS DTNormedAvg
    FROM (SELECT Structure, Content, Size, TrialNumber, DecisionType, avg(s) AS m
          FROM (SELECT d.Identifier, Structure, Content, Size, TrialNumber, DecisionType,
                       count(*) / sum(count(*)) OVER (PARTITION BY d.Identifier, TrialNumber) AS s
                FROM v_dec d JOIN v_sizes z ON z.Identifier = d.Identifier
                GROUP BY d.Identifier, Structure, Content, Size, TrialNumber, DecisionType)
          GROUP BY ALL) GROUP BY ALL""")
def _(t):
    d = labelled(t)
    shares = I.decision_shares(d).join(I.run_sizes(t.log()), I.RUN)
    return I.decision_shares_by_condition(shares)


@query("coordination_by_decision", f"""
    SELECT d.Structure, d.Content, d.TrialNumber, DecisionType, {r6('avg(Coordinate)')} AS DTCoordAvg
    FROM v_dec d JOIN v_coord c ON c.Identifier = d.Identifier AND c.id = d.id AND c.TrialNumber = d.TrialNumber GROUP BY ALL""")
def _(t):
    return I.coordination_by_decision(labelled(t))


@query("decision_pivot", """
    SELECT Identifier, TrialNumber, count(*) FILTER (DecisionType = 'BN') AS BN, count(*) FILTER (DecisionType = 'EC') AS EC,
           count(*) FILTER (DecisionType = 'RS') AS RS, count(*) FILTER (DecisionType = 'RP') AS RP FROM v_dec GROUP BY ALL""")
def _(t):
    return I.decision_pivot(labelled(t))


def _proportions(size: str) -> str:
    cols = ", ".join(f"{r6(f'avg({d} / {size})')} AS {d}" for d in DECISIONS)
    counts = ", ".join(f"count(*) FILTER (DecisionType = '{d}') AS {d}" for d in DECISIONS)
    return f"""
    SELECT Structure, Content, TrialNumber, {cols}
    FROM (SELECT Identifier, Structure, Content, TrialNumber, {counts} FROM v_dec GROUP BY ALL)
    JOIN v_sizes USING (Identifier) GROUP BY ALL"""


@query("decision_proportion_curves", _proportions("Size"))
def _(t):
    return I.decision_proportion_curves(labelled(t), I.run_sizes(t.log()))


@query("decision_proportion_curves_legacy", _proportions("CASE WHEN Content = 'Hashtag' THEN 20 ELSE Size END"))
def _(t):
    return I.decision_proportion_curves(labelled(t), I.run_sizes(t.log()), F.when(F.col("Content") == "Hashtag", 20).otherwise(F.col("Size")))


@query("points_by_decision", "SELECT DecisionType, CAST(sum(Points) AS BIGINT) AS Points FROM v_dec GROUP BY ALL")
def _(t):
    return I.points_by_decision(labelled(t))


@query("points_per_trial", "SELECT Identifier, TrialNumber, CAST(sum(Points) AS BIGINT) AS Points FROM v_paired GROUP BY ALL")
def _(t):
    return I.points_per_trial(I.attach_partner(t.interactions()))


@query("scored_cells", "SELECT Identifier, TrialNumber - 1 AS x, id - 1 AS y FROM v_paired WHERE Points = 1")
def _(t):
    return I.scored_cells(I.attach_partner(t.interactions()))


_STEPS = "(SELECT *, lead(DecisionType) OVER w AS nxt, lead(TrialNumber) OVER w AS nt FROM v_dec WINDOW w AS (PARTITION BY Identifier, id ORDER BY TrialNumber))"


@query("transition_probs", f"""
    SELECT DecisionType AS "from", nxt AS "to", count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()')} AS p
    FROM {_STEPS} WHERE nxt IS NOT NULL GROUP BY DecisionType, nxt""")
def _(t):
    return I.transition_probs(labelled(t))


@query("transition_probs_conditional", f"""
    SELECT Content, DecisionType AS "from", nxt AS "to", count(*) AS n,
           {r6('count(*) / sum(count(*)) OVER (PARTITION BY Content, DecisionType)')} AS p
    FROM {_STEPS} WHERE nt = TrialNumber + 1 GROUP BY Content, DecisionType, nxt""")
def _(t):
    return I.transition_probs(labelled(t), by=["Content"], conditional=True, strict=True)


@query("next_decision", f"SELECT Identifier, id, TrialNumber, DecisionType, nxt AS next FROM {_STEPS}")
def _(t):
    return I.next_decision(labelled(t)).select(I.RUN, I.PERSON, I.TRIAL, "DecisionType", "next")


@query("prior", f"""
    SELECT Content, Response, n, {r6('n / sum(n) OVER (PARTITION BY Content)')} AS share
    FROM (SELECT Content, Response, count(*) AS n FROM v_wide WHERE TrialNumber = 1 GROUP BY ALL)""")
def _(t):
    return I.prior(t.log(wide=True))


@query("top_k_with_ties", """
    SELECT Content, Response, n FROM (SELECT *, rank() OVER (PARTITION BY Content ORDER BY n DESC) AS r
      FROM (SELECT Content, Response, count(*) AS n FROM v_wide GROUP BY ALL)) WHERE r <= 15""")
def _(t):
    counts = t.log(wide=True).groupBy("Content", "Response").agg(F.count(F.lit(1)).alias("n"))
    return K.top_k_with_ties(counts, "n", 15, ["Content"])


@query("top_k_overall_with_ties", """
    SELECT Response, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r
      FROM (SELECT Response, count(*) AS n FROM v_wide GROUP BY ALL)) WHERE r <= 25""")
def _(t):
    counts = t.log(wide=True).groupBy("Response").agg(F.count(F.lit(1)).alias("n"))
    return K.top_k_with_ties(counts, "n", 25)


@query("top_k_strict", """
    SELECT Response, count(*) AS n FROM v_wide GROUP BY ALL ORDER BY n DESC, Response LIMIT 5""")
def _(t):
    counts = t.log(wide=True).groupBy("Response").agg(F.count(F.lit(1)).alias("n"))
    return K.top_k_strict(counts, "n", 5, "Response")


@query("sort_desc", "SELECT Response, count(*) AS n FROM v_wide GROUP BY ALL ORDER BY n DESC, Response")
def _(t):
    counts = t.log(wide=True).groupBy("Response").agg(F.count(F.lit(1)).alias("n"))
    return K.sort_desc(counts, "n", "Response")


@query("restrict_to_top", """
    SELECT Identifier, TrialNumber, count(*) AS n FROM v_wide WHERE Response IN (
      SELECT Response FROM (SELECT Response, rank() OVER (ORDER BY count(*) DESC) AS r FROM v_wide GROUP BY Response) WHERE r <= 5)
    GROUP BY ALL""")
def _(t):
    log = t.log(wide=True)
    counts = log.groupBy("Response").agg(F.count(F.lit(1)).alias("n"))
    kept = I.restrict_to(log, K.top_k_with_ties(counts, "n", 5), ["Response"])
    return kept.groupBy(I.RUN, I.TRIAL).agg(F.count(F.lit(1)).alias("n"))


@query("trial_response_grid", """
    SELECT g.Identifier, g.TrialNumber, g.Response, coalesce(c.n, 0) AS n
    FROM (SELECT a.Identifier, a.TrialNumber, b.Response FROM (SELECT DISTINCT Identifier, TrialNumber FROM v_wide) a
          JOIN (SELECT Identifier, Response, row_number() OVER (PARTITION BY Identifier ORDER BY count(*) DESC, Response) AS rn
                FROM v_wide GROUP BY Identifier, Response) b ON a.Identifier = b.Identifier AND rn <= 5) g
    LEFT JOIN (SELECT Identifier, TrialNumber, Response, count(*) AS n FROM v_wide GROUP BY ALL) c
      ON c.Identifier = g.Identifier AND c.TrialNumber = g.TrialNumber AND c.Response = g.Response""")
def _(t):
    return I.trial_response_grid(t.log(wide=True))


@query("response_coordination", f"""
    SELECT Content, Response, n, {r6('p')} AS p,
           {r6('(p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)')} AS low,
           {r6('(p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)')} AS high
    FROM (SELECT Content, Response, count(*) AS n, avg(Coordinate) AS p, 1.959963984540054::DOUBLE AS z
          FROM v_wide_coord WHERE (Content, Response) IN (
            SELECT (Content, Response) FROM (SELECT Content, Response, rank() OVER (PARTITION BY Content ORDER BY count(*) DESC) AS r
              FROM v_wide GROUP BY Content, Response) WHERE r <= 25) GROUP BY Content, Response)""")
def _(t):
    # counts of the answers are part of the aggregate, so the top list needs no second pass
    return K.top_k_with_ties(I.response_coordination(coordinated(t, wide=True)), "n", 25, ["Content"])


@query("n_unique", """
    SELECT Structure, Content, count(DISTINCT id) AS n_unique FROM v_log GROUP BY ALL""")
def _(t):
    return I.n_unique(t.log(), "id", ["Structure", "Content"])


@query("n_unique_approximate")
def _(t):
    return I.n_unique(t.log(), "id", ["Structure", "Content"], approximate=True)


@query("n_unique_approximate_bounds", "SELECT DISTINCT Structure, Content, true AS within_a_fifth FROM v_log")
def _(t):
    """The sketch's standard error is 5 %; four of them around the exact count."""
    log, by = t.log(), ["Structure", "Content"]
    exact = I.n_unique(log, "id", by).withColumnRenamed("n_unique", "exact")
    both = I.n_unique(log, "id", by, approximate=True).join(exact, by)
    return both.select(*by, (F.abs(F.col("n_unique") - F.col("exact")) <= 0.2 * F.col("exact")).alias("within_a_fifth"))


@query("linear_trend", f"""
    SELECT Identifier, {r6('regr_slope(entropy, TrialNumber)')} AS slope, {r6('regr_intercept(entropy, TrialNumber)')} AS intercept
    FROM v_entropy2 GROUP BY ALL""")
def _(t):
    return E.linear_trend(E.trial_entropy(t.log(), base=2))


@query("distinct_trials", """
    SELECT Identifier, TrialNumber, id, Response, grp FROM (
      SELECT *, row_number() OVER (PARTITION BY Identifier, TrialNumber ORDER BY id) AS rn FROM v_log) WHERE rn = 1""")
def _(t):
    return I.distinct_trials(t.interactions().select(I.RUN, I.TRIAL, "id", "Response", "grp"))


@query("distinct_rows", "SELECT DISTINCT Identifier, Structure, Content FROM v_log")
def _(t):
    return R.distinct_rows(t.log(), ["Identifier", "Structure", "Content"])


@query("condition_rollup", f"""
    SELECT TrialNumber, Content, Structure, Size,
           CAST(grouping(Content) + grouping(Structure) + grouping(Size) AS INT) AS grain,
           {r6('avg(entropy / log2(Size_))')} AS mean, count(*) AS n
    FROM (SELECT TrialNumber, Content, Structure, Size, Size AS Size_, entropy FROM v_entropy2
          JOIN v_sizes USING (Identifier) JOIN v_cond USING (Identifier))
    GROUP BY GROUPING SETS ((TrialNumber, Content, Structure, Size), (TrialNumber, Content, Structure), (TrialNumber, Content), (TrialNumber))""")
def _(t):
    log = t.log()
    e = E.trial_entropy(log, (I.RUN, *I.CONDITION, I.TRIAL), base=2)
    return E.condition_rollup(E.normalized_entropy(e, I.run_sizes(log)), "normalized")


@query("entropy_shift", f"""
    SELECT Identifier, TrialNumber, {r6('entropy - first_value(entropy) OVER (PARTITION BY Identifier ORDER BY TrialNumber)')} AS EntropyDifference
    FROM v_entropy""")
def _(t):
    return E.entropy_shift(E.trial_entropy(t.log())).select(I.RUN, I.TRIAL, "EntropyDifference")


@query("previous_responses", """
    SELECT Identifier, id, TrialNumber, prev_response, partner_prev_response FROM v_prev""")
def _(t):
    return I.previous_responses(I.attach_partner(t.interactions())).select(
        I.RUN, I.PERSON, I.TRIAL, "prev_response", "partner_prev_response")


@query("respondents", """
    SELECT Identifier, id, TrialNumber, count(*) OVER (PARTITION BY Identifier, TrialNumber) AS NumRespondents FROM v_log""")
def _(t):
    return I.respondents(t.log()).select(I.RUN, I.PERSON, I.TRIAL, "NumRespondents")


@query("running_score", """
    SELECT Identifier, id, TrialNumber, CAST(sum(Points) OVER (PARTITION BY Identifier, id ORDER BY TrialNumber) AS BIGINT) AS score
    FROM v_paired""")
def _(t):
    return I.running_score(I.attach_partner(t.interactions())).select(I.RUN, I.PERSON, I.TRIAL, "score")


@query("strategy_points", """
    SELECT Identifier, id, TrialNumber, CAST(rp_pts AS BIGINT) AS rp_pts, CAST(ec_pts AS BIGINT) AS ec_pts,
           CAST(rs_pts AS BIGINT) AS rs_pts FROM v_strategy""")
def _(t):
    return I.strategy_points(labelled(t)).select(I.RUN, I.PERSON, I.TRIAL, "rp_pts", "ec_pts", "rs_pts")


@query("response_code", """
    SELECT Identifier, Response, row_number() OVER (PARTITION BY Identifier ORDER BY a) - 1 AS code FROM (
      SELECT Identifier, Response, min({'id': id, 't': TrialNumber}) AS a FROM v_wide GROUP BY ALL)""")
def _(t):
    return I.response_code(t.log(wide=True))


@query("union_tables", """
    SELECT Response, n, 'Face' AS Type, NULL::BIGINT AS pairs FROM (SELECT Response, count(*) AS n FROM v_log WHERE Content = 'Face' GROUP BY ALL)
    UNION ALL SELECT Response, n, 'Hashtag', p FROM (SELECT Response, count(*) AS n, count(DISTINCT (Identifier, TrialNumber, grp)) AS p
      FROM v_log WHERE Content = 'Hashtag' GROUP BY ALL)""")
def _(t):
    log = t.interactions()
    face = (R.filter_condition(log, Content="Face").groupBy("Response").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("Type", F.lit("Face")))
    per_pair = (R.filter_condition(log, Content="Hashtag").groupBy("Response", I.RUN, I.TRIAL, I.PAIR)
                .agg(F.count(F.lit(1)).alias("n")))
    tag = (per_pair.groupBy("Response").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
           .withColumn("Type", F.lit("Hashtag")))
    return R.union_tables(face, tag)


@query("pivot_wide", "SELECT Identifier, id, " + ", ".join(
    f"max(Response) FILTER (TrialNumber = {i}) AS TrialNumber_{i}" for i in range(1, 31)) + " FROM v_log GROUP BY ALL")
def _(t):
    log = t.log()
    trials = sorted(r[0] for r in log.select("TrialNumber").distinct().collect())  # they become columns
    return R.pivot_wide(log, ["Identifier", "id"], "TrialNumber", "Response", trials)


@query("score_pair", """
    SELECT a.Identifier, a.id, a.TrialNumber,
           CAST(coalesce(a.name <> '' AND lower(a.name) = lower(b.name), false) AS INT) AS name_point,
           CAST(coalesce(a.rating = b.rating, false) AS INT) AS rating_point,
           CAST(coalesce(a.name <> '' AND lower(a.name) = lower(b.name), false) AS INT) + CAST(coalesce(a.rating = b.rating, false) AS INT) AS payoff
    FROM v_names a LEFT JOIN v_names b ON a.Identifier = b.Identifier AND a.TrialNumber = b.TrialNumber AND a.grp = b.grp AND a.id <> b.id""")
def _(t):
    return I.score_pair(t.ratings(), "name", IMPRESSIONS).select(
        I.RUN, I.PERSON, I.TRIAL, "name_point", "rating_point", "payoff")


@query("decode_payoff", """
    SELECT name_gain, rating_gain, count(*) AS n FROM (
      SELECT CAST(coalesce(a.name <> '' AND lower(a.name) = lower(b.name), false) AS INT) AS name_gain,
             CAST(coalesce(a.rating = b.rating, false) AS INT) AS rating_gain
      FROM v_names a LEFT JOIN v_names b ON a.Identifier = b.Identifier AND a.TrialNumber = b.TrialNumber AND a.grp = b.grp AND a.id <> b.id)
    GROUP BY ALL""")
def _(t):
    d = I.score_pair(t.ratings(), "name", IMPRESSIONS)
    gains = I.decode_payoff("payoff", F.col("name_point") == 1)
    return d.groupBy(*[c.alias(k) for k, c in gains.items()]).agg(F.count(F.lit(1)).alias("n"))
