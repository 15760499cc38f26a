"""Claims, shifts and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import significance_stars
from ..functions.special import student_t_p
from ..operators import claims as C, hypothesis as H, models as M, reshape as R
from .registry import query, r6, t_tail

REL = ("Structure", "Content", "cause_topic", "effect_topic")
_MODELLED = ", ".join(f"('{a}', '{b}')" for a, b in C.MODEL_RELATIONS)


def counts(t):
    """Claims per participant and phase; the participant is known on each claim row here."""
    return t.claims().groupBy(*C.AUTHOR, "Phase").agg(F.count(F.lit(1)).alias("n"))


def differences(t):
    return C.prepost_difference(counts(t))


def topics(t):
    return C.with_topics(t.claims())


def shifts(t):
    return C.relation_shifts(topics(t))


def moments(t):
    return C.relation_moments(shifts(t))


def tests(t):
    return H.t_test_from_sums(moments(t), REL)


@query("filter_relations", f"""
    SELECT cause_topic, effect_topic, count(*) AS n FROM v_topics WHERE (cause_topic, effect_topic) IN ({_MODELLED}) GROUP BY ALL""")
def _(t):
    return topics(t).where(C.relation_filter()).groupBy("cause_topic", "effect_topic").agg(F.count(F.lit(1)).alias("n"))


@query("claims_with_authors", """
    SELECT Structure, Content, Size, random_id, Phase, cause, effect FROM v_tweets JOIN v_text_claims ON text = Response""")
def _(t):
    return C.claims_with_authors(t.text_claims(), t.tweets()).select(*C.AUTHOR, "Phase", "cause", "effect")


@query("claim_counts", "SELECT * FROM v_claim_counts")
def _(t):
    return C.claim_counts(t.text_claims(), t.tweets())


@query("missing_participants", """
    SELECT Structure, Content, Size, c_custkey AS random_id, Phase, 0::BIGINT AS n FROM v_customers
    WHERE (c_custkey, Phase) NOT IN (SELECT (o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1998-04-01 00:00:00' THEN 'pre' ELSE 'post' END) FROM orders)""")
def _(t):
    # every customer is asked in both phases; an order stands for a claim
    asked = t.customers()
    orders = t.table("orders").select(F.col("o_custkey").alias("random_id"), t.phase().alias("Phase"))
    made = orders.groupBy("random_id", "Phase").agg(F.count(F.lit(1)).alias("n")).join(asked, ["random_id", "Phase"])
    return C.missing_participants(asked, made)


@query("claim_counts_filled", """
    SELECT Structure, Content, Size, random_id, Phase, count(text) AS n
    FROM v_tweets LEFT JOIN v_text_claims ON text = Response GROUP BY ALL""")
def _(t):
    return C.claim_counts_filled(t.text_claims(), t.tweets())


@query("prepost_difference", "SELECT Structure, Content, Size, random_id, difference FROM v_diffs")
def _(t):
    return differences(t)


@query("sign_summary", """
    SELECT Structure, Content, count(*) FILTER (difference > 0) AS positive_differences, count(*) FILTER (difference = 0) AS zero_differences,
           count(*) FILTER (difference < 0) AS negative_differences, count(*) AS total_differences FROM v_diffs GROUP BY ALL""")
def _(t):
    return C.sign_summary(differences(t))


@query("attach_summary", """
    SELECT random_id, Size, difference, count(*) FILTER (difference > 0) OVER w AS positive_differences,
           count(*) FILTER (difference < 0) OVER w AS negative_differences
    FROM v_diffs WINDOW w AS (PARTITION BY Structure, Content)""")
def _(t):
    d = differences(t)
    return C.attach_summary(d, C.sign_summary(d)).select(
        "random_id", "Size", "difference", "positive_differences", "negative_differences")


@query("difference_stats", f"""
    SELECT Structure, Content, {r6('avg(difference)')} AS mean_difference, {r6('stddev_samp(difference)')} AS sd_difference,
           count(*) AS n_difference, {r6('stddev_samp(difference) / sqrt(count(*))')} AS se_difference FROM v_diffs GROUP BY ALL""")
def _(t):
    return C.difference_stats(differences(t))


@query("sem", f"""
    SELECT Structure, {r6('stddev_samp(difference) / sqrt(count(*))')} AS sem FROM v_diffs GROUP BY ALL""")
def _(t):
    return differences(t).groupBy("Structure").agg(H.sem("difference").alias("sem"))


@query("difference_histogram", f"""
    SELECT Structure, Content, {r6('floor(difference + 0.5) - 0.5')} AS bin, count(*) AS n FROM v_diffs GROUP BY ALL""")
def _(t):
    return C.difference_histogram(differences(t))


@query("relation_counts", """
    SELECT Structure, Content, Size, random_id, Phase, cause_topic, effect_topic, n AS count FROM v_relations""")
def _(t):
    return C.relation_counts(topics(t))


@query("complete", """
    SELECT Structure, Content, Size, random_id, Phase, cause_topic, effect_topic, n AS count FROM v_complete""")
def _(t):
    return C.complete(C.relation_counts(topics(t)), C.AUTHOR, ["Phase", "cause_topic", "effect_topic"], "count")


@query("relation_shifts", """
    SELECT Structure, Content, Size, random_id, cause_topic, effect_topic, CAST(difference AS BIGINT) AS difference
    FROM v_shifts""")
def _(t):
    return C.relation_shifts(C.complete(C.relation_counts(topics(t)), C.AUTHOR, ["Phase", "cause_topic", "effect_topic"], "count"), "count")


@query("unique_signers", """
    SELECT Structure, Content, cause_topic, effect_topic, count(DISTINCT random_id) FILTER (difference > 0) AS unique_positive_count,
           count(DISTINCT random_id) FILTER (difference < 0) AS unique_negative_count
    FROM v_shifts GROUP BY ALL""")
def _(t):
    return C.unique_signers(shifts(t))


@query("signers_total", """
    SELECT Structure, Content, CAST(sum(u) AS BIGINT) AS total_unique_positive_count, CAST(sum(d) AS BIGINT) AS total_unique_negative_count
    FROM (SELECT Structure, Content, cause_topic, effect_topic, count(DISTINCT random_id) FILTER (difference > 0) AS u,
                 count(DISTINCT random_id) FILTER (difference < 0) AS d FROM v_shifts GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return C.signers_total(C.unique_signers(shifts(t)))


@query("cluster_counts", """
    SELECT coalesce(c.ID, e.ID) AS ID, cause_counts, effect_counts
    FROM (SELECT cause_cluster AS ID, count(*) AS cause_counts FROM v_claims GROUP BY 1) c
    FULL JOIN (SELECT effect_cluster AS ID, count(*) AS effect_counts FROM v_claims GROUP BY 1) e ON c.ID = e.ID""")
def _(t):
    return C.cluster_counts(t.claims())


@query("merge_cause_effect", """
    SELECT coalesce(c.ID, e.ID) AS ID, cause_counts, effect_counts
    FROM (SELECT cause_cluster AS ID, count(*) AS cause_counts FROM v_claims GROUP BY 1) c
    FULL JOIN (SELECT effect_cluster AS ID, count(*) AS effect_counts FROM v_claims GROUP BY 1) e ON c.ID = e.ID""")
def _(t):
    c = t.claims()
    cause = c.groupBy(F.col("cause_cluster").alias("ID")).agg(F.count(F.lit(1)).alias("cause_counts"))
    effect = c.groupBy(F.col("effect_cluster").alias("ID")).agg(F.count(F.lit(1)).alias("effect_counts"))
    return C.merge_cause_effect(cause, effect)


@query("signed_counts", "SELECT ID, -cause_counts AS cause_counts, effect_counts, topic_label FROM (" + f"""
    SELECT coalesce(c.ID, e.ID) AS ID, cause_counts, effect_counts,
           CASE coalesce(c.ID, e.ID) {' '.join(f"WHEN {k} THEN '{v}'" for k, v in C.TABLE_TOPICS.items())} END AS topic_label
    FROM (SELECT cause_cluster AS ID, count(*) AS cause_counts FROM v_claims GROUP BY 1) c
    FULL JOIN (SELECT effect_cluster AS ID, count(*) AS effect_counts FROM v_claims GROUP BY 1) e ON c.ID = e.ID)""")
def _(t):
    return C.diverging_table(C.cluster_counts(t.claims()))


def _top(cluster, entity):
    return f"""SELECT {cluster}, {entity}, frequency FROM (SELECT *, rank() OVER (PARTITION BY {cluster} ORDER BY frequency DESC) AS r
      FROM (SELECT {cluster}, {entity}, count(*) AS frequency FROM v_claims GROUP BY ALL)) WHERE r <= 5"""


@query("top_causes_per_cluster", _top("cause_cluster", "cause"))
def _(t):
    return C.top_entities(t.claims(), "cause_cluster", "cause")


@query("top_effects_per_cluster", _top("effect_cluster", "effect"))
def _(t):
    return C.top_entities(t.claims(), "effect_cluster", "effect")


@query("prepost_long", "SELECT random_id, Phase, Response FROM v_tweets")
def _(t):
    return R.prepost_long(t.prepost())


_T1 = f"""
    SELECT *, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END AS t, CASE WHEN sd > 0 THEN n - 1.0::DOUBLE END AS df
    FROM (SELECT Structure, Content, count(*) AS n, avg(difference) AS m, stddev_samp(difference) AS sd FROM v_diffs GROUP BY ALL)"""


@query("t_test_one_sample", f"""
    SELECT Content, Structure, n, {r6('m')} AS estimate, {r6('t')} AS statistic, {r6('df')} AS parameter, {r6(t_tail('t', 'df'))} AS p_value
    FROM ({_T1})""")
def _(t):
    return H.t_test_one_sample(differences(t), "difference", ["Content", "Structure"])


# the oracle materialises every zero of the completed table; the operator does not
_T2 = f"""
    SELECT *, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END AS t, CASE WHEN sd > 0 THEN n - 1.0::DOUBLE END AS df
    FROM (SELECT Structure, Content, cause_topic, effect_topic, count(*) AS n, avg(difference) AS m, stddev_samp(difference) AS sd
          FROM v_shifts GROUP BY ALL)"""
_T2P = f"SELECT *, {t_tail('t', 'df')} AS p FROM ({_T2})"


@query("relation_t_tests", f"""
    SELECT Structure, Content, cause_topic, effect_topic, n, {r6('m')} AS estimate, {r6('t')} AS statistic, {r6('p')} AS p_value
    FROM ({_T2P})""")
def _(t):
    return tests(t).drop("parameter", "_se")


@query("t_test_ci")
def _(t):
    return H.t_test_ci(moments(t))


@query("t_test_ci_tails", f"""
    SELECT Structure, Content, cause_topic, effect_topic, 0.05::DOUBLE AS low_tail, 0.05::DOUBLE AS high_tail
    FROM ({_T2P}) WHERE p IS NOT NULL AND m <> 0""")
def _(t):
    """A test of the mean against either bound of its interval has p = 0.05."""
    d = H.t_test_ci(moments(t)).where(F.col("p_value").isNotNull() & (F.col("estimate") != 0))
    error = F.col("estimate") / F.col("statistic")
    return d.select(*REL, student_t_p((F.col("estimate") - F.col("conf_low")) / error, "parameter").alias("low_tail"),
                    student_t_p((F.col("conf_high") - F.col("estimate")) / error, "parameter").alias("high_tail"))


@query("t_test_ci_width", f"""
    SELECT Structure, Content, cause_topic, effect_topic,
           (p < 0.05) AS excludes_zero FROM ({_T2P}) WHERE p IS NOT NULL""")
def _(t):
    """The interval leaves out zero exactly where the test rejects."""
    d = H.t_test_ci(moments(t)).where(F.col("p_value").isNotNull())
    return d.select(*REL, ((F.col("conf_low") > 0) | (F.col("conf_high") < 0)).alias("excludes_zero"))


@query("significant", f"""
    SELECT Structure, Content, cause_topic, effect_topic, {r6('p')} AS p_value FROM ({_T2P}) WHERE p < 0.05""")
def _(t):
    return H.significant(tests(t)).select(*REL, "p_value")


@query("significance_stars", f"""
    SELECT stars, count(*) AS n FROM (SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*'
      WHEN p IS NOT NULL THEN '' END AS stars FROM ({_T2P})) GROUP BY ALL""")
def _(t):
    return tests(t).groupBy(significance_stars("p_value").alias("stars")).agg(F.count(F.lit(1)).alias("n"))


def _bh(source: str) -> str:
    return f"""
    SELECT Structure, Content, cause_topic, effect_topic, {r6('p')} AS p_value,
           {r6('least(1, min(raw) OVER (PARTITION BY Structure, Content ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS fdr
    FROM (SELECT *, p * k / rn AS raw FROM (
      SELECT *, row_number() OVER (PARTITION BY Structure, Content ORDER BY p) AS rn, count(*) OVER (PARTITION BY Structure, Content) AS k
      FROM ({source})))"""


@query("fdr_by_condition", _bh(f"SELECT * FROM ({_T2P}) WHERE p IS NOT NULL AND (cause_topic, effect_topic) IN ({_MODELLED})"))
def _(t):
    return H.fdr_by_condition(tests(t)).select(*REL, "p_value", "fdr")


@query("bh_adjust", _bh(f"SELECT * FROM ({_T2P}) WHERE p IS NOT NULL"))
def _(t):
    return H.bh_adjust(tests(t)).select(*REL, "p_value", "fdr")


_SIGNERS = """
    SELECT Structure, Content, cause_topic, effect_topic, count(DISTINCT random_id) FILTER (difference > 0) AS up,
           count(DISTINCT random_id) FILTER (difference < 0) AS down FROM v_shifts GROUP BY ALL"""


@query("binom_test_exact", f"""
    SELECT Structure, Content, cause_topic, effect_topic, up AS unique_positive_count, down AS unique_negative_count,
           {r6('up / nullif(up + down, 0)')} AS estimate,
           CASE WHEN up + down > 0 THEN round(round(least(1, 2 * (SELECT sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1)
                - (up + down) * ln(2))) FROM range(0, 100000) g(i) WHERE i <= least(up, down))), 12), 6) + 0.0 END AS p_value
    FROM ({_SIGNERS})""")
def _(t):
    d = H.binom_test_exact(C.unique_signers(shifts(t)))
    return d.drop("conf_int_low", "conf_int_high")


@query("binom_test_interval")
def _(t):
    return H.binom_test_exact(C.unique_signers(shifts(t)))


_HURDLE = """
    SELECT Structure, Content, n, mu, hu, sigma FROM (
      SELECT Structure, Content, count(*) AS n, avg(difference) FILTER (difference <> 0) AS mu FROM v_diffs GROUP BY ALL),
      (SELECT count(*) FILTER (difference = 0) / count(*) AS hu FROM v_diffs),
      (SELECT sqrt(avg((difference - m) * (difference - m))) AS sigma FROM (
         SELECT difference, avg(difference) OVER (PARTITION BY Structure, Content) AS m FROM v_diffs WHERE difference <> 0))"""


@query("hurdle_gaussian", f"""
    SELECT Structure, Content, n, {r6('mu')} AS mu, {r6('hu')} AS hu, {r6('sigma')} AS sigma FROM ({_HURDLE})""")
def _(t):
    return M.hurdle_gaussian(differences(t))


@query("hurdle_expected", f"SELECT Structure, Content, {r6('mu * (1 - hu)')} AS expected FROM ({_HURDLE})")
def _(t):
    return M.hurdle_expected(M.hurdle_gaussian(differences(t))).select(*C.CONDITION, "expected")


@query("hurdle_predict")
def _(t):
    d = differences(t)
    return M.hurdle_predict(d, M.hurdle_gaussian(d), record=C.AUTHOR)
