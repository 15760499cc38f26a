"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import interactions as I, reshape as R
from ..operators.claims import map_topics, collapse_topics
from .registry import query, r6


@query("parse_run_code", """
    SELECT code, CASE substr(code, 1, 1) WHEN 'f' THEN 'Face' ELSE 'Hashtag' END AS Content,
           CAST(substr(code, 2, 2) AS INT) AS Size, CASE substr(code, 4, 1) WHEN 'h' THEN 'Homogeneous' ELSE 'Spatial' END AS Structure,
           CAST(substr(code, 5) AS INT) AS Run, count(*) AS n
    FROM (SELECT concat(CASE WHEN user_id % 5 < 3 THEN 'h' ELSE 'f' END, CASE WHEN user_id % 3 = 0 THEN '20' ELSE '50' END,
                        CASE WHEN user_id % 2 = 0 THEN 'h' ELSE 's' END, CAST(1 + event_id % 12 AS VARCHAR)) AS code FROM events)
    GROUP BY ALL""")
def _(t):
    u = F.col("user_id")
    code = F.concat(F.when(u % 5 < 3, "h").otherwise("f"), F.when(u % 3 == 0, "20").otherwise("50"),
                    F.when(u % 2 == 0, "h").otherwise("s"), (1 + F.col("event_id") % 12).cast("string"))
    counts = t.table("events").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("code", *[c.alias(k) for k, c in S.parse_run_code("code").items()], "n")


@query("make_ssid", """
    SELECT concat(Identifier, '_', CAST(id AS VARCHAR)) AS ssid, count(*) AS n FROM v_log GROUP BY ALL""")
def _(t):
    return t.log().groupBy(S.make_ssid("Identifier", "id").alias("ssid")).agg(F.count(F.lit(1)).alias("n"))


@query("split_identifier", """
    SELECT Structure, Content, CAST(Size AS VARCHAR) AS Size, CAST(random_id AS VARCHAR) AS random_id, count(*) AS n
    FROM v_claims GROUP BY ALL""")
def _(t):
    joined = t.claims().select(S.make_ssid("Structure", "Content", "Size", "random_id").alias("Identifier"))
    parts = S.split_identifier("Identifier", ["Structure", "Content", "Size", "random_id"])
    return joined.groupBy(*[c.alias(k) for k, c in parts.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("clean_hashtag", """
    SELECT lower(regexp_replace(trim(raw), '[^a-zA-Z0-9_]', '', 'g')) AS hashtag, count(*) AS n
    FROM (SELECT concat('  #', upper(event_type), '_', props, ' !') AS raw FROM events) GROUP BY ALL""")
def _(t):
    raw = F.concat(F.lit("  #"), F.upper("event_type"), F.lit("_"), F.col("props"), F.lit(" !"))
    return t.table("events").groupBy(S.clean_hashtag(raw).alias("hashtag")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_response", """
    SELECT conv_id, turn, role,
           concat_ws(',', CASE WHEN length(text) < 50 THEN 'too_short' END, CASE WHEN length(text) > 280 THEN 'too_long' END) AS text_rules,
           concat_ws(',', CASE WHEN tag IN ('fukushima', 'japan') THEN 'banned' END, CASE WHEN length(word) < 1 THEN 'too_short' END,
                     CASE WHEN length(word) > 35 THEN 'too_long' END, CASE WHEN contains(word, ' ') THEN 'has_space' END) AS hashtag_rules,
           len(list_distinct(words)) < len(words) AS repeats
    FROM (SELECT *, string_split(text, ' ') AS words, string_split(text, chr(10))[1] AS word,
                 lower(regexp_replace(trim(string_split(text, chr(10))[1]), '[^a-zA-Z0-9_]', '', 'g')) AS tag
          FROM conversations)""")
def _(t):
    d = t.table("conversations")
    word = F.get(F.split("text", "\n"), F.lit(0))
    return d.select("conv_id", "turn", "role",
                    F.concat_ws(",", S.text_violations("text")).alias("text_rules"),
                    F.concat_ws(",", S.hashtag_violations(word)).alias("hashtag_rules"),
                    S.has_duplicates(F.split("text", " ")).alias("repeats"))


@query("fill_text", """
    SELECT coalesce(partner_response, '') AS partner_text, count(*) AS n FROM v_paired GROUP BY ALL""")
def _(t):
    d = I.attach_partner(t.interactions())
    return d.groupBy(S.fill_text("partner_response").alias("partner_text")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_condition", """
    SELECT TrialNumber, count(*) AS n FROM v_log
    WHERE Content = 'Hashtag' AND Structure IN ('Spatial') AND TrialNumber <> 1 GROUP BY ALL""")
def _(t):
    d = R.filter_condition(t.log(), Content="Hashtag", Structure=["Spatial"])
    return d.where(F.col("TrialNumber") != 1).groupBy("TrialNumber").agg(F.count(F.lit(1)).alias("n"))


@query("drop_na", """
    SELECT Identifier, count(*) AS n FROM v_prev
    WHERE prev_response IS NOT NULL AND partner_prev_response IS NOT NULL AND partner_response IS NOT NULL GROUP BY ALL""")
def _(t):
    d = I.previous_responses(I.attach_partner(t.interactions()))
    kept = R.drop_na(d, ["prev_response", "partner_prev_response", "partner_response"])
    return kept.groupBy("Identifier").agg(F.count(F.lit(1)).alias("n"))


@query("map_topics", """
    SELECT cause_cluster, cause_topic, count(*) AS n FROM v_topics GROUP BY ALL""")
def _(t):
    topic = collapse_topics(map_topics("cause_cluster"))
    counts = t.claims().groupBy("cause_cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("cause_cluster", topic.alias("cause_topic"), "n")


@query("collapse_topics", """
    SELECT effect_topic, count(*) AS n FROM v_topics GROUP BY ALL""")
def _(t):
    return (t.claims().groupBy(collapse_topics(map_topics("effect_cluster")).alias("effect_topic"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("rating_label", """
    SELECT list_extract(['competence', 'dominance', 'maturity', 'likeability', 'trustworthiness'], grp % 5 + 1) AS impression,
           list_extract(['Strongly disagree (1)', 'Disagree (2)', 'Moderately disagree (3)', 'Neither agree nor disagree (4)',
                         'Moderately agree (5)', 'Agree (6)', 'Strongly agree (7)'], CAST(floor(value) AS BIGINT) % 7 + 1) AS label,
           count(*) AS n
    FROM v_log GROUP BY ALL""")
def _(t):
    d = t.ratings().groupBy(S.rated_impression().alias("impression"), S.rated_value().alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    return d.select("impression", S.rating_label("v").alias("label"), "n")


@query("factor_order", """
    SELECT event_type, CAST(list_position(['view', 'signup', 'purchase', 'error', 'click'], event_type) AS INT) AS sort_key,
           count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    counts = t.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", S.factor_order("event_type", ["view", "signup", "purchase", "error", "click"])
                         .alias("sort_key"), "n")


@query("wrap_round", """
    SELECT CAST((extract(day FROM ts) - 1) % 7 + 1 AS INT) AS round, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    return t.table("events").groupBy(S.wrap_round(F.dayofmonth("ts"), 7).alias("round")).agg(F.count(F.lit(1)).alias("n"))


@query("log_base", f"""
    SELECT event_type, {r6('avg(ln(value))')} AS nats, {r6('avg(log2(value))')} AS bits FROM events GROUP BY ALL""")
def _(t):
    return t.table("events").groupBy("event_type").agg(
        F.avg(S.log_base("value")).alias("nats"), F.avg(S.log_base("value", 2)).alias("bits"))


@query("parse_recorded_date", """
    SELECT date_trunc('minute', ts) AS recorded_at, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    text = F.date_format("ts", "M/d/yyyy H:mm")
    return t.table("events").groupBy(S.parse_recorded_date(text).alias("recorded_at")).agg(F.count(F.lit(1)).alias("n"))


@query("json_field", """
    SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    return t.table("events").groupBy(S.json_field("props", "$.k", "int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
