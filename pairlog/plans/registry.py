"""Query registry and the SQL views which the twins share."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ..session import ship
from ..sources.canonical import Tables


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None


_REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the views below by name."""
    def add(build):
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = Query(build, sql)
        return build
    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without negative zero, so that two engines can be compared. The
    first rounding, to twelve, makes both see the same value where it lies halfway."""
    return df.select(*[
        (F.round(F.round(F.col(f"`{f.name}`"), 12), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def r6(expr: str) -> str:
    return f"round(round({expr}, 12), 6) + 0.0"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(spark: SparkSession, sf_dir: str, q: Query) -> DataFrame:
        ship(spark)
        return tidy(q.build(Tables(spark, sf_dir)))

    return {name: functools.partial(run, q=q) for name, q in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(q.sql) for name, q in _REGISTRY.items() if q.sql}


def with_views(body: str) -> str:
    """Prefix a statement with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(body)
    if not needed:
        return body.strip()
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed) + "\n" + body.strip()


def _topic_case(col: str, table: dict[int, str], merged: dict[str, str] | None = None) -> str:
    merged = merged or {}
    whens = " ".join(f"WHEN {k} THEN '{merged.get(v, v)}'" for k, v in table.items())
    return f"CASE {col} {whens} END"


def _views() -> dict[str, str]:
    from ..operators.claims import MERGED_TOPICS, TOPICS

    seated = """
        SELECT run, user_id AS id, TrialNumber, event_type AS Response, value, ts,
               row_number() OVER (PARTITION BY run, TrialNumber
                   ORDER BY (user_id * 7919 + TrialNumber * 104729) % 10007, user_id) - 1 AS pos
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, TrialNumber ORDER BY ts DESC, event_id DESC) AS rn
              FROM (SELECT user_id, event_type, event_id, ts, value, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) + 1 AS TrialNumber,
                           CAST(user_id % 5 AS INT) AS run FROM events))
        WHERE rn = 1"""
    log = """
        SELECT concat('run', CAST(run AS VARCHAR)) AS Identifier,
               CASE WHEN run % 2 = 0 THEN 'Homogeneous' ELSE 'Spatial' END AS Structure,
               CASE WHEN run < 3 THEN 'Hashtag' ELSE 'Face' END AS Content,
               id, TrialNumber, {response} AS Response, CAST(floor(pos / 2) AS INT) AS grp, value, ts FROM v_seated"""
    paired = """
        SELECT a.*, b.id AS partner_id, b.Response AS partner_response,
               CASE WHEN a.Response = b.Response THEN 1 ELSE 0 END AS Points
        FROM {log} a LEFT JOIN {log} b
          ON a.Identifier = b.Identifier AND a.TrialNumber = b.TrialNumber AND a.grp = b.grp AND a.id <> b.id"""
    condition = lambda key: f"""
               CASE WHEN {key} % 2 = 0 THEN 'Homogeneous' ELSE 'Spatial' END AS Structure,
               CASE WHEN CAST(floor({key} / 2) AS BIGINT) % 2 = 0 THEN 'Face' ELSE 'Hashtag' END AS Content,
               CASE WHEN {key} % 3 = 0 THEN 20 ELSE 50 END AS Size"""
    return {
        "v_seated": seated,
        "v_log": log.format(response="Response"),
        "v_wide": log.format(response="concat(Response, '_', CAST(CAST(floor(value) AS BIGINT) % 8 AS VARCHAR))"),
        "v_paired": paired.format(log="v_log"),
        "v_coord": """
            SELECT *, CASE WHEN count(DISTINCT Response) OVER w = 1 THEN 1 ELSE 0 END AS Coordinate FROM v_log
            WINDOW w AS (PARTITION BY Identifier, TrialNumber, grp)""",
        "v_wide_coord": """
            SELECT *, CASE WHEN count(DISTINCT Response) OVER w = 1 THEN 1 ELSE 0 END AS Coordinate FROM v_wide
            WINDOW w AS (PARTITION BY Identifier, TrialNumber, grp)""",
        "v_prev": """
            SELECT *, lag(Response) OVER w AS prev_response, lag(partner_response) OVER w AS partner_prev_response
            FROM v_paired WINDOW w AS (PARTITION BY Identifier, id ORDER BY TrialNumber)""",
        "v_dec": """
            SELECT *, CASE WHEN Response = prev_response THEN 'RS' WHEN Response = partner_prev_response THEN 'RP'
                           WHEN seen_before THEN 'EC' ELSE 'BN' END AS DecisionType
            FROM (SELECT a.*, EXISTS (SELECT 1 FROM v_paired b WHERE b.Identifier = a.Identifier AND b.id = a.id
                    AND b.TrialNumber < a.TrialNumber AND (b.Response = a.Response OR b.partner_response = a.Response))
                    AS seen_before FROM v_prev a)""",
        "v_names": """
            SELECT *, CASE WHEN value < 2 THEN '' WHEN id % 2 = 0 THEN upper(Response) ELSE Response END AS name,
                   CAST(floor(value) AS BIGINT) % 7 + 1 AS rating FROM v_log""",
        "v_memory": """
            SELECT *, sum(Points) OVER (PARTITION BY Identifier, id ORDER BY TrialNumber) - Points AS segment FROM v_paired""",
        "v_customers": f"""
            SELECT {condition('c_custkey')}, c_custkey, unnest(['pre', 'post']) AS Phase FROM customer""",
        "v_models": """
            SELECT Model, Identifier, Structure, Content, TrialNumber, -sum(p * log2(p)) / log2(any_value(Size)) + 0.0 AS value
            FROM (SELECT *, n / sum(n) OVER (PARTITION BY Model, Identifier, TrialNumber) AS p FROM (
              SELECT Model, Identifier, Structure, Content, TrialNumber, r, count(*) AS n FROM (
                SELECT 'Observed' AS Model, Identifier, Structure, Content, TrialNumber, Response AS r FROM v_prev
                UNION ALL SELECT 'Repeat', Identifier, Structure, Content, TrialNumber, prev_response FROM v_prev
                UNION ALL SELECT 'Copy', Identifier, Structure, Content, TrialNumber, partner_prev_response FROM v_prev)
              WHERE r IS NOT NULL GROUP BY ALL)) JOIN v_sizes USING (Identifier)
            GROUP BY Model, Identifier, Structure, Content, TrialNumber""",
        "v_curves": """
            SELECT TrialNumber AS Trial, Model, Structure, Content, avg(value) AS Entropy FROM v_models GROUP BY ALL""",
        "v_sizes": "SELECT Identifier, count(DISTINCT id) AS Size FROM v_log GROUP BY 1",
        "v_counts": "SELECT Identifier, TrialNumber, Response, count(*) AS n FROM v_log WHERE Response IS NOT NULL GROUP BY ALL",
        "v_entropy2": """
            SELECT Identifier, TrialNumber, -sum(p * log2(p)) + 0.0 AS entropy
            FROM (SELECT *, n / sum(n) OVER (PARTITION BY Identifier, TrialNumber) AS p FROM v_counts) GROUP BY ALL""",
        "v_entropy": """
            SELECT Identifier, TrialNumber, -sum(p * ln(p)) + 0.0 AS entropy
            FROM (SELECT *, n / sum(n) OVER (PARTITION BY Identifier, TrialNumber) AS p FROM v_counts) GROUP BY ALL""",
        "v_cond": "SELECT DISTINCT Identifier, Structure, Content FROM v_log",
        "v_strategy": """
            SELECT *, sum(CASE WHEN DecisionType = 'RP' AND Points = 1 THEN TrialNumber ELSE 0 END) OVER w AS rp_pts,
                   sum(CASE WHEN DecisionType = 'EC' AND Points = 1 THEN TrialNumber ELSE 0 END) OVER w AS ec_pts,
                   sum(CASE WHEN DecisionType = 'RS' AND Points = 1 THEN TrialNumber ELSE 0 END) OVER w AS rs_pts,
                   bool_or(partner_response IS NOT NULL) OVER w AS has_memory,
                   lead(DecisionType) OVER (PARTITION BY Identifier, id ORDER BY TrialNumber) AS nxt,
                   lead(TrialNumber) OVER (PARTITION BY Identifier, id ORDER BY TrialNumber) AS nxt_trial
            FROM v_dec WINDOW w AS (PARTITION BY Identifier, id ORDER BY TrialNumber)""",
        "v_alpha": "SELECT range / 10.0::DOUBLE AS alpha FROM range(0, 101)",
        "v_claims": f"""
            SELECT {condition('l_suppkey')}, l_suppkey AS random_id,
                   CASE WHEN o_orderdate < TIMESTAMP '1998-04-01 00:00:00' THEN 'pre' ELSE 'post' END AS Phase,
                   CAST(p_size % 21 AS INT) - 1 AS cause_cluster, CAST(l_quantity AS INT) % 21 - 1 AS effect_cluster,
                   p_name AS cause, p_brand AS effect
            FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
        "v_topics": f"""
            SELECT *, {_topic_case('cause_cluster', TOPICS, MERGED_TOPICS)} AS cause_topic,
                   {_topic_case('effect_cluster', TOPICS, MERGED_TOPICS)} AS effect_topic FROM v_claims""",
        "v_relations": """
            SELECT Structure, Content, Size, random_id, Phase, cause_topic, effect_topic, count(*) AS n
            FROM v_topics GROUP BY ALL""",
        "v_complete": """
            SELECT k.*, p.Phase, c.cause_topic, e.effect_topic, coalesce(r.n, 0) AS n
            FROM (SELECT DISTINCT Structure, Content, Size, random_id FROM v_relations) k
            CROSS JOIN (SELECT DISTINCT Phase FROM v_relations) p
            CROSS JOIN (SELECT DISTINCT cause_topic FROM v_relations) c
            CROSS JOIN (SELECT DISTINCT effect_topic FROM v_relations) e
            LEFT JOIN v_relations r ON r.Structure = k.Structure AND r.Content = k.Content AND r.Size = k.Size
              AND r.random_id = k.random_id AND r.Phase = p.Phase AND r.cause_topic = c.cause_topic
              AND r.effect_topic = e.effect_topic""",
        "v_shifts": """
            SELECT Structure, Content, Size, random_id, cause_topic, effect_topic,
                   sum(CASE WHEN Phase = 'post' THEN n END) - sum(CASE WHEN Phase = 'pre' THEN n END) AS difference
            FROM v_complete GROUP BY ALL""",
        "v_ends": """
            SELECT conv_id, arg_min(text, turn) AS t1, arg_max(text, turn) AS t2, count(*) AS k
            FROM conversations WHERE role = 'user' GROUP BY 1""",
        "v_tweets": f"""
            SELECT {condition('conv_id')}, conv_id AS random_id, Phase, Response FROM (
              SELECT conv_id, 'pre' AS Phase, t1 AS Response FROM v_ends
              UNION ALL SELECT conv_id, 'post', t2 FROM v_ends WHERE k > 1)""",
        "v_text_claims": """
            SELECT text, string_split(line, ' ')[1] AS cause, string_split(line, ' ')[-1] AS effect
            FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'user')""",
        "v_claim_counts": """
            SELECT Structure, Content, Size, random_id, Phase, count(*) AS n
            FROM v_tweets JOIN v_text_claims ON text = Response GROUP BY ALL""",
        "v_diffs": """
            SELECT Structure, Content, Size, random_id,
                   max(CASE WHEN Phase = 'post' THEN n END) - max(CASE WHEN Phase = 'pre' THEN n END) AS difference
            FROM (SELECT Structure, Content, Size, random_id, Phase, count(*) AS n FROM v_claims GROUP BY ALL)
            GROUP BY ALL HAVING difference IS NOT NULL""",
        "v_cosine": """
            SELECT r.vec_id, CAST(s.vec_id AS INT) AS idx, r.label,
                   list_cosine_similarity(r.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS similarity
            FROM embeddings r JOIN embeddings s ON s.vec_id < 9""",
        "v_softmax": """
            SELECT *, exp(similarity / 0.2) / sum(exp(similarity / 0.2)) OVER (PARTITION BY vec_id) AS score,
                   CASE WHEN idx = 0 THEN 'Topic' WHEN idx < 3 THEN 'Causes' WHEN idx = 3 THEN 'Effect'
                        WHEN idx < 6 THEN '1st Order Effects' ELSE '2nd Order Effects' END AS grp,
                   concat('p', CAST(vec_id % 40 AS VARCHAR)) AS Player,
                   CASE WHEN label % 2 = 0 THEN 'Homogeneous' ELSE 'Spatial' END AS Structure,
                   CASE WHEN label % 5 = 0 THEN 'Face' ELSE 'Hashtag' END AS Content
            FROM v_cosine""",
        "v_players": """
            SELECT Player, Structure, grp, avg(score) AS score FROM v_softmax WHERE Content <> 'Face' GROUP BY ALL""",
        "v_pairs": """
            SELECT Identifier, TrialNumber, grp, min(id) AS Node1, max(id) AS Node2 FROM v_log
            GROUP BY ALL HAVING min(id) < max(id)""",
    }


VIEWS = _views()


def t_tail(t: str, df: str) -> str:
    """Two-sided p value by quadrature: with u = atan(t / sqrt(df)) the density becomes a
    power of a cosine, smooth on a closed range, integrated by Simpson's rule."""
    h = f"(atan(abs({t}) / sqrt({df})) / 1000)"
    return (f"1 - 2 * (exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())) * "
            f"(SELECT sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* power(cos(i * {h}), {df} - 1)) FROM range(0, 1001) g(i)) * {h} / 3")
