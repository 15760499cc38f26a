"""Embedding alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import argmax, softmax_tau
from ..operators import alignment as A
from .registry import query, r6, t_tail


def aligned(t):
    return A.narrative_alignment(t.responses(), t.segments())


def players(t):
    return A.mean_loading(A.explode_loadings(aligned(t)))


@query("score_segments", f"SELECT vec_id, idx, {r6('similarity')} AS similarity FROM v_cosine")
def _(t):
    return A.cosine_matrix(t.responses(), t.segments())


@query("softmax_tau", f"SELECT vec_id, idx, {r6('score')} AS score FROM v_softmax")
def _(t):
    d = A.cosine_loadings(t.responses(), t.segments())
    return d.select("vec_id", F.posexplode_outer(softmax_tau("loading", A.TAU)).alias("idx", "score"))


@query("argmax", """
    SELECT vec_id, arg_max(idx, similarity) AS segment_index FROM v_cosine GROUP BY ALL""")
def _(t):
    return A.cosine_loadings(t.responses(), t.segments()).select("vec_id", argmax("loading").alias("segment_index"))


@query("narrative_alignment", f"""
    SELECT vec_id, arg_max(idx, similarity) AS segment_index, arg_max(grp, similarity) AS segment_label,
           {r6('max(similarity)')} AS similarity_score, {r6('max(score)')} AS top_loading
    FROM v_softmax GROUP BY ALL""")
def _(t):
    return aligned(t).select("vec_id", "segment_index", "segment_label", "similarity_score",
                             F.array_max("loading_normed").alias("top_loading"))


@query("map_segment_group", """
    SELECT grp AS "Group", count(*) AS n FROM v_softmax GROUP BY ALL""")
def _(t):
    d = A.cosine_matrix(t.responses(), t.segments())
    return d.groupBy(A.map_segment_group("idx").alias("Group")).agg(F.count(F.lit(1)).alias("n"))


@query("explode_loadings", f"""
    SELECT Player, Structure, Content, idx, grp AS "Group", {r6('score')} AS score FROM v_softmax WHERE Content <> 'Face'""")
def _(t):
    return A.explode_loadings(aligned(t))


@query("mean_loading", f"""
    SELECT Player, Structure, grp AS "Group", {r6('score')} AS score FROM v_players""")
def _(t):
    return players(t)


@query("group_alignment", f"""
    SELECT Structure, grp AS "Group", {r6('avg(score)')} AS mean, {r6('stddev_samp(score) / sqrt(count(*))')} AS sem FROM v_players GROUP BY ALL""")
def _(t):
    return A.group_alignment(players(t))


_WELCH = """
    SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
           (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / (v1 * v1 / n1 / n1 / (n1 - 1) + v2 * v2 / n2 / n2 / (n2 - 1)) AS df
    FROM (SELECT grp, count(*) FILTER (Structure = 'Homogeneous') AS n1, count(*) FILTER (Structure = 'Spatial') AS n2,
                 avg(score) FILTER (Structure = 'Homogeneous') AS m1, avg(score) FILTER (Structure = 'Spatial') AS m2,
                 var_samp(score) FILTER (Structure = 'Homogeneous') AS v1, var_samp(score) FILTER (Structure = 'Spatial') AS v2
          FROM v_players GROUP BY ALL)"""


@query("alignment_welch", f"""
    SELECT "Group", n1, n2, {r6('m1')} AS m1, {r6('m2')} AS m2, {r6('t')} AS statistic, {r6('df')} AS parameter, {r6('p')} AS p_value,
           CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars
    FROM (SELECT *, grp AS "Group", {t_tail('t', 'df')} AS p FROM ({_WELCH}))""")
def _(t):
    return A.alignment_welch(players(t))


@query("embed_text", """
    SELECT conv_id, turn, 256::INT AS dims, 1.0::DOUBLE AS squared_length FROM conversations""")
def _(t):
    d = A.embed_text(t.table("conversations"), "text")
    return d.select("conv_id", "turn", F.size("embedding").alias("dims"),
                    F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x).alias("squared_length"))


@query("embed_text_model", f"""
    WITH letters AS (SELECT unnest(range(0, 26)) AS i),
    counted AS (SELECT conv_id, turn, i, CAST(length(text) - length(replace(text, chr(CAST(97 + i AS INT)), '')) AS DOUBLE) AS c FROM conversations, letters)
    SELECT conv_id, turn, CAST(i AS INT) AS letter, {r6('CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY conv_id, turn)) AS FLOAT) AS DOUBLE)')} AS value
    FROM counted QUALIFY sum(c) OVER (PARTITION BY conv_id, turn) > 0""")
def _(t):
    """The numbers that a model loaded in the workers gives for every text, one by one."""
    d = A.embed_text(t.table("conversations"), "text", embedder=A.model_embedder(A.letter_model))
    some = d.where(F.exists("embedding", lambda x: x > 0))
    return some.select("conv_id", "turn", F.posexplode("embedding").alias("letter", "value")).withColumn("value", F.col("value").cast("double"))
