"""Readers and the writer over whole tables: a view is written in the file form a reader expects, into the
work folder, and read back; the twin is the view itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_dir
from ..sources import files
from .curves import WIDE_SQL, wide
from .registry import query


def stored(t, df, name: str, header: bool = True) -> str:
    folder = work_dir(t.spark, name)
    df.write.option("header", header).option("escape", '"').csv(folder)
    return folder


@query("read_interactions", """
    SELECT Identifier, CAST(id AS INT) AS id, TrialNumber, Response, Structure, Content FROM v_log""")
def _(t):
    log = t.log().select("TrialNumber", "Identifier", "Response", "id", "Content", "Structure")
    return files.read_interactions(t.spark, stored(t, log, "log-csv")).select(
        "Identifier", "id", "TrialNumber", "Response", "Structure", "Content")


@query("read_pairs", """
    SELECT CAST(Node1 AS INT) AS Node1, CAST(Node2 AS INT) AS Node2, TrialNumber AS Trial FROM v_pairs""")
def _(t):
    pairs = t.interactions().groupBy("Identifier", "TrialNumber", "grp").agg(F.min("id").alias("Node1"), F.max("id").alias("Node2")) \
        .where("Node1 < Node2").select("Node1", "Node2", F.col("TrialNumber").alias("Trial"))
    return files.read_pairs(t.spark, stored(t, pairs, "pairs-csv", header=False)).select("Node1", "Node2", "Trial")


@query("read_tweets", """
    SELECT Structure, Content, Size, Phase, CAST(random_id AS VARCHAR) AS random_id, Response FROM v_tweets""")
def _(t):
    return files.read_tweets(t.spark, stored(t, t.tweets(), "tweets-csv"))


@query("read_claims", "SELECT cause, effect, cause_cluster, effect_cluster FROM v_claims")
def _(t):
    claims = t.claims().select("effect_cluster", "cause", "cause_cluster", "effect", F.lit("t").alias("text"))
    return files.read_claims(t.spark, stored(t, claims, "claims-csv")).drop("text")


@query("read_prepost", """
    SELECT CAST(conv_id AS VARCHAR) AS random_id, t1 AS tweet1, CASE WHEN k > 1 THEN t2 END AS tweet2 FROM v_ends""")
def _(t):
    wide = t.prepost().select("tweet2", F.col("random_id").alias("random ID"), "tweet1")
    return files.read_prepost(t.spark, stored(t, wide, "prepost-csv")).select("random_id", "tweet1", "tweet2")


@query("write_table", "SELECT Identifier, id, TrialNumber, Response, Structure, Content FROM v_log")
def _(t):
    folder = work_dir(t.spark, "partitioned")
    files.write_table(t.log(), folder, ["Structure", "Content"])
    return t.spark.read.parquet(folder).select("Identifier", "id", "TrialNumber", "Response", "Structure", "Content")


_CODE = """concat(CASE WHEN Content = 'Face' THEN 'f' ELSE 'h' END, '50', CASE WHEN Structure = 'Spatial' THEN 's' ELSE 'h' END,
  CAST(CAST(substr(Identifier, 4) AS INT) + 1 AS VARCHAR(9)))"""


@query("read_run_files", f"""
    SELECT {_CODE} AS Identifier, Content, 50 AS Size, Structure, CAST(substr(Identifier, 4) AS INT) + 1 AS Run,
           CAST(id AS INT) AS id, TrialNumber, Response FROM v_log""")
def _(t):
    """A folder for each run, whose name is the run's code; the files say nothing of the condition."""
    folder = work_dir(t.spark, "runs")
    t.log().withColumn("code", F.expr(_CODE)).select("Response", "TrialNumber", "id", "code") \
        .write.partitionBy("code").option("header", True).option("escape", '"').csv(folder)
    return files.read_run_files(t.spark, folder).select("Identifier", "Content", "Size", "Structure", "Run", "id", "TrialNumber", "Response")


@query("read_survey", """
    SELECT CAST(conv_id AS VARCHAR) AS survey, concat('QID', turn) AS question_id, role AS tag, text, 'TE' AS type, 'ESTB' AS selector,
           'TotalChar' AS rule, 50 AS min_chars, CAST(length(text) AS INT) AS max_chars FROM conversations""")
def _(t):
    """Every conversation written as a survey definition of its own, a question for each turn."""
    settings = F.struct(F.lit("TotalChar").alias("Type"), F.lit("50").alias("MinChars"), F.length("text").cast("string").alias("TotalChars"))
    payload = F.struct(F.col("text").alias("QuestionText"), F.col("role").alias("DataExportTag"), F.lit("TE").alias("QuestionType"),
                       F.lit("ESTB").alias("Selector"), F.struct(settings.alias("Settings")).alias("Validation"))
    element = F.struct(F.lit("SQ").alias("Element"), F.concat(F.lit("QID"), F.col("turn").cast("string")).alias("PrimaryAttribute"), payload.alias("Payload"))
    surveys = t.table("conversations").groupBy("conv_id").agg(F.collect_list(element).alias("SurveyElements")) \
        .select(F.struct(F.col("conv_id").cast("string").alias("SurveyName")).alias("SurveyEntry"), "SurveyElements")
    folder = work_dir(t.spark, "surveys")
    surveys.write.json(folder)
    return files.read_survey(t.spark, folder, lines=True)


@query("read_sweep", """
    SELECT CAST(o_orderkey AS DOUBLE) / 8 AS alpha, o_totalprice AS entropy_dist, CAST(o_custkey AS DOUBLE) AS bn_dist, NULL::DOUBLE AS ec_dist,
           CAST(length(o_orderstatus) AS DOUBLE) AS rs_dist, -o_totalprice AS rp_dist FROM orders""")
def _(t):
    d = t.table("orders").select(F.lit(0).alias("index"), F.length("o_orderstatus").alias("rs_dist"), (F.col("o_orderkey") / 8).alias("alpha"),
                                 (-F.col("o_totalprice")).alias("rp_dist"), F.col("o_totalprice").alias("entropy.dist"), F.col("o_custkey").alias("bn_dist"))
    return files.read_sweep(t.spark, stored(t, d, "sweep-csv"))


@query("read_curves", WIDE_SQL)
def _(t):
    return files.read_curves(t.spark, stored(t, wide(t), "curves-csv"))
