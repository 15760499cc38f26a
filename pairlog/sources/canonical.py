"""Canonical views over the star-schema tables.

The operators want an interaction log, authored claims, texts, ratings and vectors; these
functions derive them from ``events``, ``lineitem``, ``conversations`` and ``embeddings``.
Each reads its whole table, and only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import bucketed_row_number
from ..functions.scalar import IMPRESSIONS

RUNS = 5
SHUFFLE_MOD = 10007
_BUCKET_WIDTH = 16
#: The day of trial 1; later trials count days from here, over any number of months.
RUN_START = "2024-01-01"


def trial_of(ts: str = "ts", start: str = RUN_START):
    """The trial number of a moment: days since the start of the run, from 1."""
    return (F.datediff(F.col(ts).cast("date"), F.lit(start).cast("date")) + 1).cast("int")


class Tables:
    """The parquet tables of one scale-factor folder, and the views over them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Opened once per query, so that file footers are read once."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._opened[name]

    # -- interaction log ---------------------------------------------------------------
    def answers(self, *extra: str) -> DataFrame:
        """The last event of a user in a day is the answer of that trial. Kept by a
        mergeable aggregate, so a user with very many events is combined map-side."""
        cols = ["ts", "event_id", "event_type", *[c for c in extra if c != "ts"]]
        last = self.table("events").groupBy("user_id", trial_of().alias("TrialNumber")).agg(
            F.max(F.struct(*cols)).alias("e"))
        return last.select(
            F.pmod("user_id", F.lit(RUNS)).cast("int").alias("run"),
            F.col("user_id").alias("id"), "TrialNumber",
            F.col("e.event_type").alias("Response"), *[F.col(f"e.{c}").alias(c) for c in extra])

    def _log(self, answers: DataFrame, wide: bool, *extra) -> DataFrame:
        response = F.col("Response")
        if wide:
            response = F.concat_ws("_", response, F.pmod(F.floor("value"), F.lit(8)).cast("string"))
        return answers.select(
            F.concat(F.lit("run"), F.col("run").cast("string")).alias("Identifier"),
            F.when(F.pmod("run", F.lit(2)) == 0, "Homogeneous").otherwise("Spatial").alias("Structure"),
            F.when(F.col("run") < 3, "Hashtag").otherwise("Face").alias("Content"),
            "id", "TrialNumber", response.alias("Response"), *extra)

    def log(self, wide: bool = False) -> DataFrame:
        """(Identifier, Structure, Content, id, TrialNumber, Response), for operators which do
        not look at pairs. ``wide`` answers carry one of eight suffixes, for about forty
        distinct values."""
        return self._log(self.answers(*(["value"] if wide else [])), wide)

    def interactions(self, wide: bool = False, extra: Sequence[str] = ()) -> DataFrame:
        """The log with pairs, ``grp``: each trial seats a run's users in a shuffled order and
        pairs neighbours; an odd one stays alone."""
        a = self.answers(*dict.fromkeys([*(["value"] if wide else []), *extra]))
        seat = F.pmod(F.col("id") * 7919 + F.col("TrialNumber") * 104729, F.lit(SHUFFLE_MOD))
        seated = bucketed_row_number(
            a.withColumn("_seat", seat), F.floor(F.col("_seat") / _BUCKET_WIDTH),
            ["_seat", "id"], partition=["run", "TrialNumber"], name="_pos")
        return self._log(seated, wide, F.floor(F.col("_pos") / 2).cast("int").alias("grp"), *extra)

    def ratings(self) -> DataFrame:
        """The log plus five rating columns of which one is shown to both of a pair. Names
        of even users are upper case, and an answer with a value under 2 is left empty."""
        shown = F.pmod("grp", F.lit(len(IMPRESSIONS)))
        rating = (F.pmod(F.floor("value"), F.lit(7)) + 1).cast("int")
        df = self.interactions(extra=["value"])
        name = (F.when(F.col("value") < 2, F.lit(""))
                .when(F.pmod("id", F.lit(2)) == 0, F.upper("Response")).otherwise(F.col("Response")))
        return df.select("Identifier", "id", "TrialNumber", "grp", name.alias("name"),
                         *[F.when(shown == i, rating).alias(c) for i, c in enumerate(IMPRESSIONS)])

    # -- claims and texts --------------------------------------------------------------
    def claims(self) -> DataFrame:
        """One claim per order line; the supplier is the participant."""
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        part = self.table("part").select("p_partkey", "p_size", "p_name", "p_brand")
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        j = (line.join(part, F.col("l_partkey") == F.col("p_partkey"))
             .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
        return j.select(
            F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "Homogeneous").otherwise("Spatial").alias("Structure"),
            F.when(F.pmod(F.floor(F.col("l_suppkey") / 2), F.lit(2)) == 0, "Face").otherwise("Hashtag").alias("Content"),
            F.when(F.pmod("l_suppkey", F.lit(3)) == 0, 20).otherwise(50).alias("Size"),
            F.col("l_suppkey").alias("random_id"),
            self.phase().alias("Phase"),
            (F.pmod("p_size", F.lit(21)) - 1).cast("int").alias("cause_cluster"),
            (F.pmod(F.col("l_quantity").cast("int"), F.lit(21)) - 1).cast("int").alias("effect_cluster"),
            F.col("p_name").alias("cause"), F.col("p_brand").alias("effect"))

    @staticmethod
    def phase():
        return F.when(F.col("o_orderdate") < F.lit("1998-04-01").cast("timestamp_ntz"), "pre").otherwise("post")

    def customers(self) -> DataFrame:
        """Every customer as a participant, once for each phase."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            F.when(F.pmod(key, F.lit(2)) == 0, "Homogeneous").otherwise("Spatial").alias("Structure"),
            F.when(F.pmod(F.floor(key / 2), F.lit(2)) == 0, "Face").otherwise("Hashtag").alias("Content"),
            F.when(F.pmod(key, F.lit(3)) == 0, 20).otherwise(50).alias("Size"), key.alias("random_id"),
            F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("Phase"))

    def conversation_ends(self) -> DataFrame:
        """First and last user turn of each conversation."""
        turns = self.table("conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
        return turns.groupBy("conv_id").agg(
            F.min(F.struct("turn", "text")).alias("first"), F.max(F.struct("turn", "text")).alias("last"))

    def prepost(self) -> DataFrame:
        """Wide pre/post texts: participant, tweet1, tweet2 (NULL when there is one turn only)."""
        e = self.conversation_ends()
        return e.select(
            F.col("conv_id").alias("random_id"), F.col("first.text").alias("tweet1"),
            F.when(F.col("last.turn") > F.col("first.turn"), F.col("last.text")).alias("tweet2"))

    def tweets(self) -> DataFrame:
        """Long pre/post texts with condition columns."""
        wide = self.prepost()
        long = wide.select("random_id", F.explode(F.array(
            F.struct(F.lit("pre").alias("Phase"), F.col("tweet1").alias("Response")),
            F.struct(F.lit("post").alias("Phase"), F.col("tweet2").alias("Response")))).alias("r"))
        return long.where(F.col("r.Response").isNotNull()).select(
            F.when(F.pmod("random_id", F.lit(2)) == 0, "Homogeneous").otherwise("Spatial").alias("Structure"),
            F.when(F.pmod(F.floor(F.col("random_id") / 2), F.lit(2)) == 0, "Face").otherwise("Hashtag").alias("Content"),
            F.when(F.pmod("random_id", F.lit(3)) == 0, 20).otherwise(50).alias("Size"),
            "random_id", F.col("r.Phase").alias("Phase"), F.col("r.Response").alias("Response"))

    def text_claims(self) -> DataFrame:
        """Claims extracted from every user text: one per line of the text, its first and
        last word standing for cause and effect."""
        turns = self.table("conversations").where(F.col("role") == "user").select("text")
        lines = turns.select("text", F.explode(F.split("text", "\n")).alias("line"))
        words = F.split("line", " ")
        return lines.select("text", F.get(words, F.lit(0)).alias("cause"),
                            F.element_at(words, -1).alias("effect"))

    # -- vectors -----------------------------------------------------------------------
    def segments(self) -> DataFrame:
        """The nine narrative segments: the first nine vectors."""
        return self.table("embeddings").where(F.col("vec_id") < 9).select(
            F.col("vec_id").cast("int").alias("idx"), "embedding")

    def responses(self) -> DataFrame:
        """Every vector is a response of one of forty players per structure."""
        e = self.table("embeddings")
        return e.select(
            "vec_id", "embedding",
            F.concat(F.lit("p"), F.pmod("vec_id", F.lit(40)).cast("string")).alias("Player"),
            F.when(F.pmod("label", F.lit(2)) == 0, "Homogeneous").otherwise("Spatial").alias("Structure"),
            F.when(F.pmod("label", F.lit(5)) == 0, "Face").otherwise("Hashtag").alias("Content"))
