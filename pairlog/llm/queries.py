"""The operators' named queries; each derives its contract's columns from its operator."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from . import ann, best_fit, chat, collocations, decontaminate, fim, jaccard_join, language, licenses, line_spread, quality, token_files, toxicity
from .common import hash_remainder, small_batches

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            small_batches(spark)
            return build(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return build
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("op1_license_scan")
def op1(table) -> DataFrame:
    return licenses.digest(licenses.scan(table("documents")))


@query("op2_nearest_neighbours")
def op2(table) -> DataFrame:
    return ann.search(table("embeddings"), F.col("id") % 20 == 0, 20)


@query("op3_decontaminate")
def op3(table) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table("documents"), table("benchmark")))


@query("op4_language")
def op4(table) -> DataFrame:
    docs = table("documents")
    model = language.fit(docs, usable=hash_remainder("doc_id", 3) != 1)
    return language.identify(docs, model).select(
        "doc_id", F.coalesce(hash_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_token_binary")
def op5(table) -> DataFrame:
    docs = table("documents")
    return token_files.read_documents(docs.sparkSession, token_files.write_shards(docs))


@query("op6_toxicity")
def op6(table) -> DataFrame:
    docs = table("documents")
    model = toxicity.fit(docs, table("labels"), usable=hash_remainder("doc_id", 4) != 2)
    return verdicts(toxicity.score(docs, model), 0.3)


@query("op7_line_spread", line_spread.sql())
def op7(table) -> DataFrame:
    return line_spread.remove_boilerplate(table("documents")).select("doc_id", "text", "n_removed")


@query("op8_jaccard_join")
def op8(table) -> DataFrame:
    return jaccard_join.join_groups(table("documents"))


@query("op9_quality")
def op9(table) -> DataFrame:
    docs = table("documents")
    model = quality.fit(docs, table("labels"), usable=hash_remainder("doc_id", 4) != 2)
    return verdicts(quality.score(docs, model), 0.7)


def verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(hash_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op10_best_fit_packing")
def op10(table) -> DataFrame:
    return best_fit.pack(table("documents"), 2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op11_fill_in_middle", fim.sql())
def op11(table) -> DataFrame:
    return fim.digest(fim.rearrange(table("documents")))


@query("op12_chat_format", chat.sql())
def op12(table) -> DataFrame:
    rows = chat.records(table("conversations"), "conv_id", ["turn", "role", "text"])
    said = json.dumps({"messages": [{"role": role, "content": chat.PROBE_TEXT} for role in ("user", "assistant")]})
    probe = rows.sparkSession.range(1).select(F.lit(chat.PROBE_ID).cast("bigint").alias("id"), F.parse_json(F.lit(said)).alias("record"))
    return chat.digest(chat.read(chat.form(chat.convert(rows.unionByName(probe)))))


@query("op13_collocations", collocations.sql())
def op13(table) -> DataFrame:
    return collocations.mine(table("documents"))
