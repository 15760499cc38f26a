"""A training corpus from ``documents``, in stages.

Every stage takes (spark, docs, sf_dir) and gives documents with the columns of ``documents``, the last
one the packed pieces. Stages are written as Parquet and read again, so each works on all that the one
before it kept, and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlog.llm import best_fit, decontaminate, jaccard_join, line_spread, quality
from pairlog.llm.common import fold, fresh, hash_remainder, small_batches, unfold
from pairlog.session import ship, truncate_lineage, work_dir

QUALITY_THRESHOLD = 0.7
COPY_WIDTH = 5  # words of a shingle, and the Jaccard similarity in percent from which documents are near copies
COPY_PERCENT = 80
CAPACITY = 2048


def prepare(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at least ``QUALITY_THRESHOLD``."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.fit(docs, labels, usable=hash_remainder("doc_id", 4) != 2)
    return unfold(quality.score(fold(docs), model, keep_text=True).where(F.col("score") >= QUALITY_THRESHOLD), docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one place only. A document of which nothing is left goes: all it held
    stands elsewhere. n_chars follows the text."""
    cleaned = line_spread.remove_boilerplate(docs)
    left = F.col("n_removed").eqNullSafe(0) | (F.length(F.trim(F.translate("text", "\n\r\t", "   "))) > 0)
    return cleaned.where(left).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked over five-word shingles at 0.8 the one with the smallest id stays; of
    rows that repeat its id and text, one. A row is known by id and text, so an id that stands for several
    unlike texts keeps them all. Documents without words or without id are no one's copies."""
    prepare(spark)
    text_hash = F.xxhash64(F.col("text").cast("binary"))
    named = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text_hash.alias("h"))).alias("doc_id"), "text")
    groups = truncate_lineage(jaccard_join.join_groups(named, width=COPY_WIDTH, percent=COPY_PERCENT)
                              .where("n_shingles > 0 AND doc_id IS NOT NULL"), "groups")

    own, text_key, row_key = (fresh(c, docs.columns) for c in ("_id", "_h", "_row"))
    keys = [F.col("doc_id.doc_id").alias(own), F.col("doc_id.h").alias(text_key)]

    def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
        return rows.join(keys, (rows["doc_id"] == keys[own]) & (F.xxhash64(rows["text"].cast("binary")) == keys[text_key]), "left_anti")

    copies = truncate_lineage(groups.where("component_id < doc_id").select(*keys).distinct(), "copies")
    kept = without(docs, jaccard_join.small(copies)).select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = truncate_lineage(groups.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select(*keys), "repeated")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(repeated, (F.col("doc_id") == F.col(own)) & (text_hash == F.col(text_key))).groupBy(own, text_key) \
        .agg(F.min_by(row, F.to_json(row)).alias(row_key)).select(f"{row_key}.*")
    return without(kept, repeated).select(*[F.col(f"`{c}`") for c in docs.columns]).union(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, unchanged."""
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    scanned = decontaminate.scan(fold(docs), benchmark, keep_text=True)
    return unfold(scanned.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most ``CAPACITY`` tokens in their sequences."""
    prepare(spark)
    return best_fit.pack(docs, CAPACITY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            target = work_dir(spark, f"stage-{i}-{name}")
            docs.write.parquet(target)
            docs = spark.read.schema(docs.schema).parquet(target)
    return docs
