"""Readers and the writer for experiment files. All schemas are declared."""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions.scalar import as_col, parse_recorded_date, parse_run_code

# Schedule file names, connection_<nodes>.<trials>.<neighbourhood>_<seed>.csv
PAIR_FILE_PATTERN = r"connection_(\d+)\.(\d+)\.(\d+)_(\d+)"


def _csv(spark: SparkSession, path, schema: T.StructType, **options) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def _files_by_header(spark: SparkSession, path) -> list[tuple[list[str], list[str]]]:
    """The distinct header lines of CSV files, and the files of each. One job: a file's first line is the
    one with the smallest running id in the block that begins the file."""
    first = (spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                          F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
             .where("block = 0").groupBy("file").agg(F.min_by("value", "i").alias("header")))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(next(csv.reader([r["header"].lstrip("\ufeff")])), r["files"]) for r in groups]


def _by_name(spark: SparkSession, path, schema: T.StructType, more: dict[str, Column] | None = None,
             spelled: Callable[[str], str] = lambda c: c, groups: list[tuple[list[str], list[str]]] | None = None,
             **options) -> DataFrame:
    """CSV files with a header each: columns are matched by name file by file, so files may order them
    differently or lack some (NULL). ``spelled``: a header's name as the schema has it; ``more``: columns from
    file metadata."""
    by_name = {f.name: f for f in schema.fields}
    parts = []
    for header, files in _files_by_header(spark, path) if groups is None else groups:
        names = [spelled(c) for c in header]
        found = T.StructType([by_name.get(c, T.StructField(f"_{i}", T.StringType())) if c not in names[:i] else T.StructField(f"_{i}", T.StringType())
                              for i, c in enumerate(names)])
        parts.append(_csv(spark, files, found, **options).select(
            *[F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
            *[c.alias(n) for n, c in (more or {}).items()]))
    if not parts:
        return spark.createDataFrame([], schema).select("*", *[F.lit(None).cast("string").alias(n) for n in more or {}])
    return functools.reduce(DataFrame.unionByName, parts)


def read_interactions(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """The long log. CSV columns may come in any order, another one in each file, and may be a subset: they
    are matched by header name, and absent ones are NULL. Parquet keeps its own schema."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return _by_name(spark, path, schemas.INTERACTIONS, spelled=lambda c: "random_id" if c == "random ID" else c)


def run_metadata(file_path: Column | str) -> dict[str, Column]:
    """Identifier and condition columns taken from the name of a run's file, or of the folder that holds its part
    files (``name=`` in front, as partitioned writers have it, does not matter)."""
    code = F.regexp_extract(as_col(file_path), r"(?:^|/|=)([fh]\d+[sh]\d+)[^/]*(?:/part-[^/]*)?$", 1)
    return {"Identifier": F.nullif(code, F.lit("")), **parse_run_code(code)}


def read_run_files(spark: SparkSession, path) -> DataFrame:
    """Many one-run CSV files as one table; the condition comes from the file name."""
    return _by_name(spark, path, schemas.RUN_LOG, run_metadata(F.col("_metadata.file_path")))


def read_prepost(spark: SparkSession, path) -> DataFrame:
    """The wide pre/post table: quoted commas and line breaks inside fields."""
    df = _by_name(spark, path, schemas.PREPOST, run_metadata(F.col("_metadata.file_path")), multiLine=True, escape='"', quote='"')
    return (df.withColumn("recorded_at", parse_recorded_date("RecordedDate"))
            .withColumnRenamed("random ID", "random_id"))


def read_pairs(spark: SparkSession, path) -> DataFrame:
    """Pairing schedules with or without a header row; parameters from the file name."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.PAIRS.fields])
    df = spark.read.schema(raw).option("ignoreTrailingWhiteSpace", True).csv(path)
    part = lambda i: F.regexp_extract(F.col("_metadata.file_name"), PAIR_FILE_PATTERN, i).try_cast("int")
    return (df.select(*[F.col(f.name).try_cast("int").alias(f.name) for f in schemas.PAIRS.fields],
                      part(1).alias("n"), part(2).alias("trials"),
                      part(3).alias("neighbourhood"), part(4).alias("seed"))
            .where(F.col("Node1").isNotNull()))


def read_survey(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """One row per question of a survey definition: a file each, or with ``lines`` one in every line."""
    raw = spark.read.schema(schemas.SURVEY).option("multiLine", not lines).json(path)
    element = (raw.select(F.col("SurveyEntry.SurveyName").alias("survey"),
                          F.explode("SurveyElements").alias("e"))
               .where(F.col("e.Element") == "SQ"))
    q = element.select("survey", F.col("e.PrimaryAttribute").alias("question_id"),
                       F.from_json("e.Payload", schemas.SURVEY_QUESTION).alias("q"))
    return q.select(
        "survey", "question_id",
        F.col("q.DataExportTag").alias("tag"), F.col("q.QuestionText").alias("text"),
        F.col("q.QuestionType").alias("type"), F.col("q.Selector").alias("selector"),
        F.col("q.Validation.Settings.Type").alias("rule"),
        F.col("q.Validation.Settings.MinChars").try_cast("int").alias("min_chars"),
        F.col("q.Validation.Settings.TotalChars").try_cast("int").alias("max_chars"))


def _by_header(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Columns by each file's header (index and unknown columns dropped), typed as declared. Case does not matter, and
    R writes spaces in column names as dots."""
    plain = {f.name.lower(): f.name for f in schema.fields}
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    d = _by_name(spark, path, text, spelled=lambda c: plain.get(re.sub(r"[. ]", "_", c).lower(), c), multiLine=True, escape='"')
    return d.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_tweets(spark: SparkSession, path) -> DataFrame:
    schema = T.StructType([*schemas.TWEETS.fields])
    return _by_header(spark, path, schema)


def read_claims(spark: SparkSession, path) -> DataFrame:
    return _by_header(spark, path, schemas.CLAIMS)


def read_sweep(spark: SparkSession, path) -> DataFrame:
    """Sweep results; the unnamed index column is dropped."""
    return _by_header(spark, path, schemas.SWEEP)


def read_curves(spark: SparkSession, path) -> DataFrame:
    """Wide curves: ``Trial`` plus one double column per curve, names kept as they are."""
    groups = _files_by_header(spark, path)
    keep = list(dict.fromkeys(c for header, _ in groups for c in header if c and c != "Trial"))
    text = T.StructType([T.StructField(c, T.StringType()) for c in ["Trial", *keep]])
    df = _by_name(spark, path, text, groups=groups)
    return df.select(F.col("Trial").try_cast("int").alias("Trial"),
                     *[F.col(f"`{c}`").try_cast("double").alias(c) for c in keep])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "errorifexists") -> None:
    """Write a table, partitioned so that condition filters prune folders. Rows are rebalanced
    on the partition columns first: AQE splits a partition value which holds much of the data
    over many tasks, and merges small ones, so that file sizes stay even."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def sample_schedule(runs: DataFrame, schedules: DataFrame, seeds: int = 10, seed: int = 0,
                    run_col: str = "Identifier") -> DataFrame:
    """Give each run one of ``seeds`` schedules of its size, chosen by a hash of the run."""
    pick = (F.pmod(F.xxhash64(F.col(run_col), F.lit(seed)), F.lit(seeds)) + 1).cast("int")
    chosen = runs.select(run_col, F.col("Size").alias("n"), pick.alias("seed"))
    return chosen.join(schedules, ["n", "seed"])
