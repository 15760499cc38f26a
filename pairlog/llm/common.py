"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Row groups of written tables with a payload column: bounds what a vectorised reader holds at once.
PAYLOAD = {"compression": "zstd", "parquet.block.size": str(8 << 20)}


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB instead of 64: texts are long, and a batch exists several times on its way
    through a Python worker. A setting of the session's own stays."""
    if spark.conf.get(_BATCH).lower().rstrip("b") in ("67108864", "64m"):
        spark.conf.set(_BATCH, "4m")


def texts_of(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of ``text``, plus ``more``; other columns are left behind."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"),
                       *[c.alias(n) for n, c in more.items()])


def binary_list(column: pa.Array) -> list[bytes]:
    """Null as empty."""
    return [x or b"" for x in column.to_pylist()]


def string_list(column: pa.Array) -> list[str]:
    """Null as empty; bytes that are no UTF-8 are replaced."""
    return [x.decode("utf-8", "replace") if x else "" for x in column.to_pylist()]


def per_batch(work: Callable[[pa.RecordBatch], dict[str, pa.Array] | None], names: list[str]):
    """A function for ``mapInArrow`` from one that maps a batch to columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
    return run


def hash_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus


def schema_with(rows: DataFrame, ddl: str) -> StructType:
    """``rows``' doc_id, whatever its type, followed by the columns of ``ddl``."""
    return StructType([rows.schema["doc_id"], *StructType.fromDDL(ddl)])


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind as it takes not to be one of ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as two columns, doc_id (a struct of all columns but the text) and text, so that whole rows
    pass through an operator whatever their columns are called."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(F.lit(0).alias(fresh("_row", docs.columns)), *rest).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def unfold(folded: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The rows of ``fold`` again, in the order of ``columns``."""
    return folded.select(*[F.col("text").cast("string").alias(c) if c == text_col else F.col("doc_id").getField(c).alias(c) for c in columns])
