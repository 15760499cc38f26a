"""A bounded sample of labelled texts, the only rows a classifier is fitted on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Of a text longer than 1/SHARE of the bytes for its label so much is taken, as PIECES pieces evenly spread over it.
SHARE = 16
PIECES = 8


class Sample(NamedTuple):
    texts: list[bytes]
    labels: list[int]
    share: float | None  # of label 1 among all usable labels; None without any


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, size: int,
                    id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """At most ``rows`` distinct texts for each of the labels 0 and 1, together at most ``size`` bytes for
    each, chosen by a hash of the id. ``usable`` is a condition on the labels' rows, such as a fold. The
    share of label 1 is counted over all usable rows. Null labels and null ids take no part. No
    text takes more than ``size`` / ``SHARE`` bytes (see ``bounded``), so none shuts out those behind it."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & usable) \
        .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Sample([], [], None)
    order = F.xxhash64("_id")
    chosen = [known.where(F.col("_label") == v).distinct().orderBy(order, "_id").limit(rows) for v in (0, 1)]
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text")) \
        .where(F.col("_text").isNotNull())
    found, piece = [], bounded("_text", size // SHARE)
    for few in chosen:  # at most ``rows`` rows of two numbers: small by construction
        some = texts.join(F.broadcast(few), "_id").groupBy(F.xxhash64("_text").alias("_h")).agg(
            F.min(F.struct(order.alias("o"), F.col("_id"), F.col("_label").alias("y"), F.octet_length(piece).alias("n"),
                           piece.alias("t"))).alias("r")).select("r.*")
        so_far = F.sum("n").over(Window.orderBy("o", "_id").rowsBetween(Window.unboundedPreceding, 0))
        found += some.withColumn("c", so_far).where(F.col("c") <= size).select("t", "y").collect()
    return Sample([bytes(r["t"]) for r in found], [r["y"] for r in found], counts.get(1, 0) / sum(counts.values()))


def bounded(text: str, limit: int) -> Column:
    """The bytes of a text, of one longer than ``limit`` ``PIECES`` pieces, a line end between, of ``limit`` bytes together."""
    n, length = F.octet_length(text), max(1, limit // PIECES - 1)
    pieces = [F.substring(F.col(text), ((n - length).cast("bigint") * k / (PIECES - 1)).cast("int") + 1, F.lit(length)) for k in range(PIECES)]
    joined = pieces[0]
    for p in pieces[1:]:
        joined = F.concat(joined, F.lit(b"\n"), p)
    return F.when(n <= limit, F.col(text)).otherwise(joined)
