"""Best-fit packing by length counts.

The driver sees the histogram of piece lengths only (at most ``capacity`` numbers) and packs counts:
lengths in descending order, each into the open sequences with the least room that still takes it, whole
groups of equal sequences at a time. The plan is a short list of slot ranges; a piece takes the slot of
its rank among the pieces of its length. Ranks come from counters kept while the pieces are written, so
no task ever sorts or gathers a length, however common it is.

Edge cases: a null text is an empty document, one piece of its end id (no piece without an end id); ids
may repeat or be null, each row is packed; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import work_dir
from .common import schema_with, string_list, texts_of
from .tokens import checksum, encoder


class Slots(NamedTuple):
    """Pieces of a length with ranks first .. past - 1 take, ``each`` to a sequence, the sequences from
    ``sequence`` on, beginning at ``offset``."""
    length: int
    first: int
    past: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Slots]:
    """Best-fit decreasing over counts. A group is a range of sequences with equal room left; a length
    opens or splits at most two, so groups and slots are bounded by ``capacity``, not by the documents."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots: list[Slots] = []
    used = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(free: int, start: int, end: int) -> int:
            """Fill sequences start .. end - 1, all with ``free`` left; returns the first untouched."""
            nonlocal left, rank
            each = free // length
            whole = min(end - start, left // each)
            if whole:
                slots.append(Slots(length, rank, rank + whole * each, start, each, capacity - free))
                room[free - each * length].append((start, start + whole))
                rank, left, start = rank + whole * each, left - whole * each, start + whole
            if left and start < end and left < each:
                slots.append(Slots(length, rank, rank + left, start, left, capacity - free))
                room[free - left * length].append((start, start + 1))
                rank, left, start = rank + left, 0, start + 1
            return start

        for free in sorted(f for f in room if f >= length and room[f]):
            groups, room[free] = room[free], []
            for start, end in groups:
                if left:
                    start = fill(free, start, end)
                if start < end:
                    room[free].append((start, end))
            if not left:
                break
        if left:
            new = -(-left // (capacity // length))
            fill(capacity, used, used + new)
            used += new
    return slots


def write_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, name: str = "word_bpe_49k.json",
                 spaces: str | None = "dropped", end_id: int | None = 0, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut what is longer than ``capacity``, and write one row per piece with its rank among the
    pieces of its length in its part; reread from the shared folder, so ranks are fixed once written."""
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    schema = schema_with(rows, "piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"
                         + ", ids array<int>" * keep_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path, name, spaces), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], dtype=coder.dtype)
        met = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            found = [np.concatenate([ids, end]) for ids in coder.encode(string_list(batch["text"]))]
            pieces = [(i, s, f[s:s + capacity]) for i, f in enumerate(found) for s in range(0, len(f), capacity)]
            ranks = []
            for _, _, ids in pieces:
                ranks.append(met[len(ids)])
                met[len(ids)] += 1
            columns = {
                "doc_id": batch["doc_id"].take(pa.array([i for i, _, _ in pieces], pa.int64())),
                "piece": pa.array([s // capacity for _, s, _ in pieces], pa.int32()),
                "start": pa.array([s for _, s, _ in pieces], pa.int64()),
                "length": pa.array([len(x) for _, _, x in pieces], pa.int64()),
                "ids_crc32": pa.array([checksum(x) for _, _, x in pieces], pa.int64()),
                "part": pa.array([part] * len(pieces), pa.int32()), "local": pa.array(ranks, pa.int64())}
            if keep_ids:
                columns["ids"] = pa.array([x.astype(np.int32) for _, _, x in pieces], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    target = work_dir(spark, "pieces")
    rows.mapInArrow(work, schema).write.parquet(target)
    return spark.read.schema(schema).parquet(target)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset. Collects the histogram of lengths to plan."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity),
                                  "length bigint, first bigint, past bigint, sequence bigint, each bigint, slot_offset bigint")
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct(
        "first", "past", "sequence", "each", "slot_offset"))).alias("slots"))
    # at most ``capacity`` rows, some slots each, whatever the number of documents
    placed = pieces.join(before, ["length", "part"]).join(F.broadcast(by_length), "length")
    rank = F.col("local") + F.col("before")
    placed = placed.withColumn("rank", rank).withColumn("slot", F.element_at(
        F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["past"])), 1))
    step = F.col("rank") - F.col("slot.first")
    return placed.withColumn("sequence_id", F.col("slot.sequence") + F.floor(step / F.col("slot.each")).cast("bigint")) \
        .withColumn("offset", F.col("slot.slot_offset") + (step % F.col("slot.each")) * F.col("length")) \
        .drop("slot", "slots", "rank", "before", "local", "part")


def pack(docs: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with ``keep_ids=True``)."""
    return place(write_pieces(docs, capacity, **options), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from ``pack(..., keep_ids=True)``; at most ``capacity`` ids each."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
