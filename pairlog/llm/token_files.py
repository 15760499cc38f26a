"""Token ids in packed files: fixed-width bits, blocks that can be read one by one.

A shard is a self-contained byte string (see ``pack``): header, document table, block offsets and bit-
packed blocks. Shards are stored as rows of a Parquet folder, so that Spark's own commit protocol makes a
retried or lost task harmless on any file system that Spark writes to; ``PackedShard`` reads a shard, any
of its blocks, or any slice of its ids with numpy alone.

Scale: texts are tokenised once, where they are read; only compressed ids are shuffled, by ranges of
the document id. A shard holds at most ``shard_ids`` ids plus one document.

Edge cases: a null text is an empty document (its end id only); null document ids come first; repeated
ids stand next to each other, ordered by content; an empty table gives no shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import work_dir
from .common import PAYLOAD, per_batch, schema_with, string_list, texts_of
from .tokens import checksum, encoder

BLOCK_IDS = 4096
SHARD_IDS = 2_000_000
_HEADER = struct.Struct("<4sIIIQQQ")
_MAGIC = b"PKID"


def bits_for(vocabulary: int) -> int:
    """The least width that holds ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian fields of ``bits`` bits, filled up to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[:n * bits].reshape(n, bits)
    return fields.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack(doc_ids: list[int | None], documents: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    """One shard: header (magic, version, bits, ids per block, documents, ids, blocks); document ids and
    whether each is known; ids before each document; byte offsets of the blocks; the blocks."""
    starts = np.zeros(len(documents) + 1, dtype="<u8")
    starts[1:] = np.cumsum([len(d) for d in documents])
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype=np.uint32)
    packed = [pack_bits(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.zeros(len(packed) + 1, dtype="<u8")
    offsets[1:] = np.cumsum([len(p) for p in packed])
    head = _HEADER.pack(_MAGIC, 1, bits, block, len(documents), len(ids), len(packed))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([head, numbers.tobytes(), known.tobytes(), starts.tobytes(), offsets.tobytes(), *packed])


class PackedShard:
    """Random access to the ids of a shard."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, docs, self.n_ids, blocks = _HEADER.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a packed shard")
        at = _HEADER.size
        numbers = np.frombuffer(data, "<i8", docs, at)
        known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(n) if k else None for n, k in zip(numbers, known)]
        at += 9 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1):]

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return unpack_bits(self.payload[self.offsets[k]:self.offsets[k + 1]], n, self.bits)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1; only the blocks that hold them are unpacked."""
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        found = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return found[start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def tokenise(docs: DataFrame, path: str | None = None, name: str = "byte_bpe_50k.json", spaces: str | None = "kept",
             end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the ids as a compressed byte string."""
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        import zstandard

        coder, squeeze = encoder(path, name, spaces), zstandard.ZstdCompressor(level=1)
        end = np.array([] if end_id is None else [end_id], dtype=coder.dtype)
        found = [np.concatenate([ids, end]) for ids in coder.encode(string_list(batch["text"]))]
        return {"doc_id": batch["doc_id"], "n_tokens": pa.array([len(f) for f in found], pa.int64()),
                "ids": pa.array([squeeze.compress(f.tobytes()) for f in found], pa.binary())}

    rows = texts_of(docs, id_col, text_col)
    return rows.mapInArrow(per_batch(work, ["doc_id", "n_tokens", "ids"]), schema_with(rows, "n_tokens bigint, ids binary"))


def write_shards(docs: DataFrame, target: str | None = None, path: str | None = None, name: str = "byte_bpe_50k.json",
                 spaces: str | None = "kept", end_id: int | None = 0, shard_ids: int = SHARD_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the documents' ids in ascending order of ``id_col`` (an integer); returns the folder.

    Columns there: part and seq (the shards' order), n_docs, n_ids, shard. Runs two Spark jobs.
    """
    spark = docs.sparkSession
    target = target or work_dir(spark, "token-shards")
    staged = work_dir(spark, "token-ids")
    tokenise(docs, path, name, spaces, end_id, id_col, text_col) \
        .withColumn("doc_id", F.col("doc_id").cast("bigint")).write.options(**PAYLOAD).parquet(staged)
    rows = spark.read.schema("doc_id bigint, n_tokens bigint, ids binary").parquet(staged)
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // (8 * shard_ids)), 1)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, expand = encoder(path, name, spaces), zstandard.ZstdDecompressor()
        bits, part, seq = bits_for(coder.size), TaskContext.get().partitionId(), 0
        numbers: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_docs": pa.array([len(held)], pa.int64()), "n_ids": pa.array([size], pa.int64()),
                "shard": pa.array([pack(numbers, held, bits)], pa.binary())})

        for batch in batches:
            for number, data in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                ids = np.frombuffer(expand.decompress(data), dtype=coder.dtype)
                if held and size + len(ids) > shard_ids:
                    yield emit()
                    numbers, held, size, seq = [], [], 0, seq + 1
                numbers.append(number)
                held.append(ids)
                size += len(ids)
        if held:
            yield emit()

    rows.select("doc_id", "ids").repartitionByRange(parts, "doc_id", F.xxhash64("ids")) \
        .sortWithinPartitions("doc_id", "ids") \
        .mapInArrow(shards, "part int, seq int, n_docs bigint, n_ids bigint, shard binary") \
        .write.options(**PAYLOAD).parquet(target)
    return target


def read_shards(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("part int, seq int, n_docs bigint, n_ids bigint, shard binary").parquet(target)


def read_documents(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with
    ``with_ids`` the ids themselves. One row per shard is all that the running sum sees."""
    stored = read_shards(spark, target)
    base = stored.select("part", "seq", (F.sum("n_ids").over(
        Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch[c].to_pylist() for c in ("part", "seq", "shard"))):
                shard = PackedShard(data)
                documents = [shard.document(i) for i in range(len(shard.doc_ids))]
                n = len(documents)
                columns = {
                    "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()),
                    "doc_id": pa.array(shard.doc_ids, pa.int64()), "local": pa.array(shard.starts[:-1]),
                    "n_tokens": pa.array(np.diff(shard.starts)),
                    "ids_crc32": pa.array([checksum(d) for d in documents], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([d.astype(np.int32) for d in documents], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    found = stored.select("part", "seq", "shard").mapInArrow(work, schema)
    return found.join(base, ["part", "seq"]).select(
        "doc_id", (F.col("local") + F.coalesce("base", F.lit(0))).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
