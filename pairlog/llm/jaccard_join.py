"""N-gram Jaccard join by prefix filters under several token orders, and its connected components.

A document is its set of word shingles, hashed to 64 bits. If two sets reach the threshold, then under
any order of all tokens their prefixes (the first n - ceil(t n) + 1 tokens) share a token. Three orders
are used: candidates share a prefix token under the first, at places from which the threshold can still be
reached, and are verified only if their prefixes also meet under the second and the third. In all orders the most common shingles come last, so that what many
documents share (passages, boilerplate) is no reason for a candidate. Any order gives the same result;
the table of common shingles, of at most ``COMMON`` entries counted over all documents, only spares work.

Equal sets are one node. First every node is compared with one partner: each bucket (the nodes that share
a prefix token) offers its most typical node, the one whose tokens lie in the largest buckets, and a node
takes the offer it shares most tokens with. That binds groups of copies of any size with as many
comparisons as documents. Then, in buckets that still hold several components, the pairs across
components that the size and position filters allow are verified, so no link between components is lost.

Texts are read four times (common shingles, prefixes, two verifications); only those of candidates are
shuffled, compressed.

Edge cases: null, empty and word-less texts have empty sets and link with nothing; fewer words than a
shingle make one token; null ids never become a component's id unless nothing else is in it; repeated rows
are equal sets; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import truncate_lineage, work_dir
from .common import PAYLOAD, binary_list, schema_with, texts_of
from .components import components
from .words import SOLID_BYTES, HashIndex, chunks, join_bytes, mix, run_hashes, runs

WIDTH = 4
PERCENT = 85
COMMON = 1 << 18
COMMON_TIMES = 16
_SEEN = 200_000
BROADCAST_ROWS = 500_000
_ORDERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, bounds = join_bytes(texts)
    starts, ends = runs(SOLID_BYTES[data])
    h = run_hashes(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    rolled = np.full(max(0, len(h) - width + 1), width, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x100000001B3) + h[k:len(h) - width + 1 + k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * np.uint64(0x100000001B3) + x
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def signature(s: np.ndarray) -> int:
    """One 64-bit number for a set."""
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def common_shingles(docs: DataFrame, width: int = WIDTH, text_col: str = "text", id_col: str = "doc_id") -> np.ndarray:
    """The most common shingles, ascending by count. Tasks count over segments of their documents and
    report what occurs at least twice there; the sums are exact enough to order by."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"token": pa.array(tokens[n > 1].view(np.int64)), "n": pa.array(n[n > 1])})

        for batch in batches:
            texts = binary_list(batch["text"])
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], width)
                held += sets
                size += sum(map(len, sets))
                if size > 1_000_000:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counted = texts_of(docs, id_col, text_col).select("text").mapInArrow(work, "token bigint, n bigint") \
        .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_TIMES)
    top = counted.orderBy(F.desc("n"), "token").limit(COMMON).toPandas()  # bounded
    return top["token"].to_numpy(dtype=np.int64).view(np.uint64)[::-1].copy()


def prefixes(docs: DataFrame, common: np.ndarray, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), n, sig, and the prefixes a (tokens in the first order), b and c (32-bit tokens under the
    other orders); the prefixes are null where the task has already given them for an equal set."""
    rows = texts_of(docs, id_col, text_col, key=F.xxhash64(F.col(f"`{text_col}`").cast("binary")))
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(1 << max(10, (3 * len(shared.value)).bit_length()))
        index.add(shared.value)
        seen: set[int] = set()
        for batch in batches:
            texts = binary_list(batch["text"])
            sizes, sigs, lists = [], [], ([], [], [])
            for start, end in chunks(texts):
                for s in shingle_sets(texts[start:end], width):
                    sizes.append(len(s))
                    sigs.append(signature(s))
                    if not len(s) or sigs[-1] in seen:
                        for x in lists:
                            x.append(None)
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(sigs[-1])
                    p = prefix_length(len(s), percent)
                    rank = index.find(s)
                    for k, salt in enumerate(_ORDERS):
                        key = np.where(rank >= 0, rank.astype(np.uint64) | np.uint64(1 << 63), mix(s ^ salt) >> np.uint64(1))
                        near = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
                        tokens = s[near[np.argsort(key[near])]]
                        lists[k].append(tokens.view(np.int64) if k == 0 else (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "key": batch["key"], "n": pa.array(sizes, pa.int64()), "sig": pa.array(sigs, pa.int64()),
                "a": pa.array(lists[0], pa.list_(pa.int64())), "b": pa.array(lists[1], pa.list_(pa.int32())),
                "c": pa.array(lists[2], pa.list_(pa.int32()))})

    return rows.mapInArrow(work, schema_with(rows, "key bigint, n bigint, sig bigint, a array<bigint>, b array<int>, c array<int>"))


def verify(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``pairs`` (x, y) whose texts (sig, z) reach the threshold, with the intersection's size."""
    rows = pairs.join(texts.select(F.col("sig").alias("x"), F.col("z").alias("zx")), "x") \
        .join(texts.select(F.col("sig").alias("y"), F.col("z").alias("zy")), "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            x, y = batch["x"].to_pylist(), batch["y"].to_pylist()
            packed = dict(zip(x, batch["zx"].to_pylist())) | dict(zip(y, batch["zy"].to_pylist()))
            names = list(packed)
            found: dict[int, np.ndarray] = {}
            for i in range(0, len(names), 256):
                some = [expand.decompress(packed[s]) for s in names[i:i + 256]]
                for start, end in chunks(some):
                    found |= zip(names[i + start:i + end], shingle_sets(some[start:end], width))
            both = [len(np.intersect1d(found[a], found[b], assume_unique=True)) for a, b in zip(x, y)]
            ok = [100 * n >= percent * (len(found[a]) + len(found[b]) - n) for a, b, n in zip(x, y, both)]
            yield pa.RecordBatch.from_pydict({"x": batch["x"], "y": batch["y"], "shared": pa.array(both, pa.int64())}).filter(pa.array(ok, pa.bool_()))

    return rows.select("x", "y", "zx", "zy").mapInArrow(work, "x bigint, y bigint, shared bigint")


def join_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row. Runs its jobs step by step; intermediate tables go
    to the shared folder."""
    spark = docs.sparkSession
    target = work_dir(spark, "prefixes")
    made = prefixes(docs, common_shingles(docs, width, text_col, id_col), width, percent, id_col, text_col)
    made.write.options(**PAYLOAD).parquet(target)
    table = spark.read.schema(made.schema).parquet(target)
    nodes = table.where(F.col("a").isNotNull())
    entries = nodes.select("sig", "n", F.posexplode("a").alias("pos", "token"))
    buckets = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("sig").alias("lo"), F.max("sig").alias("hi")) \
        .where("lo <> hi").select("token", "k")
    shared = truncate_lineage(entries.join(buckets, "token").distinct(), "buckets")

    # one partner for every node: of its buckets' most typical nodes the one it shares most tokens with
    typical = shared.groupBy("sig").agg((F.sum(F.log2("k")) / (F.first("n") * (100 - percent) / 100 + 1)).alias("typical"))
    hubs = shared.join(typical, "sig").groupBy("token").agg(F.max(F.struct("typical", "sig", "n", "pos")).alias("hub"))
    near = shared.join(hubs, "token").where(F.col("sig") != F.col("hub.sig")).where(possible("n", "pos", "hub.n", "hub.pos", percent))
    partner = near.groupBy(F.col("sig").alias("x"), F.col("hub.sig").alias("y")).agg(F.count(F.lit(1)).alias("k"), F.max("hub.typical").alias("t")) \
        .groupBy("x").agg(F.max(F.struct("k", "t", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
    first_links = linked(docs, partner, nodes, table, "first", width, percent, id_col, text_col)
    rooted = truncate_lineage(components(first_links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")

    member = shared.select("sig", "n", "pos", "token").join(rooted.withColumnRenamed("node", "sig"), "sig", "left") \
        .withColumn("root", F.coalesce("root", "sig"))
    mixed = member.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    open_ = member.join(mixed, "token")
    x, y = (open_.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("sig", "n", "pos", "root")]) for s in "xy")
    across = x.join(y, "token").where((F.col("sig_x") > F.col("sig_y")) & (F.col("root_x") != F.col("root_y"))) \
        .where(possible("n_x", "pos_x", "n_y", "pos_y", percent)) \
        .select(F.col("sig_x").alias("x"), F.col("sig_y").alias("y")).distinct()
    second_links = linked(docs, across, nodes, table, "second", width, percent, id_col, text_col)
    rooted = truncate_lineage(components(first_links.union(second_links).select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")

    sets = table.groupBy("sig").agg(F.min("doc_id").alias("least")).join(rooted.withColumnRenamed("node", "sig"), "sig", "left") \
        .withColumn("root", F.coalesce("root", "sig"))
    named = sets.join(sets.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "component_id")
    return table.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(named, "sig").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def possible(n_x: str, pos_x: str, n_y: str, pos_y: str, percent: int) -> Column:
    """Whether two sets can reach the threshold by their sizes, and if the token at these places is the
    first they share (which is so for one of the tokens that a linked pair meets at)."""
    a, p, b, q = (F.col(c) for c in (n_x, pos_x, n_y, pos_y))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * F.least(a - p, b - q) >= percent * (a + b))


def small(keys: DataFrame) -> DataFrame:
    """A written table of a few numbers per row, to be broadcast if its counted rows are within
    ``BROADCAST_ROWS`` (about 16 MB); else an ordinary side of a shuffled join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def linked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, table: DataFrame, name: str, width: int, percent: int,
           id_col: str, text_col: str) -> DataFrame:
    """The pairs (x, y) that reach the threshold, as a written table: prefixes must meet under the second and
    the third order, then texts are compared."""
    pairs = truncate_lineage(pairs, f"{name}-pairs")
    ends = truncate_lineage(pairs.select(F.explode(F.array("x", "y")).alias("sig")).distinct(), f"{name}-ends")
    filters = truncate_lineage(nodes.select("sig", "b", "c").join(small(ends), "sig", "left_semi").groupBy("sig").agg(
        F.first("b").alias("b"), F.first("c").alias("c")), f"{name}-filters")
    x, y = (filters.select(F.col("sig").alias(s), F.col("b").alias(f"b_{s}"), F.col("c").alias(f"c_{s}")) for s in "xy")
    met = truncate_lineage(pairs.join(x, "x").join(y, "y").where(F.arrays_overlap("b_x", "b_y") & F.arrays_overlap("c_x", "c_y"))
                           .select("x", "y"), f"{name}-met")
    texts = truncate_lineage(texts_by_signature(docs, met.select(F.explode(F.array("x", "y")).alias("sig")).distinct(), table,
                                                id_col, text_col), f"{name}-texts")
    return truncate_lineage(verify(met, texts, width, percent).select("x", "y"), f"{name}-links")


def texts_by_signature(docs: DataFrame, wanted: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sig, z: the compressed text of one document for every wanted set. A task sends each text once."""
    rows = texts_of(docs, id_col, text_col, key=F.xxhash64(F.col(f"`{text_col}`").cast("binary"))).where(F.col("text").isNotNull()).select("key", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        seen: set[int] = set()
        for batch in batches:
            keys, out = [], []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                if key not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    out.append(squeeze.compress(text))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "z": pa.array(out, pa.binary())})

    one = truncate_lineage(table.select("sig", "key").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("key").alias("key")), "keys")
    return rows.mapInArrow(work, "key bigint, z binary").join(small(one), "key").dropDuplicates(["key", "sig"]).select("sig", "z")
