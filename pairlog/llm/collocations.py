"""Phrase collocations of two to four words from a weighted de Bruijn graph, for each language.

Nodes are phrases of three words, edges the phrases of four words that join overlapping nodes, weighted by
their occurrences. Only edges and piece ends are counted in the texts, one record for each word place: the
edge that begins there, or, near the end of a piece, the shorter phrase that ends it. All shorter counts follow
from the flow through the nodes: a phrase occurs as often as the edges leaving it plus the pieces that end with
it, level by level down to single words. A node whose whole flow leaves by one edge lies on a unary path and is
compacted: it is no candidate of its own, since the longer phrase has all its occurrences.

Before the edges are counted, tasks count the phrases of one to four words by hash into ``2^bits`` buckets of a
byte each (capped at the threshold, which keeps the test exact), sum them bucket by bucket, and keep one bit for
each bucket. A record is cut short where its phrase's bucket, or that of words inside the phrase, stays below the
threshold: such a phrase is no candidate, nor part of one, and its shorter beginnings are counted all the same.
Places of rare words are only counted together. The filter has a fixed size, whatever the input; where it fills
up, it only spares less work.

Scale: two passes over texts that stay in place. A chunk of texts has one row for each of its unlike records, so
that the rows made follow the text read and not what else a task has seen; Spark's partial aggregation sums them
in each task. Shuffled are the buckets and those sums; hot words and hot phrases meet as partial sums, and
one-word parts of phrases are salted when their counts are looked up. A language may hold any share: its ranking
takes the first ``top`` of hashed parts first.

Scores are floor(2000000 a / (l + r)) in decimals, the smallest over the cuts of a phrase, ties to the first
cut. A phrase is dropped when a phrase with one more word has at least 80 % of its count; a yet longer one
can't have more than the one between.

Cases: NULL text is empty, NULL lang is ``und``. Memory follows the longest piece of a text, not the text.
Ties in the ranking go by count, then by the phrase's bytes. Repeated rows count as often as they are there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import truncate_lineage
from .common import binary_list
from .words import CHUNK, byte_class, chunks, join_bytes, mix, run_hashes, runs, spread

LONGEST = 4
LEAST = 30
TOP = 2000
BITS = 24
SALTS = 16
PARTS = 64  # of a language's candidates, ranked apart first
_BLOCK = 1 << 16  # buckets in a row of the shuffle
_BREAKS = byte_class([(0x0A, 0x0D), *[(b, b) for b in b".,;:!?"]])
_WORD = ~(_BREAKS | byte_class([(0x20, 0x20), (0x09, 0x09)]))
_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _short(texts: list[bytes], langs: list[str]) -> tuple[list[bytes], list[str]]:
    """Texts longer than a chunk are cut behind the end of a piece; phrases never cross one."""
    if all(len(t) <= CHUNK for t in texts):
        return texts, langs
    out, names = [], []
    for text, lang in zip(texts, langs):
        start = 0
        while len(text) - start > CHUNK and (found := _PIECE_END.search(text, start + CHUNK)):
            out.append(text[start:found.end()])
            names.append(lang)
            start = found.end()
        out.append(text[start:])
        names.append(lang)
    return out, names


class Chunk:
    """Words of some texts: places in ``data``, how many words of the piece begin at each word (``LONGEST`` at
    most), and ``grams[k - 1]``, the hash of the k words from there, which tells languages apart."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data, bounds = join_bytes(texts)
        self.starts, self.ends = runs(_WORD[self.data])
        words = np.diff(np.searchsorted(self.starts, bounds))
        self.text = np.repeat(np.arange(len(texts)), words)
        m = len(self.starts)
        names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        raw = np.frombuffer("".join(f"{x}\0" for x in names).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        own = run_hashes(raw, *runs(raw != 0)) if all(names) else np.array([hash_of(x) for x in names], dtype=np.uint64)
        lang = own[np.array([names[x] for x in langs], dtype=np.int64)[self.text]] if m else np.zeros(0, dtype=np.uint64)
        piece = np.cumsum(_BREAKS[self.data], dtype=np.int64)[self.starts]
        self.room = np.ones(m, dtype=np.int8)
        for k in range(1, LONGEST):
            if m > k:
                self.room[:-k] += piece[k:] == piece[:-k]
        word = mix(run_hashes(self.data, self.starts, self.ends) + mix(lang + np.uint64(1)))
        self.grams = [word]
        for k in range(1, LONGEST):
            longer = np.zeros(m, dtype=np.uint64)
            if m > k:
                longer[:-k] = mix(self.grams[-1][:-k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
            self.grams.append(longer)

    def buckets(self, k: int, bits: int) -> np.ndarray:
        return (self.grams[k - 1] >> np.uint64(64 - bits)).astype(np.int64)

    def phrases(self, first: np.ndarray, length: np.ndarray) -> pa.Array:
        """The words' bytes, one blank between."""
        size = self.ends - self.starts
        at = np.cumsum(size + 1) - size - 1
        flat = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
        flat[spread(at, size)] = self.data[spread(self.starts, size)]
        last = first + length - 1
        n = at[last] + size[last] - at[first]
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[spread(at[first], n)].tobytes())])


def hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode("utf-8", "surrogatepass") or b"\0", dtype=np.uint8)
    return run_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[str]]]:
    for batch in batches:
        texts, langs = _short(binary_list(batch["text"]), batch["lang"].to_pylist())
        for a, b in chunks(texts):
            yield Chunk(texts[a:b], langs[a:b]), langs[a:b]


def _packed(counts: np.ndarray) -> bytes:
    """A block as it is, or the places and values of what is not zero where that is shorter."""
    at = np.flatnonzero(counts)
    return counts.tobytes() if 3 * len(at) >= len(counts) else at.astype("<u2").tobytes() + counts[at].tobytes()


def _unpacked(data: bytes, block: int) -> tuple[np.ndarray | slice, np.ndarray]:
    if len(data) == block:
        return slice(None), np.frombuffer(data, dtype=np.uint8)
    n = len(data) // 3
    return np.frombuffer(data, dtype="<u2", count=n), np.frombuffer(data, dtype=np.uint8, offset=2 * n)


def frequent_buckets(rows: DataFrame, least: int, bits: int) -> list[bytes]:
    """For one, two, three and four words: a bit for each bucket whose phrases together occur ``least`` times or more."""
    if not 1 <= least <= 255:
        raise ValueError("the threshold of the bucket counts is from 1 to 255")
    size, regions = 1 << bits, LONGEST
    block = min(_BLOCK, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(regions * size, dtype=np.uint8)
        for chunk, _ in _chunks(batches):
            for k in range(regions):
                bucket, n = np.unique(chunk.buckets(k + 1, bits)[chunk.room > k].astype(np.uint32), return_counts=True)
                bucket = bucket.astype(np.int64) + k * size
                counters[bucket] = np.minimum(counters[bucket] + n, least)
        whole = counters.reshape(-1, block)
        used = np.flatnonzero(whole.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 16)):
            yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "counts": pa.array([_packed(whole[i]) for i in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
                if i not in sums:
                    sums[i] = np.zeros(block, dtype=np.uint8)
                at, more = _unpacked(counts, block)
                sums[i][at] = np.minimum(sums[i][at].astype(np.uint16) + more, least)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()),
                                              "bits": pa.array([np.packbits(x >= least).tobytes() for x in sums.values()], pa.binary())})

    counted = rows.mapInArrow(count, "block int, counts binary").repartition("block")
    found = {r["block"]: bytes(r["bits"]) for r in counted.mapInArrow(add, "block int, bits binary").collect()}  # 2^bits * 4 bits
    empty = bytes((block + 7) // 8)
    per = size // block
    return [b"".join(found.get(k * per + i, empty) for i in range(per)) for k in range(regions)]


def edges(docs: DataFrame, least: int = LEAST, bits: int = BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, words, n: how often a word place begins an edge of four words, or a shorter phrase that
    ends its piece or can't be part of a candidate; with no words, the places whose word is too rare for any. The
    sum of n is the number of words."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").cast("binary").alias("text")).where("text IS NOT NULL")
    kept = docs.sparkSession.sparkContext.broadcast(frequent_buckets(rows, least, bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = [np.unpackbits(np.frombuffer(x, dtype=np.uint8)).view(bool) for x in kept.value]
        for chunk, langs in _chunks(batches):
            if not len(chunk.starts):
                continue
            names = pa.array(langs, pa.string())
            on = frequent[0][chunk.buckets(1, bits)]
            length, record = on.astype(np.int64), chunk.grams[0].copy()
            rare = np.bincount(chunk.text[~on], minlength=len(langs))
            for k in range(2, LONGEST + 1):
                on = on & np.append(on[1:], False) & (chunk.room >= k) & frequent[k - 1][chunk.buckets(k, bits)]
                length[on] = k
                record[on] = chunk.grams[k - 1][on] + np.uint64(k)
            _, first, n = np.unique(record[length > 0], return_index=True, return_counts=True)
            first = np.flatnonzero(length)[first]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(chunk.text[first])), chunk.phrases(first, length[first]).cast(pa.string()),
                                              pa.array(length[first], pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "n"])
            some = np.flatnonzero(rare)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array([""] * len(some), pa.string()),
                                              pa.array(np.zeros(len(some)), pa.int32()), pa.array(rare[some], pa.int64())], names=["lang", "phrase", "words", "n"])

    found = rows.mapInArrow(work, "lang string, phrase string, words int, n bigint")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def flows(edges_: DataFrame) -> DataFrame:
    """lang, phrase, words, f, unary: all phrases that begin an edge, with the flow through them; ``unary`` where
    it leaves by a single edge and no piece ends."""
    first = lambda k: F.substring_index("phrase", " ", k)
    level = edges_.where(F.col("words") == LONGEST).select("lang", "phrase", "words", F.col("n").alias("f"), F.lit(False).alias("unary"))
    out = level
    for k in range(LONGEST - 1, 0, -1):
        ends = edges_.where(F.col("words") == k).select("lang", "phrase", F.col("n").alias("f"), F.lit(True).alias("end"))
        through = level.select("lang", first(k).alias("phrase"), "f", F.lit(False).alias("end"))
        level = through.unionByName(ends).groupBy("lang", "phrase").agg(
            F.sum("f").alias("f"), (F.count(F.lit(1)) == 1).alias("one"), F.max("end").alias("ended")).select(
            "lang", "phrase", F.lit(k).alias("words"), "f", (F.col("one") & ~F.col("ended")).alias("unary"))
        out = out.unionByName(level)
    return out


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counted = truncate_lineage(edges(docs, least, bits, text_col, lang_col), "edges")
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    known = truncate_lineage(flows(counted).where(F.col("f") >= least), "flows")
    longer = known.where("words > 2").withColumn("w", F.split("phrase", " ")).select(
        "lang", "f", F.explode(F.array(_part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    exact = lambda x: F.col(x).cast("decimal(20,0)")
    left = known.where("words > 1 AND NOT unary").join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (exact("longest") * 100 < exact("f") * 80))
    return rank(score(left, known, least), top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score(candidates: DataFrame, known: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, a, l, r, score of the weakest cut. ``known`` has the count of every part."""
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w")) \
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = cut.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("k").alias("words"), _part(1, F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), (F.col("words") - F.col("k")).alias("words"), _part(F.col("k") + 1, F.col("words")).alias("part")))).alias("p"))
    # a frequent word is part of many phrases: its count is there SALTS times
    salt = F.when(F.col("p.words") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
    parts = parts.select("lang", "phrase", "a", "k", "p.side", "p.part", salt.alias("salt"))
    counts = known.where(F.col("words") < LONGEST).select("lang", F.col("phrase").alias("part"), "f", F.explode(
        F.sequence(F.lit(0), F.when(F.col("words") == 1, SALTS - 1).otherwise(0))).alias("salt"))
    both = parts.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    value = F.expr("(CAST(2000000 AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) div CAST(CAST(l AS DECIMAL(20,0)) + r AS DECIMAL(20,0))")
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("m"))
    return weakest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def rank(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, ranked in hashed parts before they meet."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = scored.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))) \
        .where(F.col("_rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def sql(least: int = LEAST, top: int = TOP) -> str:
    return rf"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    counts AS (
      SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM places, range(1, {LONGEST + 1}) g(k)
      WHERE i + k - 1 <= len(w) GROUP BY ALL),
    known AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= {least}),
    inside AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS longest
      FROM known, range(2, {LONGEST}) h(j), range(1, {LONGEST + 1}) g(i) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
    candidates AS (SELECT c.* FROM known c LEFT JOIN inside USING (lang, phrase) WHERE k > 1 AND (longest IS NULL OR 100 * longest < 80 * f)),
    cuts AS (
      SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.f) // (x.f + y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
      JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
      JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
    weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {top}"""
