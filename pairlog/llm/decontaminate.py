"""Benchmark decontamination with an FM-index per shard of training text.

A task cuts its documents into shards of at most ``SHARD_WORDS`` words (one document may be longer). In a
shard, stretches of words that the benchmark knows are kept, as symbols, if they are long enough to hold
a window (shorter ones cannot match); over them an FM-index is built, all windows of the benchmark are
searched backwards in it at once, occurrences are located by sampled suffix positions, and the words they
cover are merged into removal spans.

No shuffle: documents are scanned where they lie. The benchmark travels as broadcast blocks of at most
``BLOCK_BYTES`` of text each, as many as it needs; every shard searches block after block.

Words: A-Z lower-cased, runs of digits, letters and everything beyond ASCII. A window is ``size``
consecutive words of an item; an item with fewer words is one window; one without words has none. Edge
cases: null and empty texts have no words and are not contaminated; repeated documents are each reported;
an item without id marks words but is not listed; an empty benchmark hits nothing; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_list, schema_with, texts_of
from .fm_index import FMIndex
from .words import WORD_BYTES, HashIndex, chunks, join_bytes, run_hashes, runs, spread

SIZE = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 32 << 20


class Block(NamedTuple):
    """Part of the benchmark: its words, its distinct windows by length, and each window's items."""
    vocabulary: HashIndex
    windows: dict[int, np.ndarray]  # length -> one row of symbols for each window
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> item numbers, and where each window's begin
    names: list[str | None]


def block_of(rows: list[tuple[str | None, bytes]], size: int = SIZE) -> Block:
    data, bounds = join_bytes([text for _, text in rows])
    starts, ends = runs(WORD_BYTES[data])
    distinct, symbol = np.unique(run_hashes(data, starts, ends), return_inverse=True)
    vocabulary = HashIndex(1 << max(10, (3 * len(distinct)).bit_length()))
    vocabulary.add(distinct)
    first = np.searchsorted(starts, bounds)
    found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        n = min(size, b - a)
        if n:
            rows_, owners = found.setdefault(n, ([], []))
            rows_.append(np.lib.stride_tricks.sliding_window_view(symbol[a:b], n) + 1)
            owners.append(np.full(len(rows_[-1]), i))
    windows, items = {}, {}
    for n, (rows_, owners) in found.items():
        windows[n], number = np.unique(np.concatenate(rows_), axis=0, return_inverse=True)
        pairs = np.unique(number.ravel().astype(np.int64) * len(rows) + np.concatenate(owners))
        items[n] = pairs % len(rows), np.searchsorted(pairs // len(rows), np.arange(len(windows[n]) + 1))
    return Block(vocabulary, windows, items, [name for name, _ in rows])


def benchmark_blocks(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast blocks; the benchmark's size is measured first. One job, and one for each block."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text")) \
        .where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    context = benchmark.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1)))
    return [context.broadcast(block_of([(r["item"], bytes(r["text"])) for r in rows.where(part == k).collect()], size))
            for k in range(blocks)]


class Found(NamedTuple):
    covered: np.ndarray  # for each word of the shard
    pairs: set[tuple[int, str]]  # document in the shard, item


def search(hashes: np.ndarray, first: np.ndarray, blocks: list[Block]) -> Found:
    """``hashes``: the words of the shard's documents one behind the other; ``first``: where each begins."""
    covered = np.zeros(len(hashes), dtype=bool)
    pairs: set[tuple[int, str]] = set()
    for block in blocks:
        if not block.windows or not len(hashes):
            continue
        known = block.vocabulary.find(hashes)
        shortest = min(block.windows)
        inside = np.zeros(len(hashes) + len(first), dtype=bool)  # a gap behind each document
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside[place] = known >= 0
        a, b = runs(inside)
        long = b - a >= shortest
        a, b = a[long], b[long]
        if not len(a):
            continue
        word_at = np.full(len(inside) + 1, -1, dtype=np.int64)
        word_at[place] = np.arange(len(hashes))
        kept = word_at[spread(a, b - a + 1)]  # each run and the gap behind it
        close = np.cumsum(b - a + 1) - 1
        symbols = np.where(kept >= 0, known[kept] + 1, 0).astype(np.int64)
        symbols[close] = 0
        kept[close] = -1
        index = FMIndex(symbols, block.vocabulary.count)
        change = np.zeros(len(symbols) + 1, dtype=np.int64)
        for n, windows in block.windows.items():
            low, high = index.ranges(windows)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            times = high[hit] - low[hit]
            at = index.locate(spread(low[hit], times))
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            document = np.searchsorted(first, kept[at], side="right") - 1
            items, begin = block.items[n]
            both = np.unique(np.repeat(hit, times) * len(first) + document)
            window, document = both // len(first), both % len(first)
            count = begin[window + 1] - begin[window]
            both = np.unique(np.repeat(document, count) * len(block.names) + items[spread(begin[window], count)])
            pairs.update((d, block.names[i]) for d, i in zip((both // len(block.names)).tolist(), (both % len(block.names)).tolist())
                         if block.names[i] is not None)
        covered[kept[(np.cumsum(change[:-1]) > 0) & (kept >= 0)]] = True
    return Found(covered, pairs)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, cleaned: bool = False, keep_text: bool = False, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (words first .. past - 1 and their bytes); with
    ``cleaned`` also clean_text, the text without its spans, with ``keep_text`` the text's bytes."""
    rows = texts_of(docs, id_col, text_col)
    blocks = benchmark_blocks(benchmark, size, item_col, item_text_col)
    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "past", "byte_start", "byte_end")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size_ = 0
        for batch in batches:
            texts = binary_list(batch["text"])
            for start, end in chunks(texts, 2 << 20):
                data, bounds = join_bytes(texts[start:end])
                a, b = runs(WORD_BYTES[data])
                first = np.searchsorted(a, bounds)
                origin = np.repeat(bounds[:-1], np.diff(first))
                held.append((batch["doc_id"][start:end], run_hashes(data, a, b), first,
                             (a - origin).astype(np.int32), (b - origin).astype(np.int32), texts[start:end] if cleaned else None,
                             batch["text"][start:end] if keep_text else None))
                size_ += len(a)
                if size_ >= SHARD_WORDS:
                    yield report(held)
                    held, size_ = [], 0
        if held:
            yield report(held)

    def report(held: list[tuple]) -> pa.RecordBatch:
        hashes = np.concatenate([h[1] for h in held])
        shift = np.cumsum([0, *[len(h[1]) for h in held]])
        first = np.concatenate([*[h[2][:-1] + s for h, s in zip(held, shift)], shift[-1:]])
        found = search(hashes, first, [b.value for b in blocks])
        n = len(first) - 1
        total = np.concatenate([[0], np.cumsum(found.covered)])
        items: list[list[str]] = [[] for _ in range(n)]
        for document, name in found.pairs:
            items[document].append(name)
        byte_start, byte_end = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        spans: list[list[dict]] = [[] for _ in range(n)]
        hits = total[first[1:]] - total[first[:-1]]
        for d in np.flatnonzero(hits).tolist():
            base = int(first[d])
            for a, b in zip(*runs(found.covered[base:first[d + 1]])):
                spans[d].append({"first": int(a), "past": int(b), "byte_start": int(byte_start[base + a]), "byte_end": int(byte_end[base + b - 1])})
        columns = {"doc_id": pa.concat_arrays([h[0] for h in held]), "n_words": pa.array(np.diff(first)), "n_hit": pa.array(hits),
                   "items": pa.array([sorted(set(i)) for i in items], pa.list_(pa.string())), "spans": pa.array(spans, span)}
        if cleaned:
            texts = [t for h in held for t in h[5]]
            columns["clean_text"] = pa.array([cut(t, s) for t, s in zip(texts, spans)], pa.string())
        if keep_text:
            columns["text"] = pa.concat_arrays([h[6] for h in held])
        return pa.RecordBatch.from_pydict(columns)

    schema = schema_with(rows, "n_words bigint, n_hit bigint, items array<string>, "
                         "spans array<struct<first:bigint,past:bigint,byte_start:bigint,byte_end:bigint>>"
                         + ", clean_text string" * cleaned + ", text binary" * keep_text)
    return rows.mapInArrow(work, schema)


def cut(text: bytes, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        out.append(text[at:s["byte_start"]])
        at = s["byte_end"]
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
