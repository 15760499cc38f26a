"""Toxicity from subword bags: character n-gram vectors, averaged per word, under a linear softmax.

A word is the average of the vectors of its character n-grams (hashed into a fixed table), so a
misspelling or a new ending keeps most of a known word's vector. The linear layer turns each word's
average into a score; a text's log-odds are the log-sum of its distinct words' exponentials plus a bias,
so that one insult counts in a text of any length. Vectors, layer and bias are trained jointly in numpy
by Adam on a bounded sample.

For scoring, each n-gram's vector and the layer collapse into one number, and a worker remembers the
words it has met. No shuffle of texts. Edge cases: null and empty texts, and texts without any word,
score as texts without a toxic word (the bias alone); without labels of both kinds the score is the share
of label 1, or 0 without any label; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_batch, schema_with, string_list, texts_of
from .labelled import labelled_sample
from .words import WORD_BYTES, Growing, RunTable, chunks, join_bytes, mix, powers, run_hashes, runs

BUCKETS = 1 << 17
SIZES = (2, 3, 4, 5)
_FLOOR = 1e-6


class Model(NamedTuple):
    grams: np.ndarray  # one number per bucket
    bias: float
    constant: float | None


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts and ends, and where each text's words begin."""
    data, bounds = join_bytes([t.lower().encode("utf-8", "replace") for t in texts])
    starts, ends = runs(WORD_BYTES[data])
    return data, starts, ends, np.searchsorted(starts, bounds)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``<word>``, and where each word's begin."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    end = np.repeat(np.cumsum(lengths), lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h += (points[k:len(points) - n + 1 + k] + np.uint64(1)) * powers(n + 2)[k + 1]
        fits = np.arange(len(h)) + n <= end[:len(h)]
        found.append((mix(h[fits]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(word[:len(h)][fits])
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return found[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def train(texts: list[str], y: np.ndarray, share: float, width: int = 8, steps: int = 80, rate: float = 0.05,
          decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the mean log loss; classes are weighted back to ``share`` of label 1."""
    data, starts, ends, first = words_of(texts)
    hashes = run_hashes(data, starts, ends)
    distinct, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    vocabulary = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
    pair = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * len(vocabulary) + number)
    doc, word = pair // len(vocabulary), pair % len(vocabulary)
    grams, begin = grams_of(vocabulary)
    count = np.diff(begin).astype(np.float32)
    used, gram = np.unique(grams, return_inverse=True)
    gram = gram.astype(np.int32)
    by_gram = np.argsort(gram, kind="stable")
    word_by_gram = np.repeat(np.arange(len(vocabulary), dtype=np.int32), np.diff(begin))[by_gram]
    gram_begin = np.searchsorted(gram[by_gram], np.arange(len(used)))
    del by_gram
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(used), width)).astype(np.float32)
    layer = rng.normal(0, 1, width).astype(np.float32)
    bias = np.float32(-8.0)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, layer, bias)]
    for step in range(1, steps + 1):
        # average of vectors, then the layer = average of the vectors' layer values
        value = np.exp(np.clip(np.add.reduceat((vectors @ layer)[gram], begin[:-1]) / count, -20, 20))
        total = np.bincount(doc, weights=value[word], minlength=len(texts)) + _FLOOR
        z = bias + np.log(total)
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        on_word = np.bincount(word, weights=(slope / total)[doc], minlength=len(vocabulary)) * value / count
        on_gram = np.add.reduceat(on_word.astype(np.float32)[word_by_gram], gram_begin)
        gradients = [on_gram[:, None] * layer + decay * vectors / len(y), on_gram @ vectors + decay * layer, np.float32(slope.sum())]
        moved = []
        for p, g, m in zip((vectors, layer, bias), gradients, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            moved.append(p - rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8))
        vectors, layer, bias = moved[0].astype(np.float32), moved[1].astype(np.float32), np.float32(moved[2])
    # n-grams never met: as the average of those met, an ordinary word's
    flat = np.full(BUCKETS, float(np.median(vectors @ layer)), dtype=np.float32)
    flat[used] = vectors @ layer
    return Model(flat, float(bias), None)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, rows: int = 2500,
        size: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fitted on at most ``rows`` texts and ``size`` bytes of each label; runs Spark jobs to draw them."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, rows, size, id_col, text_col)
    y = np.array(sample.labels, dtype=float)
    if len(set(sample.labels)) < 2:
        return Model(np.zeros(0, np.float32), 0.0, sample.share or 0.0)
    return train([t.decode("utf-8", "replace") for t in sample.texts], y, sample.share)


class Scorer:
    def __init__(self, model: Model, limit: int = 1_000_000):
        self.model, self.table, self.value = model, RunTable(limit), Growing(np.float32)

    def _learn(self, words: list[str]) -> None:
        if self.table.index.count == 0:
            self.value = Growing(np.float32)
        grams, begin = grams_of(words)
        mean = np.add.reduceat(self.model.grams[grams], begin[:-1]) / np.diff(begin)
        self.value.extend(np.exp(np.clip(mean, -20, 20)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        out = np.zeros(len(texts))
        for start, end in chunks(texts):
            data, starts, ends, first = words_of(texts[start:end])
            hashes = run_hashes(data, starts, ends)
            number = self.table.numbers(hashes, lambda at: self._learn(
                [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())]))
            doc = np.repeat(np.arange(end - start), np.diff(first))
            pair = np.unique((doc << 32) | number)
            total = np.bincount(pair >> 32, weights=self.value.data[pair & 0xFFFFFFFF], minlength=end - start)
            z = self.model.bias + np.log(total + _FLOOR)
            out[start:end] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


_SCORERS: dict[str, Scorer] = {}  # of a worker, by scoring run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score; the model is a table of fixed size."""
    rows = texts_of(docs, id_col, text_col)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        return {"doc_id": batch["doc_id"], "score": pa.array(_SCORERS[key].scores(string_list(batch["text"])))}

    return rows.mapInArrow(per_batch(work, ["doc_id", "score"]), schema_with(rows, "score double"))
