"""Quality score from compression: which of two dictionaries shortens a text more.

One zstandard dictionary is trained on texts labelled good, one on texts labelled bad. A text is cut
into pieces of ``PIECE`` bytes, so that a dictionary counts as much at its end as at its beginning, and
each piece is compressed with both. The difference of the total sizes over their sum, together with the
compressibility itself, goes through a logistic regression fitted in numpy on the training sample, and
becomes the probability of label 1.

No shuffle of texts: training sees a bounded sample (``rows``, ``size`` bytes for each label), scoring is
a map. Edge cases: null and empty texts score 0; without usable labels of both kinds every other text
scores the share of label 1, or 0.5 without any label; repeated rows score alike; an empty table gives
no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import binary_list, per_batch, schema_with, texts_of
from .labelled import labelled_sample

PIECE = 1024
LEVEL = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: list[float]
    centre: list[float]
    scale: list[float]
    constant: float | None  # the score where nothing could be fitted


class _Coder:
    def __init__(self, model: Model):
        import zstandard

        self.coders = []
        for data in (model.good, model.bad):
            words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
            words.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float, float]:
        good = bad = 0
        squeeze_good, squeeze_bad = self.coders[0].compress, self.coders[1].compress
        for i in range(0, len(text), PIECE):
            piece = text[i:i + PIECE]
            good += len(squeeze_good(piece))
            bad += len(squeeze_bad(piece))
        return (bad - good) / (bad + good), min(good, bad) / len(text), np.log2(len(text) + 8.0)


def _expand(x: np.ndarray) -> np.ndarray:
    d, r, n = x.T
    return np.stack([d, r, n, d * d, r * r, d * r, d * n, r * n], axis=1)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard

    samples = [t[i:i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text: the texts are the dictionary
        return b"".join(samples)[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method for a weighted ridge logistic regression with an intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = ridge * weight.sum() * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, rows: int = 3000,
        size: int = 10_000_000, dictionary_size: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Two thirds of the sample make the dictionaries, the rest calibrates the score (texts in a
    dictionary would compress too well to calibrate on). Runs Spark jobs to draw the sample."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, rows, size, id_col, text_col)
    y = np.array(sample.labels, dtype=float)
    dictionary = np.arange(len(y)) % 3 > 0
    if min((y[~dictionary] == v).sum() for v in (0, 1)) < 2 or not all((y[dictionary] == v).any() for v in (0, 1)):
        return Model(b"", b"", [], [], [], 0.5 if sample.share is None else sample.share)
    good, bad = (_dictionary([t for t, v, d in zip(sample.texts, y, dictionary) if d and v == k], dictionary_size) for k in (1, 0))
    coder = _Coder(Model(good, bad, [], [], [], None))
    held = [(t, v) for t, v, d in zip(sample.texts, y, dictionary) if not d and t]
    raw = _expand(np.array([coder.features(t) for t, _ in held]))
    centre, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-9
    target = np.array([v for _, v in held])
    share = min(max(sample.share, 1e-3), 1 - 1e-3)
    ones = target.mean()
    weight = np.where(target == 1, share / ones, (1 - share) / (1 - ones))  # back to the labels' true shares
    w = _logistic((raw - centre) / scale, target, weight)
    return Model(good, bad, w.tolist(), centre.tolist(), scale.tolist(), None)


def score(docs: DataFrame, model: Model, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, with ``keep_text`` also the text's bytes. The model (two dictionaries of bounded size) travels with the plan."""
    rows = texts_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = scores(shared.value, binary_list(batch["text"]))
        return {"doc_id": batch["doc_id"], "score": pa.array(found), "text": batch["text"]}

    return rows.mapInArrow(per_batch(work, ["doc_id", "score", *["text"] * keep_text]),
                           schema_with(rows, "score double" + ", text binary" * keep_text))


_CODERS: dict[int, _Coder] = {}


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts))
    full = [i for i, t in enumerate(texts) if t]
    if model.constant is not None:
        out[full] = model.constant
        return out
    key = hash((model.good, model.bad))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = _Coder(model)
    if full:
        raw = _expand(np.array([_CODERS[key].features(texts[i]) for i in full]))
        z = (raw - np.array(model.centre)) / np.array(model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
        out[full] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out
