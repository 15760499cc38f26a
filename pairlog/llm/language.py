"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the
sum over all ways to cut it into pieces, by the forward algorithm, computed in numpy for many words at
once; a text's is the product over its words. Probabilities are learned by expectation maximisation on
the word counts of all training texts: Spark counts words by language, and each round is one job over
those counts.

Words are runs of lower-cased letters (with their marks); a run of more than ``STRETCH`` is cut into
stretches. No shuffle of texts: counting shuffles word counts, scoring is a map. Edge cases: texts that
are null or without letters are ``und`` with score 0, and so is every text if nothing was learned; rows
without language are not learned from; ties go to the language that sorts first; repeated rows score
alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import work_dir
from .common import per_batch, schema_with, string_list, texts_of
from .words import Growing, HashIndex, RunTable, chunks, mix, powers, run_hashes, runs, spread

STRETCH = 31
VOCABULARY = "piece_bpe_32k.model"
_START = 0x2581  # leads a word in the vocabulary


class Pieces(NamedTuple):
    index: HashIndex
    longest: int
    count: int  # the last one stands for any character without a piece


class Model(NamedTuple):
    languages: list[str]
    probability: np.ndarray  # pieces x languages
    path: str | None


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Code points that are letters; and those that belong to words (letters and marks)."""
    kind = np.zeros(0x110000, dtype="U1")
    for i in range(0x32000):
        kind[i] = unicodedata.category(chr(i))[0]
    letter = kind == "L"
    return letter, letter | (kind == "M")


@functools.lru_cache(maxsize=2)
def pieces(path: str | None) -> Pieces:
    """The vocabulary's pieces of letters, with or without the word start."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    word = _letters()[1]
    kept = [p for p in names if p == p.lower() and all(word[ord(c)] for c in p.replace("▁", "", 1)) and "▁" not in p[1:]]
    h = np.concatenate([_substrings(np.frombuffer(p.encode("utf-32-le"), "<u4"), len(p))[-1][:1] for p in kept])
    index = HashIndex(1 << (4 * len(kept)).bit_length())
    index.add(h)
    return Pieces(index, max(map(len, kept)), len(kept) + 1)


def _substrings(points: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the substrings of length 1, 2, ... from every place."""
    out = []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, longest + 1):
        h = h[:len(points) - n + 1] + (points[n - 1:].astype(np.uint64) + np.uint64(1)) * powers(n + 1)[n]
        out.append(mix(h + np.uint64(n)))
        if len(points) == n:
            break
    return out


class Lattice(NamedTuple):
    """All pieces in all words: arcs from one place in a word to a later one, sorted by end, then word."""
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lengths: np.ndarray


def lattice(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: Pieces) -> Lattice:
    """Of the words ``points[starts : ends]``, each led by the word start."""
    lengths = ends - starts + 1
    begin = np.cumsum(lengths) - lengths
    text = np.full(int(lengths.sum()), _START, dtype=np.uint32)
    inner = spread(begin + 1, lengths - 1)
    text[inner] = points[spread(starts, ends - starts)]
    word = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(text)) - begin[word]
    parts = []
    for n, h in enumerate(_substrings(text, known.longest), 1):
        fits = np.flatnonzero(place[:len(h)] + n <= lengths[word[:len(h)]])
        piece = known.index.find(h[fits])
        if n == 1:
            piece[piece < 0] = known.count - 1
        hit = fits[piece >= 0]
        parts.append((word[hit], place[hit], place[hit] + n, piece[piece >= 0]))
    w, s, e, p = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((w, e))
    return Lattice(w[order], s[order], e[order], p[order], lengths)


def forward(arcs: Lattice, value: np.ndarray) -> np.ndarray:
    """alpha[word, place, k]: total of all segmentations up to a place; ``value``: of each arc, k columns."""
    n = len(arcs.lengths)
    alpha = np.zeros((n, int(arcs.lengths.max()) + 1, value.shape[1]))
    alpha[:, 0] = 1
    cuts = np.searchsorted(arcs.end, np.arange(1, alpha.shape[1] + 1))
    for e in range(1, alpha.shape[1]):
        a, b = cuts[e - 1], cuts[e]
        if a < b:
            w = arcs.word[a:b]
            head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            alpha[w[head], e] = np.add.reduceat(alpha[w, arcs.start[a:b]] * value[a:b], head, axis=0)
    return alpha


def expected_counts(arcs: Lattice, language: np.ndarray, times: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """How often each language (columns) is expected to use each piece in the words, ``times`` each."""
    value = probability[arcs.piece, language[arcs.word]][:, None]
    alpha = forward(arcs, value)[:, :, 0]
    n = len(arcs.lengths)
    beta = np.zeros_like(alpha)
    beta[np.arange(n), arcs.lengths] = 1
    order = np.lexsort((arcs.word, -arcs.start))
    w, s, e, v = arcs.word[order], arcs.start[order], arcs.end[order], value[order, 0]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        head = np.flatnonzero(np.concatenate([[True], w[a + 1:b] != w[a:b - 1]]))
        beta[w[a:b][head], s[a]] = np.add.reduceat(v[a:b] * beta[w[a:b], e[a:b]], head)
    total = alpha[np.arange(n), arcs.lengths]
    share = alpha[arcs.word, arcs.start] * value[:, 0] * beta[arcs.word, arcs.end] / total[arcs.word] * times[arcs.word]
    width = probability.shape[1]
    return np.bincount(arcs.piece * width + language[arcs.word], weights=share, minlength=probability.size).reshape(probability.shape)


def cut_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts and ends of words (stretches), and where each text's words begin."""
    joined = "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bounds = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    starts, ends = runs(_letters()[1][points])
    if len(starts) and (ends - starts).max() > STRETCH:
        count = -(-(ends - starts) // STRETCH)
        first = np.repeat(starts, count)
        step = spread(np.zeros(len(count), dtype=np.int64), count)
        starts, ends = first + step * STRETCH, np.minimum(first + (step + 1) * STRETCH, np.repeat(ends, count))
    return points, starts, ends, np.searchsorted(starts, bounds)


def count_words(docs: DataFrame, usable: Column, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, n over all usable rows with a language."""
    rows = docs.where(usable & F.col(f"`{lang_col}`").isNotNull()) \
        .select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = string_list(batch["text"])
        code = batch["lang"].dictionary_encode()
        lang = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[tuple] = []
        for start, end in chunks(texts, 4 << 20):
            points, a, b, first = cut_words(texts[start:end])
            h = run_hashes(points, a, b) + mix(np.repeat(lang[start:end], np.diff(first)).astype(np.uint64))
            _, at, n = np.unique(h, return_index=True, return_counts=True)
            owner = np.searchsorted(first, at, side="right") - 1
            words = points[spread(a[at], b[at] - a[at])].astype("<u4").tobytes().decode("utf-32-le")
            ends = np.cumsum(b[at] - a[at]).tolist()
            out.append((lang[start:end][owner], [words[x:y] for x, y in zip([0, *ends], ends)], n))
        return {"lang": pa.DictionaryArray.from_arrays(pa.array(np.concatenate([o[0] for o in out])), code.dictionary).dictionary_decode(),
                "word": pa.array([w for o in out for w in o[1]], pa.string()), "n": pa.array(np.concatenate([o[2] for o in out]))}

    return rows.mapInArrow(per_batch(work, ["lang", "word", "n"]), "lang string, word string, n bigint") \
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, usable: Column, rounds: int = 2, smoothing: float = 0.5, path: str | None = None,
        lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts are written once to the shared folder; each round reads them and brings home one number
    per piece and language."""
    spark = docs.sparkSession
    target = work_dir(spark, "word-counts")
    count_words(docs, usable, lang_col, text_col).write.parquet(target)
    counts = spark.read.schema("lang string, word string, n bigint").parquet(target)
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 0)), path)
    n_pieces = pieces(path).count
    probability = np.full((n_pieces, len(languages)), 1 / n_pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((languages, probability))

        def work(batches):
            names, table = shared.value
            number, known = {x: i for i, x in enumerate(names)}, pieces(path)
            total = np.zeros_like(table)
            for batch in batches:
                words, times = batch["word"].to_pylist(), batch["n"].to_numpy().astype(float)
                language = np.array([number[x] for x in batch["lang"].to_pylist()], dtype=np.int64)
                for i in range(0, len(words), 5000):
                    some = words[i:i + 5000]
                    points = np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4")
                    ends = np.cumsum([len(w) for w in some])
                    arcs = lattice(points, np.concatenate([[0], ends[:-1]]), ends, known)
                    total += expected_counts(arcs, language[i:i + 5000], times[i:i + 5000], table)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()),
                                              "n": pa.array(total[piece, lang])})

        found = counts.mapInArrow(work, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        probability = np.full((n_pieces, len(languages)), smoothing)
        probability[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
        probability /= probability.sum(axis=0)
    return Model(languages, probability, path)


class Scorer:
    def __init__(self, model: Model, memory: int = 3_000_000):
        self.model, self.known = model, pieces(model.path)
        self.table = RunTable(max(50_000, memory // len(model.languages)))
        self.value = Growing(np.float64, (len(model.languages),))

    def _learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if self.table.index.count == 0:
            self.value = Growing(np.float64, (len(self.model.languages),))
        for i in range(0, len(starts), 5000):
            arcs = lattice(points, starts[i:i + 5000], ends[i:i + 5000], self.known)
            alpha = forward(arcs, self.model.probability[arcs.piece])
            self.value.extend(np.log(np.maximum(alpha[np.arange(len(arcs.lengths)), arcs.lengths], 1e-300)))

    def scores(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, best = [], []
        letter = _letters()[0]
        for start, end in chunks(texts):
            points, a, b, first = cut_words(texts[start:end])
            number = self.table.numbers(run_hashes(points, a, b), lambda at: self._learn(points, a[at], b[at]))
            total = np.zeros((len(number) + 1, len(self.model.languages)))
            np.cumsum(self.value.data[number], axis=0, out=total[1:])
            z = total[first[1:]] - total[first[:-1]]
            z -= z.max(axis=1, keepdims=True)
            has_letter = np.concatenate([[0], np.cumsum(letter[points])])
            bounds = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
            lettered = has_letter[bounds[1:]] > has_letter[bounds[:-1]]
            best.append(np.where(lettered, 1 / np.exp(z).sum(axis=1), 0.0))
            names += [self.model.languages[k] if ok else "und" for k, ok in zip(z.argmax(axis=1).tolist(), lettered.tolist())]
        return names, np.concatenate(best)


_SCORERS: dict[str, Scorer] = {}  # of a worker, by scoring run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of the best language in the sum over languages)."""
    rows = texts_of(docs, id_col, text_col)
    if not model.languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages numbers

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        names, best = _SCORERS[key].scores(string_list(batch["text"]))
        return {"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(best)}

    return rows.mapInArrow(per_batch(work, ["doc_id", "lang_pred", "score"]), schema_with(rows, "lang_pred string, score double"))
