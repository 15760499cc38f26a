"""Word cutting, hashing, tokens, packed files, packing: against plain Python and the library itself."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pairlog.llm import best_fit, token_files, words
from pairlog.llm.tokens import checksum, encoder

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a  b\n\n c \n x\t\n", "  lead", "trail  ", "a\x1cb c", "x<|endoftext|> y", "\n\n", "don't we'll 'tis !'s 9's é's",
       "é ́x ok", "ΑΣ ΣΑ", "a\0b c", "日本語 テスト 123 ½ ²", "İ! x", "—, “q”…", "a.\nB's", "word " * 400, "x" * 9000]


def library(name, texts):
    from tokenizers import Tokenizer
    return [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", None)])
def test_encoder_equals_library(name, spaces):
    assert [x.tolist() for x in encoder(None, name, spaces).encode(ODD)] == library(name, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'É é\t\n 1.,!\xa0́日ſ"), max_size=30), max_size=6))
def test_encoder_on_random_texts(texts):
    for name, spaces in (("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")):
        assert [x.tolist() for x in encoder(None, name, spaces).encode(texts)] == (library(name, texts) if texts else [])


def test_encoder_memory_starts_afresh():
    from pairlog.llm.tokens import Encoder
    small = Encoder(P.path("byte_bpe_50k.json"), "kept", limit=20)
    texts = [f"alpha{i} beta{i} gamma{i % 7}" for i in range(200)]
    for i in range(0, 200, 10):
        assert [x.tolist() for x in small.encode(texts[i:i + 10])] == library("byte_bpe_50k.json", texts[i:i + 10])
    assert small.table.index.count < 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9é ,_\n", max_size=25), max_size=8))
def test_words(texts):
    data, bounds = words.join_bytes([t.encode() for t in texts])
    a, b = words.runs(words.WORD_BYTES[data])
    got = [data[x:y].tobytes() for x, y in zip(a, b)]
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    assert got == [w.encode() for t in want for w in t]
    assert np.diff(np.searchsorted(a, bounds)).tolist() == [len(w) for w in want]
    h = words.run_hashes(data, a, b)
    assert len(set(zip(h.tolist(), got))) == len(set(got)) == len(set(h.tolist()))


def test_hash_index():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    index = words.HashIndex(16)
    for part in np.array_split(keys, 7):
        index.add(part)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1)) >= 0).sum() == np.isin(keys + np.uint64(1), keys).sum()


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    documents = [rng.integers(0, 1 << min(bits, 31), n).astype(np.uint32) for n in (0, 1, 5, 4096, 9001)]
    data = token_files.pack([3, None, 5, 6, 7], documents, bits, block=1000)
    shard = token_files.PackedShard(data)
    assert shard.doc_ids == [3, None, 5, 6, 7]
    for i, d in enumerate(documents):
        assert (shard.document(i) == d).all()
    whole = np.concatenate(documents)
    for a, b in ((0, 0), (0, 1), (999, 1001), (4000, 9003), (len(whole) - 1, len(whole))):
        assert (shard.ids(a, b) == whole[a:b]).all()


def rows_for(spark):
    texts = [(3, "b a"), (1, None), (2, ""), (2, ""), (None, "lost"), (9, "long words " * 3000), (4, "same"), (5, "same")]
    return spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id bigint, text string, start string, ids int")


def test_token_files(spark):
    target = token_files.write_shards(rows_for(spark), shard_ids=50)
    got = token_files.read_documents(spark, target, with_ids=True).collect()
    by_start = sorted(got, key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in by_start] == [None, 1, 2, 2, 3, 4, 5, 9]
    texts = {None: "lost", 1: "", 2: "", 3: "b a", 4: "same", 5: "same", 9: "long words " * 3000}
    at = 0
    for r in by_start:
        ids = library("byte_bpe_50k.json", [texts[r.doc_id]])[0] + [0]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = token_files.write_shards(rows_for(spark).limit(0))
    assert token_files.read_documents(spark, empty).count() == 0


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_best_fit(spark):
    got = best_fit.pack(rows_for(spark), 64, keep_ids=True)
    rows = got.collect()
    check_packing(rows, 64)
    assert sorted(r.doc_id or 0 for r in rows if r.piece == 0) == [0, 1, 2, 2, 3, 4, 5, 9]
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == checksum(np.array(r.ids)) and r.start == 64 * r.piece
    assert {s.sequence_id: len(s.ids) for s in best_fit.sequences(got).collect()} == {
        k: sum(r.length for r in rows if r.sequence_id == k) for k in {r.sequence_id for r in rows}}
    assert best_fit.pack(rows_for(spark).limit(0), 64).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan_is_best_fit_decreasing(histogram):
    slots = best_fit.plan(histogram, 40)
    placed = defaultdict(list)
    for s in slots:
        for rank in range(s.first, s.past):
            k = rank - s.first
            placed[s.sequence + k // s.each].append((s.offset + k % s.each * s.length, s.length))
    for length, n in histogram.items():
        assert sorted(r for s in slots if s.length == length for r in range(s.first, s.past)) == list(range(n))
    room = []  # best fit, piece by piece
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= length
        else:
            room.append(40 - length)
    assert len(placed) == len(room)
    for pieces in placed.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(n for _, n in pieces) <= 40


def test_hot_length_is_spread(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * (3 if rng.random() < 0.5 else rng.randrange(60))) for i in range(3000)], "doc_id bigint, text string")
    assert check_packing(best_fit.pack(docs.repartition(7), 64).collect(), 64) > 0
