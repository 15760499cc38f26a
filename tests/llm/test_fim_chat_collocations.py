"""Fill-in-the-middle, chat formatting and collocations against plain Python, and the words that a linear hash confuses."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairlog.llm import chat, collocations, decontaminate, fim, jaccard_join, queries, words
from pairlog.llm.tokens import encoder

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def docs(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame(rows, schema)


# -- words with one hash under any polynomial modulo 2^64 ------------------------------------------------
def thue_morse(n):
    text, other = "a", "b"
    while len(text) < n:
        text, other = text + other, other + text
    return text, other


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_a_polynomial_confuses(n):
    pair = thue_morse(n)
    data, bounds = words.join_bytes([t.encode() for t in pair])
    h = words.run_hashes(data, bounds[:-1], bounds[1:] - 1)
    assert h[0] != h[1]
    library = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    for name, spaces in (("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")):
        want = [e.ids for e in Tokenizer.from_file(library.path(name)).encode_batch(list(pair), add_special_tokens=False)]
        assert [x.tolist() for x in encoder(None, name, spaces).encode(list(pair))] == want
    a, b = jaccard_join.shingle_sets([f"one two three {t}".encode() for t in pair])
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_decontamination_tells_those_words_apart(spark):
    first, second = thue_morse(2048)
    line = " ".join(f"w{i}" for i in range(12))
    d = docs(spark, [(0, f"{line} {first}", None, None, 0), (1, f"{line} {second}", None, None, 0)])
    item = spark.createDataFrame([(7, f"{line} {first}")], "item_id bigint, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.digest(decontaminate.scan(d, item)).collect()}
    assert got == {0: 13, 1: 0}


# -- fill in the middle ----------------------------------------------------------------------------------
def fim_by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "a", "é", "one two", "x<P>y", "<S", "<M", "a<S><", "\n\n", "日本語 テスト", "a\0b", "𝒳𝒴 z", "ab" * 5000, "- " * 3000, "<p>", "P>S>M>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé日𝒳 <\n", max_size=40), max_size=6), st.integers(1, 12), st.integers(0, 1 << 32), st.integers(0, 1 << 32))
def test_cut(texts, limit, x, y):
    held, fim.LIMIT = fim.LIMIT, limit
    try:
        n, parts = fim.cut([t.encode() for t in texts], np.full(len(texts), x), np.full(len(texts), y))
    finally:
        fim.LIMIT = held
    for i, t in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        lo, hi = sorted((x % (len(units) + 1), y % (len(units) + 1)))
        assert n[i] == len(units)
        assert [p[i].as_py().decode() for p in parts] == ["".join(u) for u in (units[:lo], units[lo:hi], units[hi:])]


def test_fim(spark):
    rng = random.Random(5)
    rows = [(i, ODD[i % len(ODD)] if i < 120 else "".join(rng.choice("ab cé<>PSM\n") for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "no id here"), (7, "twice"), (7, "twice"), (9000, "long text, " * 300_000), (9001, "…" * 1_500_000)]
    d = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "doc_id bigint, text string, n int, form string, output string")
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256)
                  for r in fim.digest(fim.rearrange(d)).collect())
    want = Counter()
    for doc_id, text in rows:
        n, form, p, m, out = fim_by_hand(doc_id, text)
        want[doc_id, n, form, p, m, sha(out), sha(text or "")] += 1
    assert got == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert fim.rearrange(d.where("doc_id < -1")).count() == 0


def test_fim_bytes_that_are_no_text(spark):
    d = spark.sql("SELECT 3L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    r = fim.rearrange(d).first()
    assert r.n == 3 and "�" in r.output


# -- chat ------------------------------------------------------------------------------------------------
RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 4},
    "messages with system": {"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
    "speakers": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}, {"from": "Odd", "value": "c"}]},
    "instruction": {"instruction": "i", "input": "x", "output": "o", "meta": {"k: <": [1, {"z": 2}]}},
    "instruction without input": {"output": "o", "instruction": "i"},
    "instruction with null input": {"instruction": "i", "input": None, "output": "o"},
    "completion": {"prompt": "p", "completion": "c"},
    "lists": {"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]},
    "question": {"question": "q", "answer": "a", "context": "c"},
    "row": {"turn": 3, "role": "user", "text": "t"},
    "unknown": {"body": "x"},
    "two at once": {"prompt": "p", "completion": "c", "question": "q", "answer": "a"},
    "no object": [1, 2],
}
TURNS = {
    "messages": [("user", "a"), ("assistant", "b")], "messages with system": [("system", "s"), ("user", "a\nb")],
    "speakers": [("user", "a"), ("assistant", ""), ("Odd", "c")], "instruction": [("user", "i\n\nx"), ("assistant", "o")],
    "instruction without input": [("user", "i"), ("assistant", "o")], "instruction with null input": [("user", "i"), ("assistant", "o")],
    "completion": [("user", "p"), ("assistant", "c")], "lists": [("user", "p"), ("assistant", "c")],
    "question": [("user", "c\n\nq"), ("assistant", "a")], "row": [("user", "t")], "unknown": None, "two at once": None, "no object": None,
}


def test_layouts(spark):
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in RECORDS.items()] + [("null", None)], "id string, j string") \
        .select("id", F.parse_json("j").alias("record"))
    got = {r.id: r for r in chat.convert(rows).collect()}
    for k, want in TURNS.items():
        assert (got[k].turns and [(t.role, t.text) for t in got[k].turns]) == want, k
        assert (got[k].layout is None) == (want is None)
    assert got["row"].turns[0].turn == 3 and got["null"].turns is None
    own = chat.Layout("bodies", ("body",), (chat.Field("user", ("body",)),))
    again = {r.id: r for r in chat.convert(rows, (*chat.LAYOUTS, own)).collect()}
    assert [(t.role, t.text) for t in again["unknown"].turns] == [("user", "x")]
    with pytest.raises(ValueError):
        chat.fingerprints((*chat.LAYOUTS, own, own._replace(name="other")))


def test_field_paths(spark):
    d = spark.createDataFrame([('{"a": {"b c": [[{"d": 1}]]}, "e": [], "f`": null}',)], "j string")
    assert d.select(chat.field_paths(F.parse_json("j")).alias("p")).first().p == ["`f```", "a", "a.`b c`", "a.`b c`[][].d", "e"]


def test_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "</turn", "<turn", ">", "\n", "x", "</turn>\n", "\n</turn>\n", "é", "<turn user>\n", "\\\\", " "]
    rows = [(rng.randrange(60), rng.choice([0, 1, 2, 2, None]), rng.choice(["user", "assistant", "a>b\n%", None, ""]),
             rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))])) for _ in range(400)]
    rows += [(None, 0, "user", "no id"), (77, 0, "assistant", "\\" * 200_000 + "</turn>"), (78, 0, "assistant", "<turn " * 100_000)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, record string, id int")
    formed = chat.form(chat.convert(chat.records(d, "conv_id", ["turn", "role", "text"])))
    got = {r.id: r for r in chat.read(formed).collect()}
    masks = {r.id: r for r in formed.collect()}
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in turns]
        assert [t.loss for t in got[conv].turns] == [t[3] if t[2] == "assistant" else None for t in turns]
        assert sum(m.before + m.loss + m.after for m in masks[conv].loss_mask) == len(masks[conv].formatted)
    digests = {r.conv_id: r for r in chat.digest(chat.read(formed)).collect()}
    for conv, turns in want.items():
        assert digests[conv].turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns))
        assert digests[conv].loss_sha256 == sha("".join(t[3] for t in turns if t[2] == "assistant"))
    assert chat.form(chat.convert(chat.records(d.limit(0), "conv_id", ["turn", "role", "text"]))).count() == 0


def test_chat_is_native(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string").write.parquet(path)
    d = queries.queries()["op12_chat_format"](spark, str(tmp_path))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
    assert sorted(r.conv_id for r in d.collect()) == [-7, 1]
    assert d.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


# -- collocations ----------------------------------------------------------------------------------------
def collocations_by_hand(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = Counter()
        for q, b in frequent.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i:i + k]] = max(inside[q[i:i + k]], b)
        for p, a in frequent.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:j]] + counts[p[j:]]), j, counts[p[:j]], counts[p[j:]]) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(11)
    vocabulary = ["the", "The", "a", "of", "new", "york", "é", "日本", "x1", "#", "und", "en"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", "en"), (" \t ", None), ("", ""), ("a b c d", ""), ("a b c d a b", "")] + [("we the people of the state", "en")] * 40
    rows += [("in the long run it is all the same; " * 20_000, "long"), ("on and on " * 70_000, "long")]
    return rows


@pytest.mark.parametrize("least,top,bits", [(5, 2000, 24), (30, 7, 24), (5, 2000, 6), (1, 50, 17)])
def test_collocations(spark, least, top, bits):
    rows = corpus()
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, phrase string, n int, words int").repartition(6)
    got = sorted(tuple(r) for r in collocations.mine(d, least, top, bits).collect())
    want = collocations_by_hand(rows, least, top)
    assert got == want and len(want) > 10


def test_flow_is_the_count_of_every_phrase(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "text string, lang string")
    e = collocations.edges(d, 5)
    assert e.agg(F.sum("n")).first()[0] == sum(
        len(re.findall("[^\x20\x09]+", p)) for t, _ in rows for p in re.split("[.,;:!?\x0a-\x0d]", t or ""))
    unary = {(r.lang, r.phrase): r.f for r in collocations.flows(e).where("unary AND f >= 5").collect()}
    assert unary
    every = {(r.lang, r.phrase): r.f for r in collocations.flows(e).where("f >= 5").collect()}
    for (lang, phrase), f in unary.items():
        assert any(k[0] == lang and k[1].startswith(phrase + " ") and v == f for k, v in every.items())


def test_records_are_of_frequent_phrases_only(spark):
    rows = corpus()
    f, rare = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            f.update((lang or ("und" if lang is None else ""), " ".join(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    for (lang, phrase), n in f.items():
        if " " not in phrase and n < 30:
            rare[lang] += n
    got = collocations.edges(spark.createDataFrame(rows, "text string, lang string"), 30).collect()
    assert rare and {r.lang: r.n for r in got if not r.words} == dict(rare)
    assert all(f[r.lang, r.phrase] >= 30 for r in got if r.words)


def test_collocations_of_nothing(spark):
    d = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(d).collect() == []
    with pytest.raises(ValueError):
        collocations.mine(d, least=300)


def test_packed_blocks():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.01, 0.2, 0.9):
        block = (rng.random(1 << 12) < share).astype(np.uint8) * 7
        at, more = collocations._unpacked(collocations._packed(block), len(block))
        out = np.zeros(len(block), dtype=np.uint8)
        out[at] = more
        assert (out == block).all()


def test_phrases_of_a_chunk():
    chunk = collocations.Chunk([b"A  b\tc. d", b"", b"e f"], ["x", "y", ""])
    assert chunk.phrases(np.array([0, 3, 4]), np.array([3, 1, 2])).to_pylist() == [b"a b c", b"d", b"e f"]
    assert chunk.room.tolist() == [3, 2, 1, 1, 2, 1] and chunk.text.tolist() == [0, 0, 0, 0, 2, 2]
    assert isinstance(chunk.phrases(np.array([], dtype=int), np.array([], dtype=int)), pa.Array)
