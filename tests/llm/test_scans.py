"""Licences, decontamination, language, quality, toxicity, line spread, neighbours, Jaccard join: brute force or accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlog.llm import ann, decontaminate, jaccard_join, language, licenses, line_spread, quality, toxicity
from pairlog.llm.components import components
from pairlog.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def documents(spark, texts, ids=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, f"s{k % 7}" if k % 11 else None, "en" if k % 2 else "de", 1) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, score int").repartition(parts)


# -- licences ---------------------------------------------------------------------------
def test_licence_rules(spark):
    assert len(licenses.rules()) > 300
    texts = ["Released under the MIT License.", "x Apache License, Version 2.0! CC BY-NC 4.0", None, "", "nothing here", "the mit group",
             "SPDX-License-Identifier: BSD-3-Clause", "GNU General Public License, version 3", "a " * 5000 + "Under the MIT license", "released under the BSD 2-Clause",
             "cc-by\nnc", "under the mit license " * 3]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        w = WORD.findall(lower(text))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "bsd-3" and got[7].labels == "gpl-3" and got[4].labels == "" and got[9].labels == "bsd-2"
    assert licenses.digest(licenses.scan(documents(spark, ["a"]).limit(0))).count() == 0


def test_containment():
    d = lambda a, b, p, r: licenses.Detection(a, b, "x", p, 1.0, r, False)
    kept = licenses.suppress([d(0, 5, 50, 1), d(1, 3, 50, 0), d(0, 5, 50, 2), d(4, 8, 40, 3), d(2, 3, 90, 4)])
    assert {k.rule for k in kept} == {1, 3, 4}


# -- decontamination --------------------------------------------------------------------
def test_fm_index():
    rng = np.random.default_rng(5)
    for trial in range(40):
        k, n = int(rng.integers(1, 6)), int(rng.integers(1, 100))
        s = rng.integers(1, k + 1, n)
        s[rng.random(n) < 0.15] = 0
        s = np.concatenate([np.append(s, 0)] * (1 + 2 * (trial % 2)))
        close = np.cumsum(s == 0)
        key = lambda i: [(0, int(close[j])) if s[j] == 0 else (1, int(s[j])) for j in range(i, len(s))]
        assert suffix_order(s).tolist() == sorted(range(len(s)), key=key)
        index = FMIndex(s, k, sample=4)
        for length in (1, 2, 5):
            patterns = rng.integers(1, k + 1, (15, length))
            for p, a, b in zip(patterns, *index.ranges(patterns)):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [
                    i for i in range(len(s) - length + 1) if s[i:i + length].tolist() == p.tolist()]


def brute_hits(text, items, size=13):
    w = WORD.findall(lower(text))
    hit, found = [False] * len(w), set()
    for item, body in items:
        v = WORD.findall(lower(body))
        n = min(size, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[k:k + n]:
                    hit[i:i + n] = [True] * n
                    found.add(item)
    return len(w), sum(hit), found, hit


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontaminate(spark, monkeypatch, block_bytes):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["ab", "cd", "e9", "Fé", "g", "h-i"]) for _ in range(n))
    items = [(0, some(20)), (1, "short one"), (2, None), (3, ""), (10, some(13)), (10, some(14)), (None, some(15)), (5, "?!")]
    texts = [None, "", "short, ONE!", *[some(rng.randrange(60)) for _ in range(25)]]
    for i in range(25):
        body = rng.choice([b for _, b in items if b])
        texts.append(some(rng.randrange(30)) + " " + body.upper().replace("É", "é") + " " + some(rng.randrange(30)))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 300)
    blocks = decontaminate.benchmark_blocks
    monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda *a: blocks(*a, block_bytes=block_bytes))
    scanned = decontaminate.scan(docs, bench, cleaned=True)
    got = {r.doc_id: r for r in scanned.collect()}
    digest = {r.doc_id: r for r in decontaminate.digest(scanned).collect()}
    for i, text in enumerate(texts):
        n, hits, found, mask = brute_hits(text, items)
        r = got[i]
        names = sorted(str(x) for x in found if x is not None)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hits, names)
        assert [j for s in r.spans for j in range(s.first, s.past)] == [j for j, m in enumerate(mask) if m]
        assert digest[i].contaminated == (hits > 0 and 20 * hits >= n) and digest[i].n_items == len(names)
        assert WORD.findall(lower(r.clean_text)) == [w for w, m in zip(WORD.findall(lower(text)), mask) if not m] or not hits
    none = decontaminate.digest(decontaminate.scan(docs, bench.limit(0)))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == len(texts)


# -- classifiers ------------------------------------------------------------------------
def test_language_sums_all_segmentations(spark):
    known = language.pieces(None)
    rng = np.random.default_rng(2)
    probability = rng.random((known.count, 2))
    points, starts, ends, _ = language.cut_words(["Das ist über alles", "x", ""])
    arcs = language.lattice(points, starts, ends, known)
    alpha = language.forward(arcs, probability[arcs.piece])
    for w in range(len(starts)):
        edges = [(s, e, p) for x, s, e, p in zip(arcs.word, arcs.start, arcs.end, arcs.piece) if x == w]

        def total(at, k):
            return 1.0 if at == arcs.lengths[w] else sum(probability[p, k] * total(e, k) for s, e, p in edges if s == at)
        for k in (0, 1):
            assert np.isclose(alpha[w, arcs.lengths[w], k], total(0, k))
    # expected uses of each piece, against all ways to cut a short word
    points, starts, ends, _ = language.cut_words(["the"])
    arcs = language.lattice(points, starts, ends, known)
    edges = list(zip(arcs.start.tolist(), arcs.end.tolist(), arcs.piece.tolist()))

    def cuts(at):
        return [[]] if at == arcs.lengths[0] else [[p, *rest] for s, e, p in edges if s == at for rest in cuts(e)]
    ways = [(np.prod([probability[p, 1] for p in way]), way) for way in cuts(0)]
    want = np.zeros_like(probability)
    for weight, way in ways:
        for p in way:
            want[p, 1] += 2 * weight / sum(w for w, _ in ways)
    assert len(ways) > 3 and np.allclose(language.expected_counts(arcs, np.array([1]), np.array([2.0]), probability), want)


def test_language(spark):
    rng = random.Random(1)
    de, en = "der die und nicht schule straße über".split(), "the and not school street over with".split()
    texts = [" ".join(rng.choice(en if k % 2 else de) for _ in range(12)) for k in range(120)] + [None, "", "123 !?", "x" * 200]
    docs = documents(spark, texts)
    model = language.fit(docs, usable=F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and got[i].score > 0.9 for i in range(120))
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3 and got[123].lang_pred in ("en", "de")
    nothing = language.identify(docs, language.fit(docs, usable=F.lit(False)))
    assert nothing.where("lang_pred <> 'und' OR score <> 0").count() == 0 and nothing.count() == len(texts)


def labelled(spark, n=240):
    rng = random.Random(3)
    base = [f"w{i}ord" for i in range(80)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(base) for _ in range(rng.randrange(20, 60))]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(len(words))] = "stupid" + rng.choice("abcdefg")
            words = [w + "!!" for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(not bad), int(bad)))
    labels += [(None, 1, 1), (5, None, None), (10_000, 1, 0)]
    return documents(spark, [*texts, None, ""]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), n


def test_quality_and_toxicity(spark):
    docs, labels, n = labelled(spark)
    fold = F.col("doc_id") % 4 != 2
    good = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, usable=fold)).collect()}
    toxic = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, usable=fold)).collect()}
    held = [i for i in range(n) if i % 4 == 2]
    assert np.mean([(good[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert np.mean([(toxic[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95
    assert good[n] == good[n + 1] == 0 and toxic[n] == toxic[n + 1] < 0.3
    assert all(0 <= x <= 1 for x in [*good.values(), *toxic.values()])
    for module in (quality, toxicity):
        none = module.score(docs, module.fit(docs, labels.limit(0), label="quality")).collect()
        assert len(none) == n + 2
        one_kind = module.fit(docs, labels.where("quality = 1"), label="quality")
        assert {r.score for r in module.score(docs, one_kind).collect()} <= {0.0, 1.0}


# -- lines ------------------------------------------------------------------------------
def test_line_spread(spark):
    rng = random.Random(6)
    common = [f"a common line number {i}" for i in range(12)]
    texts = ["\n".join(rng.choice(common + [f"own line of {k} {j}" for j in range(12)] + ["short", ""]) for _ in range(rng.randrange(8))) for k in range(60)]
    texts += [None, "", common[0], common[0], "\n"]
    docs = documents(spark, texts)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_spread.remove_boilerplate(docs, min_sites=4).collect()}
    site = {r.doc_id: r.source for r in docs.collect()}
    where = {}
    for i, t in enumerate(texts):
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if len(line) >= line_spread.MIN_CHARS:
                where.setdefault(line, []).append((i, p, site[i]))
    gone = {(i, p) for v in where.values() if len({s for _, _, s in v}) >= 4 for i, p, _ in sorted(v, key=lambda x: x[:2])[1:]}
    assert gone
    for i, t in enumerate(texts):
        want = t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i] == (want, sum(1 for d, _ in gone if d == i))
    odd = docs.withColumns({"row": F.lit(1), "drop": F.lit("x"), "lines": F.lit(2.0), "n_removed": F.lit("old"), "h": F.lit(None)})
    again = line_spread.remove_boilerplate(odd, min_sites=4)
    assert {r.doc_id: (r.text, r.n_removed) for r in again.collect()} == got and again.where("row = 1 AND drop = 'x' AND lines = 2").count() == len(texts)
    assert line_spread.remove_boilerplate(docs.limit(0)).count() == 0


# -- neighbours -------------------------------------------------------------------------
def test_neighbours(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] * 16, ""), (5060, [1.0] * 5, ""), (None, [1.0] * 16, ""), (0, vectors[0].tolist(), "again")]
    rows.append((5080, [None] + [1.0] * 15, ""))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string").repartition(4)
    got = {}
    for r in ann.search(table, F.col("id") % 20 == 0, 20, block=500).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    x, hits = vectors.astype(float), 0
    for q, found in got.items():
        score = (x * x[q]).sum(axis=1)
        order = np.lexsort((np.arange(3000), -score))
        best = [int(i) for i in order if i != q][:20]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 20 and np.allclose([s for _, s in found], score[[i for i, _ in found]])
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(got)) >= 0.9
    assert [i for i, _ in got[100]][:20] == [*range(101, 121)] or x[100] @ x[100] < max(x[100] @ v for v in x)
    few = ann.search(table.where("vec_id < 5"), F.col("id") % 20 == 0, 20)
    assert few.count() == 4 and ann.search(table.limit(0), F.col("id") % 20 == 0).count() == 0


# -- near copies ------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in {v for e in edges if e[0] != e[1] for v in e}}


def test_jaccard_groups(spark):
    rng = random.Random(10)
    vocabulary = [f"t{i}" for i in range(400)]
    texts = []
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(6, 160))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + (" " + passage if g % 3 == 0 else ""))
    texts += [None, "", "  \n", "one two", "ONE  two", "one", texts[0], texts[0].upper()]
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_groups(docs).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard_join.join_groups(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "z")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.join_groups(twice).collect()) == [(0, 0), (0, 7), (7, 7), (7, 7)]


def spelled(pattern: bytes, most: bool) -> set[bytes]:
    """What a rule matches: every alternative, with all optional parts or with none."""
    from re import _constants as c, _parser

    def product(parts):
        out = {b""}
        for part in parts:
            out = {a + b for a in out for b in part}
        return out

    def ways(node):
        op, arg = node
        if op is c.LITERAL:
            return {bytes([arg])}
        if op is c.ANY:
            return {b"x"}
        if op is c.IN:
            return {bytes([a]) if o is c.LITERAL else bytes([a[0]]) for o, a in arg}
        if op is c.BRANCH:
            return set().union(*(product(map(ways, branch)) for branch in arg[1]))
        if op is c.SUBPATTERN:
            return product(map(ways, arg[3]))
        low, high, inner = arg
        return product([product(map(ways, inner))] * (min(high, 1) if most and not low else low))

    return product(map(ways, _parser.parse(pattern)))


def test_gates_pass_whatever_a_rule_matches():
    for i, rule in enumerate(licenses.rules()):
        for most in (False, True):
            for text in spelled(rule.pattern, most):
                assert licenses._compiled(i).search(b" " + text + b" ")
                assert licenses.gated(text) and rule.keyword in b" " + text + b" ", (rule, text)
    for text, label in ((b"built with apache 2.0", "apache-2"), (b"the expat license", "mit"), (b"you may redistribute it and/or modify it.", "gpl")):
        assert label in {d.label for d in licenses.scan_text(text)}


# -- samples ----------------------------------------------------------------------------
@pytest.mark.parametrize("length", [30_000, 19_000])
def test_a_long_text_does_not_empty_the_sample(spark, length):
    """One text longer than all bytes of its label, or nearly so long, comes up first; the others are drawn all the same."""
    from pairlog.llm import labelled as module

    docs, labels, n = labelled(spark)
    ids = [r[0] for r in labels.where("quality = 1 AND doc_id < 240").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    long = ("Ünlike word " * 4000).encode()[:length - 1].decode("utf-8", "ignore")
    long += "x" * (length - len(long.encode()))
    texts = docs.withColumn("text", F.when(F.col("doc_id") == ids[0], long).otherwise(F.col("text")))
    sample = module.labelled_sample(texts, labels, "quality", F.lit(True), 3000, 20_000)
    lengths = [len(t) for t, y in zip(sample.texts, sample.labels) if y]
    assert max(lengths) <= 20_000 // module.SHARE and sum(lengths) <= 20_000
    assert len(lengths) > 50 and lengths[0] > 1000 and sample.texts[sample.labels.index(1)].count(b"\n") == module.PIECES - 1
    kept = module.labelled_sample(docs, labels, "quality", F.lit(True), 3000, 100_000)
    assert {t.decode() for t in kept.texts} == {r.text for r in docs.where(f"doc_id < {n}").collect()}
    for fit, score, label, size in ((quality.fit, quality.score, "quality", 20_000), (toxicity.fit, toxicity.score, "toxic", 20_000)):
        assert fit(texts, labels, label, size=size).constant is None
