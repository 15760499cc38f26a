"""The stages on the smallest table, each against what its operator says about its own input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pairlog.llm import best_fit, decontaminate, jaccard_join, line_spread, quality  # noqa: E402
from pairlog.llm.common import hash_remainder  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and entry.queries()["pipeline"] is corpus_pipeline.run

    good = stages["quality_classifier"](spark, docs, SF).cache()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), usable=hash_remainder("doc_id", 4) != 2)
    assert ids(good) == ids(quality.score(docs, model).where("score >= 0.7"))
    assert good.columns == docs.columns and good.exceptAll(docs).isEmpty()

    lines = stages["line_dedup"](spark, good, SF).cache()
    cleaned = {r.doc_id: r for r in line_spread.remove_boilerplate(good).collect()}
    for r in lines.collect():
        c = cleaned.pop(r.doc_id)
        assert r.text == c.text and r.n_chars == (len(r.text) if c.n_removed else c.n_chars)
    assert all(c.n_removed and not c.text.strip() for c in cleaned.values()) and lines.columns == docs.columns

    single = stages["ngram_jaccard_join"](spark, lines, SF).cache()
    groups = jaccard_join.join_groups(lines)
    assert ids(single) == sorted({r.component_id for r in groups.where("n_shingles > 0").collect()} | {r.doc_id for r in groups.where("n_shingles = 0").collect()})

    clean = stages["benchmark_decontamination"](spark, single, SF).cache()
    seen = decontaminate.digest(decontaminate.scan(single, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids(clean) == ids(seen.where("NOT contaminated")) and clean.columns == docs.columns and clean.exceptAll(single).isEmpty()

    packed = stages["best_fit_packing"](spark, clean, SF)
    assert ids(packed.where("piece = 0")) == ids(clean)
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert full.where("n > 2048 OR n <> m").isEmpty()
    assert best_fit.pack(clean).count() == packed.count()


def test_repeated_rows_and_odd_columns(spark):
    rows = [(1, "a b c d e f", "en", "s", 1, 9), (1, "a b c d e f", "en", "s", 1, 9), (2, "a b c d e f", "en", "s", 1, 9),
            (None, "a b c d e f", "en", "s", 1, 9), (3, None, None, None, None, None), (4, "", "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    stages = dict(corpus_pipeline.STAGES)
    assert ids_or_zero(stages["ngram_jaccard_join"](spark, docs, SF)) == [0, 1, 3, 4]
    assert ids_or_zero(stages["benchmark_decontamination"](spark, docs, SF)) == [0, 1, 1, 2, 3, 4]
    assert ids_or_zero(stages["line_dedup"](spark, docs, SF)) == [0, 1, 1, 2, 3, 4]


def ids_or_zero(df):
    return sorted(r[0] or 0 for r in df.select("doc_id").collect())


def test_near_copies_are_five_words_at_four_fifths(spark):
    """Against brute force; scattered single-word edits that link over five words at 0.80 but not over four at 0.85."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    texts = []
    for g in range(6):
        own = [f"g{g}" + w for w in base]
        texts.append(" ".join(own))
        for edits in (4, 6, 7, 8, 10):
            copy = list(own)
            for k in range(edits):
                copy[20 + 30 * k] = f"edit{g}x{edits}x{k}"
            texts.append(" ".join(copy))
        texts.append(" ".join([*own[:130], *[f"other{g}x{k}" for k in range(25)], *own[155:]]))  # one changed block
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    default = {r.component_id for r in jaccard_join.join_groups(docs).collect()}
    assert set(want) < default
    assert ids(dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF)) == want


def test_an_id_with_several_texts_keeps_them(spark):
    """Rows go only where their own text is a copy, not because another text has their id."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(1, a), (1, b), (1, b), (1, None), (2, a), (2, c), (3, c), (3, c)]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(1, a), (1, b), (1, ""), (2, c)])
    assert [r.source for r in got if r.text == b] == ["s1"]
