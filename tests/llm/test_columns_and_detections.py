"""Extra columns whose names the operators use themselves, and overlapping licence detections."""

import random
import time

import corpus_pipeline
from pairlog.llm import licenses, line_spread
from pairlog.llm.common import fold, fresh, unfold

CLASH = ["_", "_row", "_ROW_", "_id", "_h", "drop", "lines", "row"]


def docs(spark, texts):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", f"s{i % 7}", len(t or ""), *range(i, i + len(CLASH))) for i, t in enumerate(texts)], schema)


def test_names():
    assert fresh("_row", ["a"]) == "_row" and fresh("_row", ["_ROW", "_row_"]) == "_row__"


def test_folded_rows(spark):
    d = docs(spark, ["a", None, "c"])
    back = unfold(fold(d), d.columns)
    assert back.columns == d.columns and sorted(back.collect(), key=lambda r: r.doc_id) == d.orderBy("doc_id").collect()


def test_line_dedup(spark):
    d = docs(spark, [f"a line of many sites\nown words {i}" for i in range(9)])
    got = {r.doc_id: r for r in line_spread.remove_boilerplate(d).collect()}
    assert got[0].text.startswith("a line") and all(got[i].text == f"own words {i}" and got[i]["_"] == i for i in range(1, 9))


def test_near_copies(spark):
    same = " ".join(f"w{i}" for i in range(30))
    d = docs(spark, [same, same, same + " more", "something else altogether here now", None])
    got = {r.doc_id: r for r in corpus_pipeline.drop_near_copies(spark, d.unionByName(d), "").collect()}
    assert set(got) == {0, 3, 4} and got[3]["_id"] == 6 and got[3]["_h"] == 7


def test_suppression():
    """The sweep keeps what comparing every pair keeps."""
    rng = random.Random(6)
    for _ in range(300):
        found = []
        for i in range(rng.randrange(40)):
            start = rng.randrange(30)
            found.append(licenses.Detection(start, start + rng.randrange(1, 9), "x", rng.choice([50, 70, 90]), 1.0, rng.randrange(5), rng.random() < 0.1))
        kept = []
        for d in sorted(found, key=lambda d: (-d.priority, d.start - d.past, d.rule, d.start)):
            if d.base or not any(k.start <= d.start and d.past <= k.past for k in kept):
                kept.append(d)
        assert licenses.suppress(found) == sorted(kept)


def test_long_text_of_licences():
    line = b"licensed under the mit license, see apache license version 2.0 and cc by nc 4.0. all rights reserved.\n"
    began = time.process_time()
    few = licenses.scan_text(line * 500)
    first = time.process_time() - began
    many = licenses.scan_text(line * 4000)
    assert len(many) == 8 * len(few) and time.process_time() - began < 30 * max(first, 0.05)
    assert [d.start for d in few if d.label == "mit" and d.base][:3] == [1, 21, 41]


def test_clauses_by_hand():
    for text, label in ((b"The software shall be used for Good, not Evil. The software is provided as is", "json"),
                        (b"THE ABOVE COPYRIGHT NOTICE and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
                        (b"Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
                        (b"This is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty", "gpl"),
                        (b"unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" basis", "apache-2")):
        assert label in {d.label for d in licenses.scan_text(text.lower())}, label
