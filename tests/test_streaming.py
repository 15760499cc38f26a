"""Stream = batch: for any number and order of files, and over several micro batches in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairlog.operators import decisions as D, interactions as I
from pairlog.streaming import live as L

START = dt.datetime(2024, 1, 1)
BARE = ["Identifier", "Structure", "Content", "id", "TrialNumber", "Response", "grp"]


@pytest.fixture(scope="module")
def log(spark):
    """Fourteen trials of six people, minutes apart; some do not come, some give no answer."""
    rng = random.Random(3)
    rows = []
    for t in range(1, 15):
        people = [p for p in range(6) if rng.random() > 0.15]
        rng.shuffle(people)
        for i, p in enumerate(people):
            rows.append(("r", "Spatial", "Face", p, t, rng.choice(["A", "a", "b", None]), i // 2,
                         START + dt.timedelta(minutes=10 * t, seconds=rng.randrange(50))))
    schema = "Identifier string, Structure string, Content string, id int, TrialNumber int, Response string, grp int, ts timestamp"
    return I.attach_partner(spark.createDataFrame(rows, schema)).cache()


@pytest.fixture(scope="module", params=[1, 65, 200])
def replay(request, spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "log")
    log.repartition(request.param, F.rand(7)).write.parquet(path)
    return L.with_end(L.table_stream(spark, path))


@pytest.fixture(scope="module")
def ordered(spark, log, tmp_path_factory):
    """One file and one micro batch for each trial."""
    path = tmp_path_factory.mktemp("ordered")
    for t in range(1, 15):
        log.where(F.col("TrialNumber") == t).coalesce(1).write.parquet(str(path / f"t={t:02d}"))
    return L.answer_stream(spark, str(path / "*"), log.schema, files_per_batch=1)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def labels(log):
    return rows(D.label_decisions(log.select(*BARE)).where("DecisionType IS NOT NULL"), "id", "TrialNumber", "DecisionType")


def pair_points(log):
    pairs = {}
    for r in log.collect():
        pairs.setdefault((r.TrialNumber, r.grp), []).append((r.Response or "").lower())
    return sorted((*k, int(len(v) == 2 and v[0] == v[1] != "")) for k, v in pairs.items())


def test_replay_does_not_depend_on_files(spark, log, replay):
    assert rows(L.drain(L.stream_decisions(replay), "labels"), "id", "TrialNumber", "DecisionType") == labels(log)
    assert rows(L.drain(L.stream_pair_score(replay), "pairs"), "TrialNumber", "grp", "Points") == pair_points(log)


def test_other_replays(spark, log, tmp_path):
    path = str(tmp_path / "log")
    log.repartition(90, F.rand(7)).write.parquet(path)
    replay = L.with_end(L.table_stream(spark, path))
    counts = L.drain(L.stream_response_counts(replay, "5 minutes"), "counts")
    assert counts.agg(F.sum("n")).first()[0] == log.count()
    sliding = L.drain(L.stream_response_counts(replay, "20 minutes", "10 minutes"), "slide")
    assert sliding.agg(F.sum("n")).first()[0] == 2 * log.count()
    sessions = L.drain(L.stream_sessions(replay, player="id", gap="5 minutes"), "sessions")
    assert sessions.count() == log.count()
    once = L.drain(L.stream_dedup_answers(replay.select("id", "TrialNumber", "ts").withColumn(
        "copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["id", "TrialNumber"]), "dedup")
    once = L.before_end(once)
    assert rows(once, "id", "TrialNumber") == rows(log, "id", "TrialNumber")
    got = L.drain_updates(L.stream_running_score(L.before_end(replay)), ["Identifier", "id"], "score")
    assert rows(got, "id", "score") == rows(log.groupBy("id").agg(F.sum("Points").alias("s")), "id", "s")


def test_ordered_batches(spark, log, ordered):
    """What the watermark has passed comes out batch by batch; the last trial is still open."""
    past = log.where("TrialNumber < 14")
    assert rows(L.drain(L.stream_decisions(ordered), "labels"), "id", "TrialNumber", "DecisionType") == [
        x for x in labels(log) if x[1] < 14]
    # a pair is scored when its second answer is in, someone alone when the time is over
    want = pair_points(past) + [x for x in pair_points(log.where("TrialNumber = 14 AND partner_id IS NOT NULL"))]
    assert rows(L.drain(L.stream_pair_score(ordered), "pairs"), "TrialNumber", "grp", "Points") == sorted(want)
    got = L.drain_updates(L.stream_running_score(ordered), ["Identifier", "id"], "score")
    assert rows(got, "id", "score") == rows(log.groupBy("id").agg(F.sum("Points").alias("s")), "id", "s")


def test_state_expires(spark, tmp_path):
    """A player who comes back after hours is new again if the memory lasts for minutes."""
    for i, player in enumerate([1, 2, 2, 1, 2]):
        spark.createDataFrame([("r", player, i, "A", None, START + dt.timedelta(hours=2 * i))],
                              "Identifier string, id int, TrialNumber int, Response string, partner_response string, ts timestamp") \
            .coalesce(1).write.parquet(str(tmp_path / f"t={i}"))
    schema = spark.read.parquet(str(tmp_path / "t=0")).schema
    for keep, label in (("5 minutes", "BN"), ("30 days", "RS")):
        stream = L.answer_stream(spark, str(tmp_path / "*"), schema, files_per_batch=1)
        got = rows(L.drain(L.stream_decisions(stream, keep=keep), "short"), "id", "TrialNumber", "DecisionType")
        assert [x[2] for x in got if x[0] == 1] == ["BN", label]


def test_missing_table(spark, tmp_path):
    with pytest.raises(Exception):
        L.table_stream(spark, str(tmp_path / "none.parquet"))


def batches(spark, folder, schema, *parts):
    """A stream with one file and one micro batch for each part."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"b={i:02d}"))
    return L.answer_stream(spark, str(folder / "*"), spark.read.parquet(str(folder / "b=00")).schema, files_per_batch=1)


ANSWERS = "Identifier string, TrialNumber int, grp int, id int, Response string, ts timestamp"


def answer(pair, person, name, seconds, run="r"):
    return (run, 1, pair, person, name, START + dt.timedelta(seconds=seconds))


def test_sixty_seconds(spark, tmp_path):
    first = [answer(1, 1, "A", 0), answer(2, 1, "A", 0), answer(3, 1, "A", 0), answer(4, 1, "A", 0), answer(5, 1, "", 0), answer(6, 1, None, 0),
             answer(7, 1, "A", 0), answer(-1, 1, "A", 0), answer(-1, 2, "A", 0), answer(None, 3, "A", 0), answer(8, 1, "A", 30), answer(9, 1, "A", 0),
             answer(9, 1, "A", 5), answer(11, 1, "A", 90), answer(12, 1, "A", 0, None)]
    second = [answer(1, 2, "a", 59), answer(2, 2, "a", 61), answer(3, 2, "b", 59), answer(4, 2, "a", 60), answer(5, 2, "", 10), answer(6, 2, None, 10),
              answer(8, 2, "A", 0), answer(11, 2, "A", 20), answer(12, 2, "a", 3, None)]
    later = [answer(7, 2, "A", 100), answer(10, 1, "x", 4000)]
    end = [answer(99, 1, "x", 90_000)]
    want = {(1, 2, 1), (2, 1, 0), (3, 2, 0), (4, 2, 1), (5, 2, 0), (6, 2, 0), (7, 1, 0), (-1, 1, 0), (None, 1, 0), (8, 2, 1), (9, 1, 0), (10, 1, 0),
            (11, 1, 0), (12, 2, 1)}
    stream = batches(spark, tmp_path, ANSWERS, first, second, later, end, [answer(98, 1, "x", 90_001)])
    got = L.drain(L.stream_pair_score(stream, late="2 minutes"), "pairs").where("grp IS NULL OR grp < 90").select("grp", "answers", "Points").collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want) + 1  # the two people without a pair


def test_entropy_in_the_stream(spark, log, replay):
    import math
    from collections import Counter, defaultdict

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n) for c in counts.values())

    for width, slide in ((5, None), (20, 10)):
        windows = defaultdict(Counter)
        for r in log.where("Response IS NOT NULL").collect():
            minute = int((r.ts - START).total_seconds() // 60)
            step = slide or width
            at = minute - minute % step
            while at > minute - width:
                windows[START + dt.timedelta(minutes=at)][r.Response] += 1
                at -= step
        got = {r.window_start: r for r in L.drain(L.stream_entropy(replay, f"{width} minutes", slide and f"{slide} minutes"), "entropy").collect()}
        assert set(got) == set(windows)
        assert all(got[w].entropy == pytest.approx(entropy(c), abs=1e-12) and got[w].answers == sum(c.values()) for w, c in windows.items())


def test_entropy_comes_out_window_by_window(spark, ordered):
    """Both levels are append mode: the sink has every closed window after the last trial, none that is open."""
    got = L.drain(L.stream_entropy(ordered, "10 minutes"), "entropy")
    starts = sorted({r.window_start for r in got.collect()})
    assert starts[0] == START + dt.timedelta(minutes=10) and starts[-1] < START + dt.timedelta(minutes=140) and len(starts) >= 11


def test_memory_over_forty_days(spark, tmp_path):
    """A player who pauses for forty days is known as ever; the batch labels are the same."""
    days = [0, 1, 41, 42, 90]
    said = {1: ["A", "B", "B", "A", "C"], 2: ["B", "C", "A", None, "C"]}
    rows_ = [("r", "Spatial", "Face", p, d + 1, said[p][i], 0, START + dt.timedelta(days=d, seconds=p)) for i, d in enumerate(days) for p in (1, 2)]
    schema = "Identifier string, Structure string, Content string, id int, TrialNumber int, Response string, grp int, ts timestamp"
    log_ = I.attach_partner(spark.createDataFrame(rows_, schema))
    path = str(tmp_path / "log")
    log_.write.parquet(path)
    got = rows(L.drain(L.stream_decisions(L.with_end(L.table_stream(spark, path))), "long"), "id", "TrialNumber", "DecisionType")
    assert got == labels(log_) and len(got) == 9
    short = L.drain(L.stream_decisions(L.with_end(L.table_stream(spark, path)), keep="30 days"), "short")
    assert rows(short.where("TrialNumber = 42 AND id = 1"), "DecisionType") == [("BN",)]


def test_rows_without_keys_stay(spark, tmp_path):
    """The row that ends a replay is told by its time, so real rows without a user are not lost."""
    path = str(tmp_path / "events")
    spark.createDataFrame([(None, 1, START), (5, 1, START), (5, 1, START), (None, 2, START)], "user_id int, TrialNumber int, ts timestamp") \
        .coalesce(1).write.parquet(path)
    once = L.before_end(L.drain(L.stream_dedup_answers(L.with_end(L.table_stream(spark, path)), ["user_id", "TrialNumber"]), "dedup"))
    assert {tuple(r) for r in once.select("user_id", "TrialNumber").collect()} == {(None, 1), (None, 2), (5, 1)}


def test_the_state_store_of_the_session_stays(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    L.drain(L.stream_pair_score(batches(spark, tmp_path, ANSWERS, [answer(1, 1, "A", 0)])), "pairs")
    assert spark.conf.get(key, None) == before
