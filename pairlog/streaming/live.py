"""Live operators over a stream of answers, and a runner that drains a source.

Every operator takes and returns a streaming DataFrame and works on a static one as well,
which is how its batch twin is checked. Event time is ``ts`` (timestamp).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..session import ship, work_dir

ANSWER_TIMEOUT = "60 seconds"


def utc_instant(clock: Column) -> Column:
    """A clock time without zone, read as UTC whatever the session's zone, as an instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock).cast("timestamp")


def utc_clock(instant: Column) -> Column:
    """Back from an instant to the UTC clock time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def answer_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None, only: str | None = None) -> DataFrame:
    """Parquet files of a folder (``only``: its files of that name) as a stream; event time gets the type that watermarks want.

    Without ``files_per_batch`` all files that are there make one micro batch, so a replay does not depend
    on their number or order. A limit suits files that arrive in the order of event time: whatever is later
    than the watermark allows is dropped, as in any stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if only:
        reader = reader.option("pathGlobFilter", only)
    stream = reader.parquet(folder)
    zoneless = schema["ts"].dataType.typeName() == "timestamp_ntz"
    return stream.withColumn("ts", utc_instant(F.col("ts"))) if zoneless else stream


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a single file or a folder of part files, as a stream; raises if there is none."""
    table = spark.read.parquet(path)
    folder, name = os.path.split(path.rstrip("/"))
    single = [os.path.basename(f) for f in table.inputFiles()] == [name]
    return answer_stream(spark, folder, table.schema, only=name) if single else answer_stream(spark, path, table.schema)


#: Event time of the row that ends a replay: every window of real data closes before it.
END_OF_REPLAY = "2200-01-01 00:00:00"


def with_end(stream: DataFrame) -> DataFrame:
    """A bounded replay with one more row, all NULL but for a far event time, which moves the watermark
    past every open window, session and state. Its own window never closes; ``before_end`` tells it from
    real rows, which may have NULL keys too. Only for sources read in one micro batch."""
    spark = stream.sparkSession
    folder = work_dir(spark, "end")
    columns = [F.lit(END_OF_REPLAY).cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
               for f in stream.schema.fields]
    spark.range(1).select(*columns).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def before_end(rows: DataFrame) -> DataFrame:
    """Without the row of ``with_end``. Below the watermark of ``rows``, which that row has moved."""
    return rows.where(F.col("ts") < F.lit(END_OF_REPLAY).cast(rows.schema["ts"].dataType))


PAIR_SCHEMA = "Identifier string, TrialNumber int, grp bigint, answers int, Points int"


class PairScore(StatefulProcessor):
    """One pair in one trial: the first answer sets a timer, and the second one, if it comes in time, scores the pair at
    once. When the timer runs out the pair has one answer and no points, and what comes later changes nothing. In time
    means by event time, whatever the order of arrival; of one person the first answer to arrive counts."""

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pair = handle.getValueState("pair", "ms bigint, id bigint, name string, scored boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.pair.get()
        before = known
        for r in sorted(rows, key=lambda r: (r.ms, r.id is not None, r.id)):
            if known is None:
                known = (r.ms, r.id, r.name, False)
                continue
            ms, person, name, scored = known
            if scored or (person is not None and person == r.id):
                continue
            in_time = abs(r.ms - ms) <= self.wait_ms
            points = int(in_time and bool(name) and name == r.name)
            known = (max(ms, r.ms), person, name, True)
            yield self._row(key, 2 if in_time else 1, points)
        if known != before:
            if before is not None and not before[3]:
                self.handle.deleteTimer(before[0] + self.wait_ms + 1)
            self.pair.update(known)
            self.handle.registerTimer(known[0] + (self.keep_ms if known[3] else self.wait_ms + 1))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        known = self.pair.get()
        if known is None:
            return
        if known[3]:
            self.pair.clear()
            return
        self.pair.update((known[0], known[1], known[2], True))
        self.handle.registerTimer(known[0] + max(self.keep_ms, self.wait_ms + 2))
        yield self._row(key, 1, 0)

    @staticmethod
    def _row(key, answers: int, points: int) -> Row:
        return Row(Identifier=key[0], TrialNumber=key[1], grp=key[2], answers=answers, Points=points)

    def close(self) -> None:
        pass


def _ms(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def stream_pair_score(answers: DataFrame, wait: str = ANSWER_TIMEOUT, late: str = ANSWER_TIMEOUT, keep: str = "1 day") -> DataFrame:
    """One row for each pair and trial: 1 point when the second answer came within ``wait`` of the first and both agree
    (case aside; an empty answer agrees with nothing), 0 when they differ or when ``wait`` has passed; ``answers``
    counts those in time. People without a pair are alone. State is four values for each pair, kept for ``keep``
    after the answers, so that a later one finds the pair scored."""
    ship(answers.sparkSession)
    alone = F.when(F.col("grp").isNull() | (F.col("grp") < 0), F.col("id"))
    rows = before_end(answers.withWatermark("ts", late)).select(
        "Identifier", F.col("TrialNumber").cast("int").alias("TrialNumber"), F.col("grp").cast("bigint").alias("grp"),
        alone.cast("bigint").alias("alone"), F.col("id").cast("bigint").alias("id"), F.lower(F.coalesce("Response", F.lit(""))).alias("name"),
        F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("Identifier", "TrialNumber", "grp", "alone").transformWithState(
        PairScore(_ms(wait), _ms(keep)), PAIR_SCHEMA, "append", "EventTime")


def stream_response_counts(answers: DataFrame, window: str = "1 day", slide: str | None = None,
                           late: str = ANSWER_TIMEOUT) -> DataFrame:
    """Counts per run, window and answer."""
    return _window_counts(answers.withWatermark("ts", late), window, slide).select(
        "Identifier", F.col("window.start").alias("window_start"), "Response", "n")


def _window_counts(answers: DataFrame, window: str, slide: str | None) -> DataFrame:
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return answers.groupBy(w, "Identifier", "Response").agg(F.count(F.lit(1)).alias("n"))


def stream_entropy(answers: DataFrame, window: str = "1 day", slide: str | None = None, late: str = ANSWER_TIMEOUT) -> DataFrame:
    """Entropy (nats) of a run's answers in each window, tumbling or sliding. Two stateful aggregates in one
    stream: counts of answers, then sums over the answers of a window, which stay open until the watermark
    passes the window. Missing answers are not counted."""
    n = F.col("n").cast("double")
    marked = answers.withWatermark("ts", late)
    # a condition that names the event time stays above the watermark, which the row that ends a replay has to reach
    given = F.when(F.col("ts") < F.lit(END_OF_REPLAY).cast(marked.schema["ts"].dataType), F.col("Response")).isNotNull()
    counts = _window_counts(marked.where(given), window, slide)
    sums = counts.groupBy("window", "Identifier").agg(F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("inner"))
    return sums.select("Identifier", F.col("window.start").alias("window_start"), F.col("total").cast("bigint").alias("answers"),
                       F.greatest(F.log("total") - F.col("inner") / F.col("total"), F.lit(0.0)).alias("entropy"))


def stream_running_score(scored: DataFrame) -> DataFrame:
    """Points so far per player; update mode."""
    return scored.groupBy("Identifier", "id").agg(F.sum("Points").alias("score"))


def stream_dedup_answers(answers: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first answer to arrive per player and trial; later ones, and late ones, drop."""
    return answers.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_sessions(answers: DataFrame, player: str = "user_id", gap: str = ANSWER_TIMEOUT,
                    late: str = ANSWER_TIMEOUT) -> DataFrame:
    """Activity sessions per player."""
    s = (answers.withWatermark("ts", late).groupBy(F.session_window("ts", gap), player)
         .agg(F.count(F.lit(1)).alias("events")))
    return s.select(player, F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "events")


LABEL_SCHEMA = "Identifier string, id bigint, TrialNumber int, DecisionType string"


def _label(answer: str | None, prev: str | None, partner_prev: str | None, seen: bool) -> str | None:
    if answer is None:
        return None
    return "RS" if answer == prev else "RP" if answer == partner_prev else "EC" if seen else "BN"


class PlayerMemory(StatefulProcessor):
    """One player. Answers wait in a list until the watermark has passed them, so that they are labelled in the order of
    trials whatever the order of arrival. Answers seen are a map, of which a batch reads and writes the entries it
    needs; it is never rewritten as a whole. An answer more than ``keep_ms`` after the one before finds no
    memory, and all state goes by then; without ``keep_ms`` nothing is forgotten."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "answer string", "ms bigint")
        self.last = handle.getValueState("last", "prev string, partner_prev string, ms bigint")
        self.waiting = handle.getListState("waiting", "trial int, ms bigint, answer string, partner string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r.TrialNumber, r.ms, r.Response, r.partner_response) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(min(r[1] for r in new) + 1, timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in held if r[1] < watermark), key=lambda r: (r[0], r[1]))
        rest = [r for r in held if r[1] >= watermark]
        prev, partner_prev, last = self.last.get() or (None, None, None)
        fresh: dict[str, int] = {}
        known: dict[str, bool] = {}

        def met(answer: str) -> bool:
            if answer not in known:
                known[answer] = self.seen.containsKey((answer,))
            return known[answer]

        for trial, ms, answer, partner in ready:
            if self.keep_ms is not None and last is not None and ms > last + self.keep_ms:
                self.seen.clear()
                fresh, prev, partner_prev = {}, None, None
                known = dict.fromkeys(known, False)
                met = lambda answer: known.get(answer, False)  # noqa: E731  nothing is left in the state to ask
            last = ms if last is None else max(last, ms)
            label = _label(answer, prev, partner_prev, answer is not None and met(answer))
            for x in (answer, partner):
                if x is not None and not met(x):
                    known[x], fresh[x] = True, ms
            prev, partner_prev = answer, partner
            if label:
                yield Row(Identifier=key[0], id=key[1], TrialNumber=trial, DecisionType=label)
        for answer, ms in fresh.items():
            self.seen.updateValue((answer,), (ms,))
        if ready:
            self.last.update((prev, partner_prev, last))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self.handle.registerTimer(min(r[1] for r in rest) + 1)
        elif self.keep_ms is not None and last is not None:
            if last + self.keep_ms < watermark:
                self.seen.clear()
                self.last.clear()
                self.waiting.clear()
            else:
                self.handle.registerTimer(last + self.keep_ms + 1)

    def close(self) -> None:
        pass


def stream_decisions(paired: DataFrame, late: str = ANSWER_TIMEOUT, keep: str | None = None) -> DataFrame:
    """Label each answer from the player's own memory once the watermark has passed its trial, so arrival
    order within ``late`` does not matter. An answer without a value gets no label, but counts as the
    previous trial and brings the partner's answer in. A player is forgotten ``keep`` after the last answer;
    NULL keeps every player, as a bounded replay wants."""
    ship(paired.sparkSession)
    return (before_end(paired.withWatermark("ts", late))
            .select("Identifier", F.col("id").cast("bigint").alias("id"), F.col("TrialNumber").cast("int").alias("TrialNumber"), "Response",
                    "partner_response", "ts", F.unix_millis(F.col("ts")).alias("ms"))
            .groupBy("Identifier", "id")
            .transformWithState(PlayerMemory(None if keep is None else _ms(keep)), LABEL_SCHEMA, "append", "EventTime"))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a query whose state may be larger than memory and keyed within a group, as ``transformWithState``
    wants it. A state store that the session has chosen itself stays."""
    chosen = spark.conf.get(_PROVIDER, None)
    default = "HDFSBackedStateStoreProvider" in (chosen or "HDFSBackedStateStoreProvider")
    if default:
        spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if default:
            spark.conf.set(_PROVIDER, chosen) if chosen else spark.conf.unset(_PROVIDER)


def drain(stream: DataFrame, purpose: str) -> DataFrame:
    """Run an append-mode stream over all that is available and read its file sink. Sink and
    checkpoint lie in the shared work folder, so a restarted driver can pick both up."""
    spark = stream.sparkSession
    base = work_dir(spark, purpose)
    out = os.path.join(base, "table")
    query = start(stream.writeStream.outputMode("append").format("parquet")
                  .option("path", out).option("checkpointLocation", os.path.join(base, "checkpoint"))
                  .trigger(availableNow=True), spark)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Run an update-mode stream and keep the latest row per key. A batch writes its own
    folder, replaced when the batch is retried, so that the result is exactly once."""
    spark = stream.sparkSession
    base = work_dir(spark, purpose)
    out = os.path.join(base, "table")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", os.path.join(base, "checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    latest = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return latest.select(*keys, "r.*")
