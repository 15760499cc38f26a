"""Live operators drained over the whole event table; the twins are batch SQL over all of it. The log is
written first only to have a file source with the canonical columns: the operators take any source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interactions as I
from ..session import work_dir
from ..sources.canonical import trial_of
from ..streaming import live as L
from .registry import query, r6


def log_stream(t, paired=False):
    """The canonical log written as files, and read back as a stream."""
    log = t.interactions(extra=["ts"])
    if paired:
        log = I.attach_partner(log)
    folder = work_dir(t.spark, "log")
    log.write.parquet(folder)
    return L.with_end(L.answer_stream(t.spark, folder, log.schema))


def event_stream(t):
    return L.with_end(L.table_stream(t.spark, f"{t.root}/events.parquet"))


def _pair_twin(wait: str) -> str:
    """The first answer of a pair, and the second one if it came within ``wait``."""
    return f"""
    SELECT Identifier, TrialNumber, CAST(grp AS BIGINT) AS grp, CAST(1 + CAST(in_time AS INT) AS INT) AS answers, CAST(in_time AND agree AS INT) AS Points FROM (
      SELECT Identifier, TrialNumber, grp, count(*) = 2 AND max(ts) <= min(ts) + INTERVAL {wait} AS in_time, min(lower(Response)) = max(lower(Response)) AS agree
      FROM v_log GROUP BY Identifier, TrialNumber, grp)"""


@query("stream_pair_score", _pair_twin("6 HOUR"))
def _(t):
    """Six hours instead of sixty seconds: the answers of the table come at any time of the day."""
    return L.drain(L.stream_pair_score(log_stream(t), wait="6 hours"), "pair-score")


@query("stream_pair_score_minute", _pair_twin("60 SECOND"))
def _(t):
    return L.drain(L.stream_pair_score(log_stream(t)), "pair-score")


def _entropy_twin(windows: str, width: str) -> str:
    return f"""
    SELECT Identifier, w AS window_start, CAST(sum(n) AS BIGINT) AS answers, {r6('-sum(p * ln(p)) + 0.0')} AS entropy FROM (
      SELECT *, n / sum(n) OVER (PARTITION BY Identifier, w) AS p FROM (
        SELECT Identifier, w, Response, count(*) AS n FROM (SELECT Identifier, Response, ts, unnest({windows}) AS w FROM v_log)
        WHERE w <= ts AND ts < w + INTERVAL {width} GROUP BY ALL)) GROUP BY ALL"""


def _entropy(stream):
    d = L.drain(stream, "entropy")
    return d.select("Identifier", L.utc_clock(F.col("window_start")).alias("window_start"), "answers", "entropy")


@query("stream_entropy", _entropy_twin("[date_trunc('day', ts)]", "1 DAY"))
def _(t):
    return _entropy(L.stream_entropy(log_stream(t)))


@query("stream_entropy_sliding", _entropy_twin(
    "[date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 12 HOUR]", "1 DAY"))
def _(t):
    return _entropy(L.stream_entropy(log_stream(t), "1 day", "12 hours"))


@query("stream_running_score", """
    SELECT Identifier, id, CAST(sum(Points) AS BIGINT) AS score FROM v_paired GROUP BY ALL""")
def _(t):
    scored = L.before_end(log_stream(t, paired=True))
    return L.drain_updates(L.stream_running_score(scored), ["Identifier", "id"], "running-score")


@query("stream_dedup_answers", "SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) + 1 AS TrialNumber FROM events")
def _(t):
    d = event_stream(t).withColumn("TrialNumber", trial_of()).select("user_id", "TrialNumber", "ts")
    return L.before_end(L.drain(L.stream_dedup_answers(d, ["user_id", "TrialNumber"]), "dedup")).select("user_id", "TrialNumber")


@query("stream_sessions", """
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR > ts
          THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, s""")
def _(t):
    d = L.drain(L.stream_sessions(event_stream(t), gap="6 hours"), "sessions")
    return d.withColumns({c: L.utc_clock(F.col(c)) for c in ("session_start", "session_end")})


@query("stream_decisions", "SELECT Identifier, id, TrialNumber, DecisionType FROM v_dec")
def _(t):
    return L.drain(L.stream_decisions(log_stream(t, paired=True)), "decisions")
