"""Pairs, coordination, dominance, shares, running scores.

Column names default to the long log: Identifier (run), TrialNumber, id (participant),
Response, grp (pair). A pair holds at most two rows and a participant at most one row per
trial, so windows keyed on either are small. Groups which can be large - a run's trial, a
condition, a response - are only ever reached by mergeable aggregates, and put back on
detail rows by an equi join which Catalyst may broadcast after measuring it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import DECISIONS, as_col
from .ranking import bucketed_row_number

RUN, TRIAL, PERSON, RESPONSE, PAIR = "Identifier", "TrialNumber", "id", "Response", "grp"
CONDITION = ("Structure", "Content")


def _by_pair(df: DataFrame, pair: str = PAIR):
    """The frame with a helper column ``_lone``, and a window over the members of a pair.
    Unpaired rows share one pair id (NULL or below zero) which may cover much of a trial:
    there ``_lone`` makes each row its own partition."""
    unpaired = F.col(pair).isNull() | (F.col(pair) < 0)
    return df.withColumn("_lone", F.when(unpaired, F.col(PERSON))), W.partitionBy(RUN, TRIAL, pair, "_lone")


def _one_answer(w) -> Column:
    """1 when the answers of a window are one distinct value, a missing one being a value."""
    same = F.min(RESPONSE).over(w).eqNullSafe(F.max(RESPONSE).over(w))
    mixed = F.max(F.col(RESPONSE).isNull()).over(w) & F.max(F.col(RESPONSE).isNotNull()).over(w)
    return (same & ~mixed).cast("int")


def attach_partner(df: DataFrame, pair: str = PAIR) -> DataFrame:
    """Add partner_id, partner_response, Points (1 when both gave the same answer) and
    Coordinate. One window, so one shuffle, instead of a self join; rows without a partner
    carry NULL and 0, and what a query does not use is pruned from the window."""
    keyed, w = _by_pair(df, pair)
    me = F.struct(F.col(PERSON).alias("id"), F.col(RESPONSE).alias("r"))
    both = keyed.withColumns({"_low": F.min(me).over(w), "_high": F.max(me).over(w), "Coordinate": _one_answer(w)})
    other = F.when(F.col("_low.id") == F.col(PERSON), F.col("_high")).otherwise(F.col("_low"))
    alone = F.col("_low.id") == F.col("_high.id")
    return (both
            .withColumns({"partner_id": F.when(~alone, other["id"]), "partner_response": F.when(~alone, other["r"])})
            .withColumn("Points", F.coalesce((F.col("partner_response") == F.col(RESPONSE)).cast("int"), F.lit(0)))
            .drop("_low", "_high", "_lone"))


def pair_coordination(df: DataFrame, pair: str = PAIR) -> DataFrame:
    """Coordinate = 1 when the pair's answers are one distinct value. A lone member scores
    1, and a missing answer counts as a value of its own."""
    keyed, w = _by_pair(df, pair)
    return keyed.withColumn("Coordinate", _one_answer(w)).drop("_lone")


def coordination_rate(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL, *CONDITION)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("Coordinate").alias("GroupCoordRate"))


def coordination_by_decision(df: DataFrame,
                             keys: Sequence[str] = (*CONDITION, TRIAL, "DecisionType")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("Coordinate").alias("DTCoordAvg"))


def run_sizes(df: DataFrame) -> DataFrame:
    """Participants per run, de-duplicated before they are counted."""
    return df.select(RUN, PERSON).distinct().groupBy(RUN).agg(F.count(F.lit(1)).alias("Size"))


def with_size(df: DataFrame) -> DataFrame:
    return df.join(run_sizes(df), RUN)


def response_counts(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL)) -> DataFrame:
    """Count per answer; missing answers are not counted."""
    return df.where(F.col(RESPONSE).isNotNull()).groupBy(*keys, RESPONSE).agg(F.count(F.lit(1)).alias("n"))


def dominant_response(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL, *CONDITION)) -> DataFrame:
    """Most common answer (ties alphabetical), its count and its share of respondents. All
    persons of the trial are respondents, those who left the answer empty included.

    Two mergeable levels over one shuffle key family: per answer, then per trial. Nobody
    answers twice in a trial, so distinct respondents are rows."""
    per_answer = df.groupBy(*keys, RESPONSE).agg(F.count(F.lit(1)).alias("n"))
    answered = F.col(RESPONSE).isNotNull()
    best = F.min(F.when(answered, F.struct((-F.col("n")).alias("neg"), F.col(RESPONSE).alias("r"))))
    out = per_answer.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("NumRespondents"))
    return out.select(*keys, F.col("b.r").alias("DomResponse"), (-F.col("b.neg")).alias("DomResponseCount"),
                      "NumRespondents", (-F.col("b.neg") / F.col("NumRespondents")).alias("DomResponseProp"))


def lag_previous(df: DataFrame, cols: dict[str, str], run: str = RUN, order: str = TRIAL) -> DataFrame:
    """Previous trial's value of aggregated columns: {source: new name}. One row per run and
    trial goes in, so a run's partition is as long as the game."""
    w = W.partitionBy(run).orderBy(order)
    return df.withColumns({new: F.lag(old).over(w) for old, new in cols.items()})


def previous_responses(df: DataFrame) -> DataFrame:
    """Own and partner's answer at the participant's previous trial."""
    w = W.partitionBy(RUN, PERSON).orderBy(TRIAL)
    return df.withColumns({
        "prev_response": F.lag(RESPONSE).over(w),
        "partner_prev_response": F.lag("partner_response").over(w),
    })


def respondents(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL)) -> DataFrame:
    """Rows of the group kept on each row, by aggregate and join rather than by a window:
    a group of any size never meets in one task."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("NumRespondents"))
    return df.join(n, list(keys))


def running_score(df: DataFrame) -> DataFrame:
    """Cumulative points of a participant."""
    w = W.partitionBy(RUN, PERSON).orderBy(TRIAL).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("score", F.sum("Points").over(w))


def strategy_points(df: DataFrame) -> DataFrame:
    """Cumulative recency-weighted points by kind of answer: a point won at trial t with
    decision D adds t to D's account."""
    w = W.partitionBy(RUN, PERSON).orderBy(TRIAL).rowsBetween(W.unboundedPreceding, W.currentRow)
    won = lambda d: F.when((F.col("DecisionType") == d) & (F.col("Points") == 1), F.col(TRIAL)).otherwise(0)
    return df.withColumns({f"{d.lower()}_pts": F.sum(won(d)).over(w) for d in ("RP", "EC", "RS")})


def decision_shares(df: DataFrame, keys: Sequence[str] = (RUN, *CONDITION, TRIAL)) -> DataFrame:
    """Share of each decision among the rows of its run and trial. The total is taken from
    the counts, not from the log again."""
    counts = df.groupBy(*keys, "DecisionType").agg(F.count(F.lit(1)).alias("DTCounts"))
    total = F.sum("DTCounts").over(W.partitionBy(*keys))
    return (counts.withColumn("NumRespondants", total)
            .withColumn("DTNormed", F.col("DTCounts") / F.col("NumRespondants")))


def decision_shares_by_condition(shares: DataFrame, by_size: Sequence[str] = (*CONDITION, "Size", TRIAL, "DecisionType"),
                                 pooled: Sequence[str] = (TRIAL, "DecisionType", "Content", "Structure")) -> DataFrame:
    """Mean share over runs, then mean of those over sizes."""
    per_size = shares.groupBy(*by_size).agg(F.avg("DTNormed").alias("m"))
    return per_size.groupBy(*pooled).agg(F.avg("m").alias("DTNormedAvg"))


def decision_pivot(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL)) -> DataFrame:
    """One row per trial, one count column per decision in fixed order, zero filled."""
    wide = df.groupBy(*keys).pivot("DecisionType", DECISIONS).agg(F.count(F.lit(1)))
    return wide.na.fill(0, DECISIONS)


def decision_proportion_curves(df: DataFrame, sizes: DataFrame, nominal: Column | None = None) -> DataFrame:
    """Decision counts over network size, averaged over a condition's runs. ``nominal``
    replaces the size of a run (the published tables divide every hashtag run by 20)."""
    counts = decision_pivot(df, (RUN, *CONDITION, TRIAL)).join(sizes, RUN)
    size = F.col("Size") if nominal is None else nominal
    return counts.groupBy(*CONDITION, TRIAL).agg(
        *[F.avg(F.col(d) / size).alias(d) for d in DECISIONS])


def points_by_decision(df: DataFrame) -> DataFrame:
    return df.groupBy("DecisionType").agg(F.sum("Points").alias("Points"))


def points_per_trial(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL)) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("Points").alias("Points"))


def scored_cells(df: DataFrame) -> DataFrame:
    """0-based (trial, participant) cells in which a point was won."""
    won = df.groupBy(RUN, TRIAL, PERSON).agg(F.sum("Points").alias("p")).where(F.col("p") == 1)
    return won.select(RUN, (F.col(TRIAL) - 1).alias("x"), (F.col(PERSON) - 1).alias("y"))


def transition_probs(df: DataFrame, by: Sequence[str] = (), conditional: bool = False,
                     strict: bool = False) -> DataFrame:
    """Share of each (from, to) decision among all transitions (or among those from the
    same decision). Consecutive rows make a transition; ``strict`` wants consecutive trials."""
    steps = next_decision(df).where(F.col("next").isNotNull())
    if strict:
        steps = steps.where(F.col("next_trial") == F.col(TRIAL) + 1)
    counts = steps.groupBy(*by, F.col("DecisionType").alias("from"), F.col("next").alias("to")).agg(
        F.count(F.lit(1)).alias("n"))
    base = [*by, *(["from"] if conditional else [])]
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*base)))


def next_decision(df: DataFrame) -> DataFrame:
    """Each row with the participant's next decision and the trial it was taken in."""
    w = W.partitionBy(RUN, PERSON).orderBy(TRIAL)
    return df.withColumn("next", F.lead("DecisionType").over(w)).withColumn("next_trial", F.lead(TRIAL).over(w))


def prior(df: DataFrame, by: Sequence[str] = ("Content",)) -> DataFrame:
    """Distribution of first-trial answers pooled over runs."""
    counts = (df.where((F.col(TRIAL) == 1) & F.col(RESPONSE).isNotNull())
              .groupBy(*by, RESPONSE).agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(total, list(by)).select(*by, RESPONSE, "n", (F.col("n") / F.col("total")).alias("share"))


def restrict_to(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Semi join to a data-driven list."""
    return df.join(allowed.select(*keys), list(keys), "left_semi")


def response_coordination(df: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Coordination rate per answer with its Wilson interval."""
    agg = df.groupBy("Content", RESPONSE).agg(F.count(F.lit(1)).alias("n"), F.avg("Coordinate").alias("p"))
    n, p, z2 = F.col("n"), F.col("p"), z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return agg.withColumn("low", centre - half).withColumn("high", centre + half)


def trial_response_grid(df: DataFrame, k: int = 5) -> DataFrame:
    """Count of each run's k most common answers at every trial the run played, zeros
    included. The k answers of a run travel as one short array, exploded over its trials."""
    counts = response_counts(df)
    totals = counts.groupBy(RUN, RESPONSE).agg(F.sum("n").alias("total"))
    rank = F.row_number().over(W.partitionBy(RUN).orderBy(F.desc("total"), F.asc(RESPONSE)))
    top = (totals.withColumn("_r", rank).where(F.col("_r") <= k)
           .groupBy(RUN).agg(F.sort_array(F.collect_list(RESPONSE)).alias("top")))
    cells = (df.select(RUN, TRIAL).distinct().join(top, RUN)
             .select(RUN, TRIAL, F.explode("top").alias(RESPONSE)))
    return (cells.join(counts, [RUN, TRIAL, RESPONSE], "left")
            .select(RUN, TRIAL, RESPONSE, F.coalesce("n", F.lit(0)).alias("n")))


def n_unique(df: DataFrame, col: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Distinct values; exact counts de-duplicate first so that they spread over tasks."""
    if approximate:
        return df.groupBy(*by).agg(F.approx_count_distinct(col).alias("n_unique"))
    return df.select(*by, col).distinct().groupBy(*by).agg(F.count(col).alias("n_unique"))


def score_pair(df: DataFrame, name: str = "name", ratings: Sequence[str] = (), pair: str = PAIR) -> DataFrame:
    """Points of a pair: one for equal non-empty names (case does not matter), and one more
    when both gave the same value on a scale both rated. Adds name_point, rating_point and
    payoff (0..2); a lone member scores 0."""
    keyed, w = _by_pair(df, pair)
    scale = F.array(*[F.col(c) for c in ratings]) if ratings else F.array().cast("array<int>")
    me = F.struct(F.col(PERSON).alias("id"), F.lower(F.coalesce(name, F.lit(""))).alias("name"), scale.alias("ratings"))
    both = keyed.withColumns({"_a": F.min(me).over(w), "_b": F.max(me).over(w)})
    paired = F.col("_a.id") != F.col("_b.id")
    same_name = (F.col("_a.name") != "") & (F.col("_a.name") == F.col("_b.name"))
    same_rating = F.exists(F.arrays_zip(F.col("_a.ratings").alias("x"), F.col("_b.ratings").alias("y")),
                           lambda z: F.coalesce((z["x"] > 0) & (z["x"] == z["y"]), F.lit(False)))
    point = lambda c: (paired & c).cast("int")
    return (both.withColumn("name_point", point(same_name)).withColumn("rating_point", point(same_rating))
            .withColumn("payoff", F.col("name_point") + F.col("rating_point")).drop("_a", "_b", "_lone"))


def decode_payoff(payoff: Column | str, same_name: Column) -> dict[str, Column]:
    """Which component scored, told from the total and from whether the names agree."""
    payoff = as_col(payoff)
    return {
        "name_gain": F.when((payoff >= 1) & same_name, 1).otherwise(0),
        "rating_gain": F.when((payoff > 1) | ((payoff == 1) & ~same_name), 1).otherwise(0),
    }


def response_code(df: DataFrame, block: int = 1024) -> DataFrame:
    """Code of each distinct answer of a run by first appearance, scanning participant by
    participant and trial by trial. Numbered in blocks of participants, so that a large run
    is not sorted in one task."""
    first = df.where(F.col(RESPONSE).isNotNull()).groupBy(RUN, RESPONSE).agg(
        F.min(F.struct(PERSON, TRIAL)).alias("at"))
    coded = bucketed_row_number(first, F.floor(F.col(f"at.{PERSON}") / block),
                                [f"at.{PERSON}", f"at.{TRIAL}"], [RUN], name="code")
    return coded.select(RUN, RESPONSE, F.col("code").cast("bigint").alias("code"))


def distinct_trials(df: DataFrame, keys: Sequence[str] = (RUN, TRIAL), order: str = PERSON) -> DataFrame:
    """One row per run and trial, the other columns from its first participant."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return kept.select(*keys, "r.*")
