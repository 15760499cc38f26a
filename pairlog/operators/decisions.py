"""Labelling of answers (BN new, RS own previous, RP partner's previous, EC heard earlier),
the memory behind them, and scoring of a choice model over a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .interactions import (CONDITION, PERSON, RESPONSE, RUN, TRIAL, attach_partner, next_decision,
                           previous_responses, strategy_points)

# Weights of the context-aware choice model.
MATCH_WEIGHT = 50
EC_PRIOR, CONTEXT_PRIOR = 3, 20
FLOOR = 1e-9
ALPHA_STEPS = 100  # grid 0, 0.1, ..., 10


def earlier_context(df: DataFrame) -> DataFrame:
    """Flag answers the participant had given or heard in any earlier trial.

    No range join: every row is split in the answer given and the answer heard, and the
    first trial of each (participant, answer) is a window minimum. The keys extend the
    (run, participant) partitioning which the previous step left behind, so nothing moves.
    """
    # Keys stay plain columns, which keeps their partitioning known; the rest of the row rides
    # only on its "given" copy, and the "heard" copy is keys and answer alone.
    keys = [RUN, PERSON, TRIAL]
    rest = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    none = F.lit(None).cast(df.select(rest.alias("r")).schema["r"].dataType)
    given = F.struct(F.col(RESPONSE).alias("answer"), rest.alias("row"))
    heard = F.struct(F.col("partner_response").alias("answer"), none.alias("row"))
    both = df.select(*keys, F.explode(F.array(given, heard)).alias("x"))
    first = F.min(TRIAL).over(W.partitionBy(RUN, PERSON, F.col("x.answer")))
    return (both.withColumn("first_seen", F.when(F.col("x.answer").isNotNull(), first))
            .where(F.col("x.row").isNotNull())
            .select(*keys, "x.row.*", "first_seen")
            .withColumn("seen_before", F.coalesce(F.col("first_seen") < F.col(TRIAL), F.lit(False))))


def decision_label(tie: str = "RS") -> Column:
    """Label from prev_response, partner_prev_response and seen_before. When own and
    partner's previous answers coincide, ``tie`` decides: RS, RP or split (a hash coin)."""
    r = F.col(RESPONSE)
    self_, partner = r == F.col("prev_response"), r == F.col("partner_prev_response")
    coin = F.pmod(F.xxhash64(RUN, PERSON, TRIAL), F.lit(2)) == 0
    first = {"RS": F.lit("RS"), "RP": F.lit("RP"), "split": F.when(coin, "RS").otherwise("RP")}[tie]
    return (F.when(r.isNull(), F.lit(None))
            .when(self_ & partner, first).when(self_, "RS").when(partner, "RP")
            .when(F.col("seen_before"), "EC").otherwise("BN"))


def label_decisions(df: DataFrame, tie: str = "RS") -> DataFrame:
    """From a bare log with pairs to the full one: partner, points, previous answers,
    first_seen, DecisionType, BC and the RS = RP flag."""
    seen = earlier_context(previous_responses(attach_partner(df)))
    return (seen.withColumn("DecisionType", decision_label(tie))
            .withColumn("BC", label_bc())
            .withColumn("rs_rp_tie", rs_rp_tie()))


def label_bc(decision: str = "DecisionType") -> Column:
    return F.when(F.col(decision) == "BN", "B").when(F.col(decision).isNotNull(), "C")


def rs_rp_tie() -> Column:
    """The answer repeats both own and partner's previous answer."""
    return F.coalesce((F.col(RESPONSE) == F.col("prev_response"))
                      & (F.col(RESPONSE) == F.col("partner_prev_response")), F.lit(False))


def context_weights(df: DataFrame) -> DataFrame:
    """Memory of partner answers, before each trial: what the answer given weighs in it
    (``weight``) and the whole memory (``total``). A partner answer heard at trial t weighs
    t, or fifty times that when the pair matched; the trial itself does not count yet.

    Answers heard and answers given are the two sides of one explode, so the weight is a
    running sum per (participant, answer); the total is a running sum per participant.
    """
    gain = F.when(F.col("partner_response").isNotNull(),
                  F.when(F.col("Points") == 1, F.lit(MATCH_WEIGHT) * F.col(TRIAL)).otherwise(F.col(TRIAL))).otherwise(0)
    mine = W.partitionBy(RUN, PERSON).orderBy(TRIAL).rowsBetween(W.unboundedPreceding, -1)
    base = df.withColumn("_gain", gain.cast("bigint")).withColumn(
        "total", F.coalesce(F.sum("_gain").over(mine), F.lit(0)))
    keep = [RUN, PERSON, TRIAL, RESPONSE, "DecisionType", "total", *CONDITION]
    sides = base.select(*keep, F.explode(F.array(
        F.struct(F.col(RESPONSE).alias("answer"), F.lit(0).cast("bigint").alias("gain"), F.lit(True).alias("given")),
        F.struct(F.col("partner_response").alias("answer"), F.col("_gain").alias("gain"), F.lit(False).alias("given")),
    )).alias("x"))
    earlier = (W.partitionBy(RUN, PERSON, F.col("x.answer")).orderBy(TRIAL)
               .rangeBetween(W.unboundedPreceding, -1))
    weighed = sides.withColumn("weight", F.coalesce(F.sum("x.gain").over(earlier), F.lit(0)))
    return weighed.where(F.col("x.given")).select(*keep, "weight")


def context_probability(weights: DataFrame) -> DataFrame:
    """Chance of drawing the given answer from memory, for answers from earlier context."""
    return (weights.where(F.col("DecisionType") == "EC")
            .withColumn("p_context", F.try_divide(F.col("weight").cast("double"), F.col("total"))))


def propensities(trial: Column, rp: Column, ec: Column, rs: Column, alpha: Column, gamma: float = 1.0,
                 has_memory: Column | None = None) -> dict[str, Column]:
    """P(BN), P(EC), P(RP), P(RS) for the trial after ``trial``, given weighted points so
    far. New answers get alpha / (t + alpha + points); of the rest, earlier context gets
    (ec + 3) / (points + 20) when there is memory and t > 1; what remains is split between
    partner, gamma (rp + 1) / (rp + rs + 2), and self."""
    points = rp + ec + rs
    p_bn = alpha / (trial + alpha + points)
    p_ec, p_rp = context_split(trial, rp, ec, rs, gamma, has_memory)
    rest = 1 - p_bn
    return {"BN": p_bn, "EC": rest * p_ec, "RP": rest * (1 - p_ec) * p_rp, "RS": rest * (1 - p_ec) * (1 - p_rp)}


def context_split(trial: Column, rp: Column, ec: Column, rs: Column, gamma: float,
                  has_memory: Column | None) -> tuple[Column, Column]:
    usable = trial > 1 if has_memory is None else (trial > 1) & has_memory
    p_ec = F.when(usable, (ec + EC_PRIOR) / (rp + ec + rs + CONTEXT_PRIOR)).otherwise(F.lit(0.0))
    p_rp = F.lit(float(gamma)) * (rp + 1) / (rp + rs + 2)
    return p_ec, p_rp


def choice_states(df: DataFrame) -> DataFrame:
    """Per row: weighted points, whether a partner answer was heard yet, and the next decision."""
    heard = F.max(F.col("partner_response").isNotNull()).over(
        W.partitionBy(RUN, PERSON).orderBy(TRIAL).rowsBetween(W.unboundedPreceding, W.currentRow))
    return next_decision(strategy_points(df)).withColumn("has_memory", heard)


def strategy_propensity(df: DataFrame, alpha: float, gamma: float = 1.0) -> DataFrame:
    """Model probability of each decision at the participant's next trial."""
    s = choice_states(df)
    p = propensities(F.col(TRIAL), F.col("rp_pts"), F.col("ec_pts"), F.col("rs_pts"), F.lit(float(alpha)),
                     gamma, F.col("has_memory"))
    return s.select(RUN, PERSON, TRIAL, *CONDITION, "next", *[p[d].alias(f"p_{d}") for d in ("BN", "EC", "RP", "RS")])


def alpha_grid() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(ALPHA_STEPS)), lambda i: i / F.lit(10.0))


def propensity_likelihood(df: DataFrame, gamma: float = 1.0, by: Sequence[str] = CONDITION) -> DataFrame:
    """Log-likelihood of the observed next decisions for every alpha of the grid.

    With base = t + points, P(BN) is alpha / (base + alpha), and any other decision has
    base / (base + alpha) times a factor q which is free of alpha. So ln q is summed while
    the log is counted by base, and the grid is unfolded over that short table. Where q is so
    small that the floor could bite somewhere on the grid, q stays part of the count key.
    """
    s = choice_states(df).where(F.col("next").isNotNull())
    p_ec, p_rp = context_split(F.col(TRIAL), F.col("rp_pts"), F.col("ec_pts"), F.col("rs_pts"), gamma, F.col("has_memory"))
    q = (F.when(F.col("next") == "EC", p_ec).when(F.col("next") == "RP", (1 - p_ec) * p_rp)
         .when(F.col("next") == "RS", (1 - p_ec) * (1 - p_rp)))
    safe = F.col("q") >= FLOOR * (1 + ALPHA_STEPS / 10.0)
    counted = (s.select(*by, "next", (F.col(TRIAL) + F.col("rp_pts") + F.col("ec_pts") + F.col("rs_pts")).alias("base"), q.alias("q"))
               .groupBy(*by, "base", (F.col("next") == "BN").alias("new"), F.when(~safe, F.col("q")).alias("tiny"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(safe, F.ln("q")).otherwise(0.0)).alias("lnq")))
    alpha, base, n = F.col("alpha"), F.col("base"), F.col("n")
    floored = lambda p: n * F.ln(F.greatest(p, F.lit(FLOOR)))
    term = (F.when(F.col("new"), floored(alpha / (base + alpha)))
            .when(F.col("tiny").isNotNull(), floored(base / (base + alpha) * F.col("tiny")))
            .otherwise(n * F.ln(base / (base + alpha)) + F.col("lnq")))
    grid = counted.withColumn("alpha", F.explode(alpha_grid()))
    return grid.groupBy(*by, "alpha").agg(F.sum(term).alias("loglik"), F.sum("n").alias("n"))


def propensity_fit(df: DataFrame, gamma: float = 1.0, by: Sequence[str] = CONDITION) -> DataFrame:
    """Most likely alpha of each condition; ties go to the smaller one."""
    ll = propensity_likelihood(df, gamma, by).withColumn("loglik", F.round("loglik", 6))
    best = ll.groupBy(*by).agg(F.max(F.struct("loglik", (-F.col("alpha")).alias("neg"))).alias("b"))
    return best.select(*by, (-F.col("b.neg") + 0.0).alias("alpha"), F.col("b.loglik").alias("loglik"))


def propensity_sweep(df: DataFrame) -> DataFrame:
    """L2 distance, per run and alpha, between the observed share of new answers and the
    mean model chance of one. States are counted before the grid is unfolded."""
    s = choice_states(df).where(F.col("next").isNotNull())
    points = F.col("rp_pts") + F.col("ec_pts") + F.col("rs_pts")
    states = s.groupBy(RUN, *CONDITION, "next_trial", (F.col(TRIAL) + points).alias("base")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("next") == "BN").cast("int")).alias("bn"))
    grid = states.withColumn("alpha", F.explode(alpha_grid()))
    curve = grid.groupBy(RUN, *CONDITION, "next_trial", "alpha").agg(
        (F.sum("bn") / F.sum("n")).alias("observed"),
        (F.sum(F.col("n") * F.col("alpha") / (F.col("base") + F.col("alpha"))) / F.sum("n")).alias("model"))
    gap = F.col("observed") - F.col("model")
    return curve.groupBy(RUN, *CONDITION, "alpha").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))


def memory_since_reset(df: DataFrame) -> DataFrame:
    """Whether the partner's answer had been heard since the participant's last success.
    A success empties the memory down to the answer it was won with, so that a new segment
    opens with that trial."""
    before = W.partitionBy(RUN, PERSON).orderBy(TRIAL)
    upto = before.rowsBetween(W.unboundedPreceding, W.currentRow)
    won = F.sum("Points").over(upto)
    seg = df.withColumn("segment", won - F.col("Points"))
    # heard in the running segment, or the very answer which opened it
    heard = F.struct(F.col("segment").alias("seg"), F.col("partner_response").alias("answer"), F.lit(True).alias("asks"))
    opens = F.struct((F.col("segment") + 1).alias("seg"), F.col("partner_response").alias("answer"), F.lit(False).alias("asks"))
    rows = seg.where(F.col("partner_response").isNotNull()).select(
        RUN, PERSON, TRIAL, "Points",
        F.explode(F.array_compact(F.array(heard, F.when(F.col("Points") == 1, opens)))).alias("x"))
    first = F.min(TRIAL).over(W.partitionBy(RUN, PERSON, F.col("x.seg"), F.col("x.answer")))
    return (rows.withColumn("first_heard", first).where(F.col("x.asks"))
            .select(RUN, PERSON, TRIAL, "Points", F.col("x.seg").alias("segment"),
                    F.col("x.answer").alias("partner_response"),
                    (F.col("first_heard") < F.col(TRIAL)).alias("in_memory")))
