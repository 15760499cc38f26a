"""Causal claims of participants before and after the interaction: topics, counts, shifts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import as_col, lookup, signed_counts
from ..session import truncate_lineage
from .ranking import level_arrays, top_k_with_ties, unfold

AUTHOR = ("Structure", "Content", "Size", "random_id")
CONDITION = ("Structure", "Content")

# Topic names of the claim clusters, as used in the shift tests.
TOPICS = {
    -1: "No Cluster",
    0: "Nuclear Disaster",
    1: "Earthquake",
    2: "Energy Movement",
    3: "Radiation",
    4: "Disaster",
    5: "Effects",
    6: "Tsunami",
    7: "Damage",
    8: "Issues",
    9: "Change (Loss)",
    10: "Health Issues",
    11: "Waves",
    12: "Terrible Event",
    13: "Destruction",
    14: "Displacement",
    15: "Earthquake",
    16: "Incident",
    17: "Natural Disaster",
    18: "Tsunami*",
    19: "Cancer",
}
# The names which differ in the published topic table.
TABLE_TOPICS = {**TOPICS, 2: "Energy Shortage", 15: "(Tohoku) Earthquake", 18: "Tsunami (mispelt)"}
# Redundant topics and the one they are merged in.
MERGED_TOPICS = {
    "Tsunami*": "Tsunami",
    "Waves": "Tsunami",
    "Damage": "Nuclear Disaster",
    "Cancer": "Health Issues",
}
# The cause-effect relations of the causal model.
MODEL_RELATIONS = [
    ("Earthquake", "Tsunami"),
    ("Tsunami", "Nuclear Disaster"),
    ("Nuclear Disaster", "Change (Loss)"),
    ("Change (Loss)", "Energy Movement"),
    ("Nuclear Disaster", "Radiation"),
    ("Radiation", "Health Issues"),
    ("Natural Disaster", "Nuclear Disaster"),
    ("Tsunami", "Destruction"),
]
MAX_LEVELS = 1000
MAX_CELLS = 100_000


def map_topics(cluster: Column | str, table: Mapping[int, str] = TOPICS) -> Column:
    return lookup(cluster, table)


def collapse_topics(topic: Column | str) -> Column:
    return F.coalesce(lookup(topic, MERGED_TOPICS), as_col(topic))


def with_topics(claims: DataFrame) -> DataFrame:
    return (claims.withColumn("cause_topic", collapse_topics(map_topics("cause_cluster")))
            .withColumn("effect_topic", collapse_topics(map_topics("effect_cluster"))))


def claims_with_authors(claims: DataFrame, tweets: DataFrame) -> DataFrame:
    """Claims joined to every author of the same text: many to many on purpose."""
    return claims.join(tweets.withColumnRenamed("Response", "text"), "text")


def claim_counts(claims: DataFrame, tweets: DataFrame) -> DataFrame:
    """Claims per participant and phase. The claims of a text are counted before the join,
    so a text copied many times on both sides never multiplies out."""
    per_text = claims.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    hits = tweets.join(per_text, F.col("Response") == F.col("text"))
    return hits.groupBy(*AUTHOR, "Phase").agg(F.sum("n").alias("n"))


def missing_participants(tweets: DataFrame, counts: DataFrame) -> DataFrame:
    """Participants who wrote a text in a phase but made no claim there, with n = 0."""
    keys = [*AUTHOR, "Phase"]
    return tweets.select(*keys).join(counts, keys, "left_anti").withColumn("n", F.lit(0).cast("bigint"))


def claim_counts_filled(claims: DataFrame, tweets: DataFrame) -> DataFrame:
    counts = claim_counts(claims, tweets)
    return counts.unionByName(missing_participants(tweets, counts), allowMissingColumns=True)


def prepost_difference(counts: DataFrame, keys: Sequence[str] = AUTHOR, value: str = "n") -> DataFrame:
    """post - pre per participant; participants who lack a phase drop out."""
    side = lambda phase: F.max(F.when(F.col("Phase") == phase, F.col(value)))
    return (counts.groupBy(*keys).agg((side("post") - side("pre")).alias("difference"))
            .where(F.col("difference").isNotNull()))


def sign_summary(diffs: DataFrame, keys: Sequence[str] = CONDITION) -> DataFrame:
    d = F.col("difference")
    return diffs.groupBy(*keys).agg(
        F.count_if(d > 0).alias("positive_differences"), F.count_if(d == 0).alias("zero_differences"),
        F.count_if(d < 0).alias("negative_differences"), F.count(d).alias("total_differences"))


def attach_summary(detail: DataFrame, summary: DataFrame, keys: Sequence[str] = CONDITION) -> DataFrame:
    return detail.join(summary, list(keys), "left")


def difference_stats(diffs: DataFrame, keys: Sequence[str] = CONDITION) -> DataFrame:
    d = F.col("difference")
    stats = diffs.groupBy(*keys).agg(
        F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"), F.count(d).alias("n_difference"))
    return stats.withColumn("se_difference", F.col("sd_difference") / F.sqrt("n_difference"))


def difference_histogram(diffs: DataFrame, width: float = 1.0, origin: float = -0.5,
                         keys: Sequence[str] = CONDITION) -> DataFrame:
    """Counts per bin; a bin is named by its lower edge."""
    bin_ = F.floor((F.col("difference") - origin) / width) * width + origin
    return diffs.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def relation_counts(claims: DataFrame) -> DataFrame:
    """Claims per participant, phase, cause topic and effect topic."""
    return claims.groupBy(*AUTHOR, "Phase", "cause_topic", "effect_topic").agg(F.count(F.lit(1)).alias("count"))


def _cells(keys: Sequence[str], *rest: Column, bound: Sequence[Column] = ()) -> Column:
    """Array of structs with every combination of the level arrays named ``keys``."""
    head, tail = keys[0], keys[1:]
    if tail:
        return F.flatten(F.transform(head, lambda x: _cells(tail, *rest, bound=[*bound, x.alias(head)])))
    return F.transform(head, lambda x: F.struct(*bound, x.alias(head), *rest))


def complete(counts: DataFrame, anchor: Sequence[str], keys: Sequence[str], value: str,
             max_levels: int = MAX_LEVELS, max_cells: int = MAX_CELLS) -> DataFrame:
    """Every combination of the observed ``anchor`` rows and the observed levels of each key,
    absent ones with value 0. NULL is no level, but observed rows that have it stay.

    Keys mostly have few levels; the anchor may be of any size. Beyond ``max_levels`` levels or
    ``max_cells`` cells a row the table is unfolded key by key and joined, with the same result. Otherwise
    only the observed counts are shuffled, by anchor. The zero cells come from one short array
    after the shuffle, and the sum which merges both keeps to the anchor's partitioning. The
    counts are written first: the levels are looked up before the cells are made.
    """
    counts = truncate_lineage(counts.select(*anchor, *keys, value), "counts")
    sizes = counts.agg(*[F.count_distinct(k).alias(k) for k in keys]).first()
    if sum(sizes) > max_levels or math.prod(sizes) > max_cells:
        cells = counts.select(*anchor).distinct()
        for k in keys:
            cells = unfold(cells, counts.where(F.col(k).isNotNull()).select(k).distinct())
        summed = counts.groupBy(*anchor, *keys).agg(F.sum(value).alias(value))
        same = [cells[c].eqNullSafe(summed[c]) for c in [*anchor, *keys]]
        full = cells.join(summed, same, "left").select(
            *[cells[c] for c in [*anchor, *keys]], F.coalesce(summed[value], F.lit(0)).cast("bigint").alias(value))
        odd = summed.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
        return full.unionByName(odd.withColumn(value, F.col(value).cast("bigint")))
    levels = level_arrays(counts, keys, max_levels)
    zero = F.lit(0).cast("bigint").alias("_v")
    product = F.lit(1)
    for k in keys:
        product = product * F.size(k)
    zeros = levels.select(F.when(product > max_cells, F.raise_error(F.lit(f"more than {max_cells} cells per row")))
                          .otherwise(_cells(keys, zero))).scalar()
    seen = F.collect_list(F.struct(*keys, F.col(value).cast("bigint").alias("_v")))
    packed = counts.groupBy(*anchor).agg(seen.alias("_seen")).withColumn("_zeros", zeros)
    rows = packed.select(*anchor, F.explode(F.concat("_seen", "_zeros")).alias("_c"))
    return (rows.select(*anchor, *[F.col(f"_c.{k}").alias(k) for k in keys], F.col("_c._v").alias("_v"))
            .groupBy(*anchor, *keys).agg(F.sum("_v").alias(value)))


def relation_shifts(claims: DataFrame, weight: str | None = None) -> DataFrame:
    """post - pre per participant and relation, over the relations the participant used at
    all, from claim rows or from counted ones (``weight``). All others are zero by definition;
    the tests below count them without building them (``complete`` builds them where the full
    table itself is wanted)."""
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    signed = F.when(F.col("Phase") == "post", n).otherwise(-n)
    return claims.groupBy(*AUTHOR, "cause_topic", "effect_topic").agg(F.sum(signed).alias("difference"))


def relation_moments(shifts: DataFrame) -> DataFrame:
    """n, Σx and Σx² of the shifts per condition and relation, zeros included: n is the
    condition's participants, and zeros add nothing to either sum. Relations not used in a
    condition but used elsewhere are all-zero rows of it.

    One pass over the shifts: a participant's few relations meet in one row, where the first
    stands for the participant, so that summing the firsts counts people. What follows works
    on the table of conditions and relations alone."""
    own = F.collect_list(F.struct("cause_topic", "effect_topic", "difference"))
    rows = (shifts.groupBy(*AUTHOR).agg(own.alias("_own"))
            .select(*CONDITION, F.posexplode("_own").alias("_pos", "_r")))
    d = F.col("_r.difference")
    sums = rows.groupBy(*CONDITION, F.col("_r.cause_topic").alias("cause_topic"), F.col("_r.effect_topic").alias("effect_topic")).agg(
        F.sum(d).alias("sx"), F.sum(d * d).alias("sxx"), F.sum((F.col("_pos") == 0).cast("bigint")).alias("people"))
    sums = truncate_lineage(sums, "relation-sums")  # one row per condition and relation; read several times below
    people = sums.groupBy(*CONDITION).agg(F.sum("people").alias("n"))
    return _with_all_relations(people, sums).select(
        *CONDITION, "cause_topic", "effect_topic", "n", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("sx", "sxx")])


def _with_all_relations(conditions: DataFrame, table: DataFrame) -> DataFrame:
    """``conditions`` with every cause and effect of ``table`` (a written one), and the table's other columns
    where it has the relation. The result has a row for every cause and effect, so that the lists of both are short
    against it; they are found within the plan."""
    keys = [*CONDITION, "cause_topic", "effect_topic"]
    cells = conditions
    for key in ("cause_topic", "effect_topic"):
        cells = cells.withColumn(key, F.explode(table.agg(F.collect_set(key)).scalar()))
    return cells.join(table.drop("people"), keys, "left")


def unique_signers(shifts: DataFrame) -> DataFrame:
    """Distinct participants with a rise and with a fall per condition and relation, zeros for relations
    which nobody used in a condition. Flags are merged per participant first, so that the count needs no
    distinct over the whole relation. Writes its short table once."""
    person = shifts.groupBy(*CONDITION, "cause_topic", "effect_topic", "random_id").agg(
        F.max((F.col("difference") > 0).cast("int")).alias("up"),
        F.max((F.col("difference") < 0).cast("int")).alias("down"))
    used = truncate_lineage(person.groupBy(*CONDITION, "cause_topic", "effect_topic").agg(
        F.sum("up").alias("up"), F.sum("down").alias("down")), "signers")
    full = _with_all_relations(used.select(*CONDITION).distinct(), used)
    return full.select(*CONDITION, "cause_topic", "effect_topic", F.coalesce("up", F.lit(0)).alias("unique_positive_count"),
                       F.coalesce("down", F.lit(0)).alias("unique_negative_count"))


def signers_total(signers: DataFrame) -> DataFrame:
    return signers.groupBy(*CONDITION).agg(
        F.sum("unique_positive_count").alias("total_unique_positive_count"),
        F.sum("unique_negative_count").alias("total_unique_negative_count"))


def relation_filter(relations: Sequence[tuple[str, str]] = MODEL_RELATIONS, cause: str = "cause_topic",
                    effect: str = "effect_topic") -> Column:
    """Membership in a short literal list of relations, as one set lookup."""
    pair = F.concat_ws("\u0001", F.col(cause), F.col(effect))
    return pair.isin(["\u0001".join(r) for r in relations])


def cluster_counts(claims: DataFrame) -> DataFrame:
    """Claims per cluster as a cause and as an effect, merged on the cluster id; both counts
    come from one pass (NULL where a cluster never takes that role)."""
    side = claims.select(F.explode(F.array(
        F.struct(F.col("cause_cluster").alias("ID"), F.lit(1).alias("c"), F.lit(None).cast("int").alias("e")),
        F.struct(F.col("effect_cluster").alias("ID"), F.lit(None).cast("int").alias("c"), F.lit(1).alias("e")),
    )).alias("x"))
    return side.groupBy(F.col("x.ID").alias("ID")).agg(
        F.sum("x.c").alias("cause_counts"), F.sum("x.e").alias("effect_counts"))


def merge_cause_effect(causes: DataFrame, effects: DataFrame, key: str = "ID") -> DataFrame:
    """Full outer join of two count tables on the cluster id."""
    return causes.join(effects, key, "full")


def diverging_table(clusters: DataFrame) -> DataFrame:
    """Causes counted below zero, with the topic name."""
    return clusters.select("ID", signed_counts("cause_counts", negative=True).alias("cause_counts"), "effect_counts",
                           map_topics("ID", TABLE_TOPICS).alias("topic_label"))


def top_entities(claims: DataFrame, cluster: str, entity: str, k: int = 5) -> DataFrame:
    """Most frequent entity strings per cluster, ties kept."""
    counts = claims.groupBy(cluster, entity).agg(F.count(F.lit(1)).alias("frequency"))
    return top_k_with_ties(counts, "frequency", k, partition=[cluster])

