"""Scalar column functions: run codes, text rules, labels, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Run codes, for example f20h1.
RUN_CODE_PATTERN = r"^([fh])(\d+)([sh])(\d+)"
# Answers a participant may not give.
BANNED_HASHTAGS = ["fukushima", "japan"]
# Text and hashtag length limits of the survey.
TEXT_MIN, TEXT_MAX = 50, 280
HASHTAG_MIN, HASHTAG_MAX = 1, 35
# Wording of the seven-point agreement scale.
RATING_LABELS = [
    "Strongly disagree (1)",
    "Disagree (2)",
    "Moderately disagree (3)",
    "Neither agree nor disagree (4)",
    "Moderately agree (5)",
    "Agree (6)",
    "Strongly agree (7)",
]
# The five rated impressions.
IMPRESSIONS = ["competence", "dominance", "maturity", "likeability", "trustworthiness"]
DECISIONS = ["BN", "EC", "RS", "RP"]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_run_code(code: Column | str) -> dict[str, Column]:
    """Content, Size, Structure and Run of a run code; all NULL when it does not match."""
    code = as_col(code)
    part = lambda i: F.nullif(F.regexp_extract(code, RUN_CODE_PATTERN, i), F.lit(""))
    return {
        "Content": F.when(part(1) == "f", "Face").when(part(1) == "h", "Hashtag"),
        "Size": part(2).try_cast("int"),
        "Structure": F.when(part(3) == "h", "Homogeneous").when(part(3) == "s", "Spatial"),
        "Run": part(4).try_cast("int"),
    }


def make_ssid(*cols: Column | str) -> Column:
    return F.concat_ws("_", *[as_col(c).cast("string") for c in cols])


def split_identifier(identifier: Column | str, names: Sequence[str], sep: str = "_") -> dict[str, Column]:
    """Inverse of a joined identifier; absent parts are NULL, all parts are strings."""
    parts = F.split(as_col(identifier), sep)
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(names)}


def clean_hashtag(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(as_col(c)), "[^a-zA-Z0-9_]", ""))


def text_violations(c: Column | str, low: int = TEXT_MIN, high: int = TEXT_MAX) -> Column:
    """Array of the rules a free text breaks; an empty array means it is valid."""
    n = F.length(F.coalesce(as_col(c), F.lit("")))
    return F.array_compact(F.array(
        F.when(n < low, F.lit("too_short")),
        F.when(n > high, F.lit("too_long")),
    ))


def hashtag_violations(c: Column | str, low: int = HASHTAG_MIN, high: int = HASHTAG_MAX) -> Column:
    raw = F.coalesce(as_col(c), F.lit(""))
    n = F.length(raw)
    return F.array_compact(F.array(
        F.when(clean_hashtag(raw).isin(BANNED_HASHTAGS), F.lit("banned")),
        F.when(n < low, F.lit("too_short")),
        F.when(n > high, F.lit("too_long")),
        F.when(raw.contains(" "), F.lit("has_space")),
    ))


def has_duplicates(tags: Column | str) -> Column:
    """True when an array of answers repeats one of them (NULLs do not count)."""
    present = F.array_compact(as_col(tags))
    return F.size(F.array_distinct(present)) < F.size(present)


def fill_text(c: Column | str) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def lookup(c: Column | str, mapping: Mapping) -> Column:
    """Map through a small literal dictionary; unmapped keys give NULL."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), as_col(c))


def rating_label(c: Column | str) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in RATING_LABELS]), F.nullif(as_col(c), F.lit(0)))


def rated_impression(cols: Sequence[str] = IMPRESSIONS) -> Column:
    """Name of the impression which carries a rating (the last one, should there be several)."""
    return F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in reversed(cols)])


def rated_value(cols: Sequence[str] = IMPRESSIONS) -> Column:
    return F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in reversed(cols)])


def significance_stars(p: Column | str) -> Column:
    p = as_col(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .when(p.isNotNull(), ""))


def signed_counts(c: Column | str, negative: bool) -> Column:
    return -as_col(c) if negative else as_col(c)


def factor_order(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based sort key of a category; NULL for a value outside ``levels``."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), as_col(c)), F.lit(0)).cast("int")


def wrap_round(c: Column | str, n: int = 40) -> Column:
    """Trial number of a longer run mapped back on the first ``n`` trials, 1-based."""
    return (F.pmod(as_col(c) - 1, F.lit(n)) + 1).cast("int")


def log_base(c: Column | str, base: str | float = "e") -> Column:
    """Logarithm as R and numpy have it: minus infinity at zero (Spark alone gives NULL), NaN
    below it."""
    c = as_col(c)
    log = F.ln(c) if base == "e" else F.log2(c) if float(base) == 2.0 else F.ln(c) / F.ln(F.lit(float(base)))
    return F.when(c > 0, log).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def parse_recorded_date(c: Column | str) -> Column:
    """'5/22/2024 12:30' to a timestamp without zone; dirty input gives NULL."""
    return F.try_to_timestamp(as_col(c), F.lit("M/d/yyyy H:mm")).cast("timestamp_ntz")


def json_field(c: Column | str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(as_col(c), path).try_cast(kind)
