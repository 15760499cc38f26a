"""Line de-duplication by the number of sites a line spreads over.

Every line's distinct sites are counted by a HyperLogLog sketch, merged by aggregation (built-in
functions only). Lines whose estimate lies near the threshold get an exact distinct count. A line on
``min_sites`` sites or more is boilerplate: it stays where it stands first (smallest document id, then
place) and goes everywhere else.

Lines are what line ends separate, as they stand; lines shorter than ``min_chars`` never go. Scale: the
text is shuffled once, with the lists of lines to drop; counting shuffles hashes and sketches of a few
bytes; a line that a third of all rows hold is one sketch per task, and its rows are dropped by an equi
join that adaptive execution splits.

Edge cases: a null text stays null, an empty one empty; a null site is a site of its own; null ids come
before others; rows that repeat id and text share their fate; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import fresh

MIN_SITES = 5
MIN_CHARS = 12
LOG_K = 12
#: Estimates within this factor of the threshold are counted exactly; the sketch's standard error is 1.6 %
#: and it is exact for small sets, so what lies outside is certain for all purposes.
NEAR = 1.5


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """h (hash of the line), site, doc, pos and row (a key of the document) of every line that counts."""
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    site = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`").cast("string")), F.lit(""))
    return docs.select(doc.alias("doc"), F.xxhash64(doc, text).alias("row"), site.alias("site"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "line")) \
        .where(F.length("line") >= min_chars).select(F.xxhash64("line").alias("h"), "site", "doc", "pos", "row")


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """h and the first place (doc, pos, row) of every line on at least ``min_sites`` sites."""
    spread = found.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", LOG_K).alias("sketch"),
        F.min(F.struct("doc", "pos", "row")).alias("first")) \
        .where(F.col("n") >= min_sites).select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    close = (F.col("sites") >= min_sites / near) & (F.col("sites") <= min_sites * near)
    exact = found.join(spread.where(close).select("h"), "h").select("h", "site").distinct() \
        .groupBy("h").agg(F.count(F.lit(1)).alias("exact"))
    return spread.join(exact, "h", "left").where(
        F.coalesce("exact", "sites") >= min_sites).select("h", "first")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                       text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with their text cleaned, and n_removed (lines dropped). A column of that name
    is replaced."""
    found = lines(docs, id_col, text_col, site_col, min_chars)
    bad = boilerplate(found, min_sites)
    here = F.struct("doc", "pos", "row")
    drop = found.join(bad, "h").where(~here.eqNullSafe(F.col("first"))) \
        .groupBy("row").agg(F.collect_set("pos").alias("drop"))
    # all but the text travels as one struct, so that columns may have any names
    text, doc = F.col(f"`{text_col}`"), F.struct(F.lit(0).alias(fresh("_", docs.columns)), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    keyed = docs.select(doc.alias("doc"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row")).join(drop, "row", "left") \
        .withColumn("lines", F.when(F.col("drop").isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    cleaned = F.array_join(F.transform(F.array_sort(kept), lambda i: F.get("lines", i)), "\n")
    return keyed.select(
        *[F.when(F.col("drop").isNull(), F.col("text")).otherwise(cleaned).alias(c) if c == text_col
          else F.col("doc").getField(c).alias(c) for c in docs.columns if c != "n_removed"],
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_removed"))


def sql(docs: str = "documents", columns: str = "doc_id", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> str:
    """The same in SQL with exact counts: ``columns`` of each row, its clean text, and n_removed."""
    return f"""
WITH numbered AS (SELECT *, row_number() OVER () AS row_no FROM {docs}),
cut AS (SELECT *, string_split(text, chr(10)) AS parts FROM numbered),
places AS (SELECT row_no, doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM cut),
found AS (SELECT row_no, doc_id, source, pos, parts[pos] AS line FROM places WHERE length(parts[pos]) >= {min_chars}),
bad AS (SELECT line, min((doc_id, pos)) AS first FROM found GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
gone AS (SELECT row_no, list(pos) AS drops, count(*) AS n FROM found JOIN bad USING (line) WHERE (doc_id, pos) <> first GROUP BY row_no)
SELECT {columns}, CASE WHEN drops IS NULL THEN text ELSE array_to_string(
    [parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(drops, i)], chr(10)) END AS text,
  coalesce(n, 0) AS n_removed
FROM cut LEFT JOIN gone USING (row_no)"""
