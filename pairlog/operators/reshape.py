"""Long and wide forms, unions, curves side by side, edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import split_identifier
from .ranking import bucketed_row_number


def union_tables(*frames: DataFrame) -> DataFrame:
    """Rows of all tables; columns absent from one are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def pivot_wide(df: DataFrame, index: Sequence[str], columns: str, values: str, levels: Sequence) -> DataFrame:
    """One column per level. Two rows for one cell raise, as they do in a pandas pivot."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate cell in pivot"))).otherwise(F.max(values))
    cells = df.groupBy(*index, columns).agg(cell.alias("_v"))
    wide = cells.groupBy(*index).pivot(columns, list(levels)).agg(F.max("_v"))
    return wide.withColumnsRenamed({str(x): f"{columns}_{x}" for x in levels})


def pivot_long(wide: DataFrame, ids: Sequence[str], name: str = "Model Group", value: str = "Entropy") -> DataFrame:
    cols = [c for c in wide.columns if c not in ids]
    return wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in cols], name, value)


def curves_long(wide: DataFrame) -> DataFrame:
    """Wide curves to (Trial, Model, Structure, Content, Entropy)."""
    long = pivot_long(wide, ["Trial"])
    parts = split_identifier("Model Group", ["Model", "Structure", "Content"], sep=" ")
    return long.select("Trial", *[c.alias(n) for n, c in parts.items()], "Entropy")


def duplicate_reference_rows(long: DataFrame, reference: str, models: Sequence[str]) -> DataFrame:
    """Copy the reference rows into each model's facet; Marking tells the two apart."""
    is_ref = F.col("Model") == reference
    facets = F.when(is_ref, F.array(*[F.lit(m) for m in models])).otherwise(F.array("Model"))
    marking = F.when(is_ref, "Human").otherwise("Simulation")
    return long.withColumn("Marking", marking).withColumn("Model", F.explode(facets))


def prepost_long(wide: DataFrame, keys: Sequence[str] = ("random_id",)) -> DataFrame:
    """tweet1/tweet2 to one row per phase."""
    return wide.select(*keys, F.explode(F.array(
        F.struct(F.lit("pre").alias("Phase"), F.col("tweet1").alias("Response")),
        F.struct(F.lit("post").alias("Phase"), F.col("tweet2").alias("Response")),
    )).alias("r")).select(*keys, "r.Phase", "r.Response").where(F.col("Response").isNotNull())


def hashtags_long(wide: DataFrame, keys: Sequence[str] = ("random_id",)) -> DataFrame:
    """Columns hashtag<phase>_<position> to (Phase, position, hashtag); empty cells dropped."""
    cols = [c for c in wide.columns if c.startswith("hashtag")]
    long = wide.unpivot([F.col(k) for k in keys], [F.col(c) for c in cols], "slot", "hashtag")
    phase = F.when(F.regexp_extract("slot", r"^hashtag(\d)_", 1) == "1", "pre").otherwise("post")
    return (long.where(F.col("hashtag").isNotNull())
            .select(*keys, phase.alias("Phase"),
                    F.regexp_extract("slot", r"_(\d+)$", 1).cast("int").alias("position"), "hashtag"))


def edge_canonical(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Undirected edges once each, smaller end first, no self loops."""
    return (edges.where(F.col(u) != F.col(v))
            .select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())


def adjacency_to_edges(matrix: DataFrame, node: str = "node", row: str = "row") -> DataFrame:
    """0/1 matrix rows to directed (node, neighbour) pairs, both 0-based."""
    cells = matrix.select(F.col(node).alias("u"), F.posexplode(row).alias("v", "x"))
    return cells.where(F.col("x") == 1).select("u", "v")


def neighbour_lists(edges: DataFrame, part_size: int = 1000, block: int = 4096) -> DataFrame:
    """Adjacency lists in ascending order. A node with very many neighbours gets several rows,
    numbered by ``part``, so that no list outgrows ``part_size``."""
    placed = bucketed_row_number(edges, F.floor(F.col("v") / block), ["v"], ["u"])
    parts = placed.groupBy("u", F.floor(F.col("pos") / part_size).cast("int").alias("part"))
    return parts.agg(F.sort_array(F.collect_list("v")).alias("neighbours"))


def drop_na(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols) if cols else None)


def filter_condition(df: DataFrame, **equal: str | Sequence) -> DataFrame:
    """Equality or membership per column; literal predicates reach the scan."""
    for col, want in equal.items():
        keep: Column = F.col(col) == want if isinstance(want, (str, int, float)) else F.col(col).isin(list(want))
        df = df.where(keep)
    return df
