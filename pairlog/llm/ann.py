"""Nearest neighbours by collision counting over single-projection sorted arrays.

The rows are dealt by a hash of their id into blocks of about ``BLOCK`` rows, the queries into chunks; a
task holds one block and one chunk. In a block every random projection has its own array of projected
values, sorted. A query opens a window around its own projected value in every array and widens all
windows by the same factor (virtual rehashing) until enough rows lie in at least ``threshold`` of the
windows; those rows are verified with exact inner products. A row lies in a window if its place in the
sorted array lies between the window's ends. The best ``k`` of every block meet in one ranking per query, cut down before the shuffle.

Largest inner product is made a nearest-point search by the usual lift: one coordinate completes every
vector to the largest norm. Every row is indexed and every query runs against all blocks; recall is
measured in the tests and in the README.

Edge cases: rows with a null id, and vectors that are null, zero, hold null or non-finite components, or
do not have the table's most frequent dimension, take no part; of rows with one id the smallest vector
counts; ties go to the smaller id; with fewer candidates than ``k`` all are given; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 8192
LEAST_BLOCKS = 8
PROJECTIONS = 64
#: part of the windows a row must lie in; windows' first half-width in standard deviations; widening factor
THRESHOLD, START, FACTOR = 0.75, 0.62, 1.12
#: part of a block that is verified at least, and a number for small blocks
VERIFIED, LEAST_VERIFIED = 0.15, 400


class Block:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, seed: int = 11):
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        self.ids, self.vectors, self.norm = ids[first], np.ascontiguousarray(vectors[first]), norm
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, PROJECTIONS))
        lift = np.sqrt(np.maximum(norm * norm - (self.vectors ** 2).sum(axis=1), 0))
        projected = self.vectors @ self.directions[:-1] + lift[:, None] * self.directions[-1]
        self.sorted = np.sort(projected, axis=0).T.copy()
        # a row's place in each sorted array
        place = np.argsort(np.argsort(projected, axis=0, kind="stable"), axis=0)
        self.place = place.T.astype(np.uint16 if len(self.ids) < 1 << 16 else np.uint32).copy()
        self.width = float(projected.std(axis=0).mean()) or 1.0

    def candidates(self, query: np.ndarray) -> np.ndarray:
        n = len(self.ids)
        need = min(n, max(LEAST_VERIFIED, int(VERIFIED * n)))
        centre = (query * (self.norm / np.sqrt((query ** 2).sum()))) @ self.directions[:-1]
        half, hits = START * self.width, int(np.ceil(THRESHOLD * PROJECTIONS))
        kind = self.place.dtype
        while True:
            low = np.array([s.searchsorted(c - half) for s, c in zip(self.sorted, centre)])
            high = np.array([s.searchsorted(c + half, side="right") for s, c in zip(self.sorted, centre)])
            # inside a window: low <= place < high, in unsigned arithmetic
            inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
            if n > np.iinfo(kind).max:
                inside |= (high - low >= n)[:, None]
            found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= hits)
            if len(found) >= need or (high - low).min() == n:
                return found
            half *= FACTOR

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best ``k`` verified rows other than the query's own."""
        near = self.candidates(query)
        near = near[self.ids[near] != own]
        # row by row in one fixed order of additions, so that equal vectors get equal scores
        score = (self.vectors[near] * query).sum(axis=1)
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][best], score[best]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and vector (doubles) of the rows that take part, but for the dimension."""
    vector = F.col(f"`{vec_col}`").cast("array<double>")
    size = lambda x: F.abs(F.coalesce(x, F.lit(float("nan"))))
    return vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: size(x) < float("inf")) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on the column ``id``. One job counts the
    rows and finds the dimension and the largest norm."""
    rows = usable(vectors, id_col, vec_col)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    most = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2"), F.count(F.when(is_query, 1)).alias("q")) \
        .orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id bigint, vec_id bigint, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == most["d"])
    blocks, parts = max(LEAST_BLOCKS, -(-most["n"] // block)), max(1, -(-most["q"] // block))
    norm = float(np.sqrt(most["norm2"]))

    def deal(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    base = rows.select("id", "v", deal(blocks, 1).alias("block"), every(parts).alias("part"))
    asked = rows.where(is_query).select("id", "v", deal(parts, 2).alias("part"), every(blocks).alias("block"))

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            index = Block(left["id"].to_numpy(), matrix(left), norm)
            ids, queries = right["id"].to_numpy(), matrix(right)
            order = np.lexsort((*queries.T[::-1], ids))
            for i in order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])].tolist():
                found, score = index.search(int(ids[i]), queries[i], k)
                out.append((np.full(len(found), ids[i]), found, score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    found = base.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(work, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy().reshape(table.num_rows, -1)
