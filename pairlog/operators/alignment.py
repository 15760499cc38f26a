"""Alignment of response vectors with the segments of a reference narrative."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.scalar import fill_text, lookup
from ..functions.vectors import argmax, cosine, let, norm, softmax_tau
from ..session import ship, truncate_lineage
from .hypothesis import sem, welch_t_test

# Narrative component of each of the nine segments.
SEGMENT_GROUPS = {
    0: "Topic",
    1: "Causes",
    2: "Causes",
    3: "Effect",
    4: "1st Order Effects",
    5: "1st Order Effects",
    6: "2nd Order Effects",
    7: "2nd Order Effects",
    8: "2nd Order Effects",
}
MAX_SEGMENTS = 1000
TAU = 0.2


def segment_array(segments: DataFrame, limit: int = MAX_SEGMENTS) -> Column:
    """The segments, in order of idx, as one array with their norms: a narrative is a short
    list (checked), and travels with the plan instead of being cross joined."""
    few = segments.select("idx", F.transform("embedding", lambda x: x.cast("double")).alias("e")).limit(limit + 1)
    packed = few.withColumn("n", norm(F.col("e"))).agg(
        F.sort_array(F.collect_list(F.struct("idx", "e", "n"))).alias("a"))
    return packed.select(F.when(F.size("a") > limit, F.raise_error(F.lit(f"more than {limit} segments: use cosine_loadings_by_parts")))
                         .otherwise(F.col("a"))).scalar()


def map_segment_group(idx: Column | str, groups: Mapping[int, str] = SEGMENT_GROUPS) -> Column:
    return lookup(idx, groups)


def cosine_loadings(responses: DataFrame, segments: DataFrame, vector: str = "embedding", limit: int = MAX_SEGMENTS) -> DataFrame:
    """Add ``loading``: cosine of each response with every segment, in segment order. One
    narrow pass over the responses: no join, no shuffle, and no job before it runs. More than ``limit`` segments raise
    when it runs; ``cosine_loadings_by_parts`` takes any number."""
    v = F.col(vector)
    loading = let(norm(v), lambda length: F.transform("_segments", lambda s: cosine(v, s["e"], length, s["n"])))
    return responses.withColumn("_segments", segment_array(segments)).withColumn("loading", loading).drop("_segments")


def cosine_loadings_by_parts(responses: DataFrame, segments: DataFrame, vector: str = "embedding", limit: int = MAX_SEGMENTS) -> DataFrame:
    """The same for any number of segments: they go in arrays of ``limit``, which the responses meet by a join."""
    number = F.row_number().over(W.orderBy("idx")) - 1  # over the narrative alone
    packed = segments.select("idx", F.transform("embedding", lambda x: x.cast("double")).alias("e")) \
        .withColumn("_part", F.floor(number / limit).cast("int")).withColumn("n", norm(F.col("e"))) \
        .groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("idx", "e", "n"))).alias("_segments"))
    packed = truncate_lineage(packed, "segments")
    parts = packed.count()
    kept = truncate_lineage(responses.withColumn("_id", F.monotonically_increasing_id()), "responses")
    v = F.col(vector)
    loading = let(norm(v), lambda length: F.transform("_segments", lambda s: cosine(v, s["e"], length, s["n"])))
    found = kept.select("_id", v, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")).join(packed, "_part") \
        .select("_id", F.struct("_part", loading.alias("l")).alias("p")).groupBy("_id").agg(
            F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["l"])).alias("loading"))
    return kept.join(found, "_id").drop("_id")


def cosine_matrix(responses: DataFrame, segments: DataFrame, key: str = "vec_id") -> DataFrame:
    """Long similarity matrix (response, idx, similarity)."""
    # the outer generator spares the size check which would work the loading out twice
    return (cosine_loadings(responses, segments)
            .select(key, F.posexplode_outer("loading").alias("idx", "similarity")).where(F.col("idx").isNotNull()))


def narrative_alignment(responses: DataFrame, segments: DataFrame, tau: float = TAU,
                        groups: Mapping[int, str] = SEGMENT_GROUPS) -> DataFrame:
    """Loading, its softmax, and index, label and score of the best segment (first on ties). A narrative
    that is cut at other borders brings its own ``groups``."""
    d = cosine_loadings(responses, segments)
    return (d.withColumn("loading_normed", softmax_tau("loading", tau))
            .withColumn("segment_index", argmax("loading"))
            .withColumn("segment_label", map_segment_group("segment_index", groups))
            .withColumn("similarity_score", F.array_max("loading")))


def explode_loadings(aligned: DataFrame, skip: Sequence[str] = ("face",),
                     keys: Sequence[str] = ("Player", "Structure", "Content"), groups: Mapping[int, str] = SEGMENT_GROUPS) -> DataFrame:
    """One row per response and segment; conditions in ``skip`` are left out."""
    kept = aligned.where(~F.lower("Content").isin(list(skip)))
    long = kept.select(*keys, F.posexplode_outer("loading_normed").alias("idx", "score"))
    return long.where(F.col("idx").isNotNull()).withColumn("Group", map_segment_group("idx", groups))


def mean_loading(long: DataFrame) -> DataFrame:
    return long.groupBy("Player", "Structure", "Group").agg(F.avg("score").alias("score"))


def group_alignment(players: DataFrame) -> DataFrame:
    """Condition mean and standard error across participants."""
    return players.groupBy("Structure", "Group").agg(F.avg("score").alias("mean"), sem("score").alias("sem"))


def alignment_welch(players: DataFrame) -> DataFrame:
    return welch_t_test(players, "score", "Structure", "Homogeneous", "Spatial", ["Group"])


_MODELS: dict[tuple[str, str], Callable] = {}


def _loaded(load: Callable) -> Callable:
    """The model of ``load`` in this worker."""
    name = (load.__module__, load.__qualname__)
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """An embedder made of a user's model: ``load()`` gives a function from texts to a matrix with one row for each. It is
    called once in every Python worker and kept there (known by the name of ``load``), and the model sees whole
    Arrow batches."""
    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(load)
        for texts in batches:
            found = model(texts.tolist())
            yield pd.Series([row for row in np.asarray(found, dtype=np.float32)], index=texts.index, dtype=object)
    return embed


def letter_model() -> Callable[[list[str]], np.ndarray]:
    """A small model without weights: how often each letter a to z stands in a text, as a vector of unit length."""
    letters = np.arange(ord("a"), ord("z") + 1)

    def encode(texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), len(letters)))
        for i, text in enumerate(texts):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            counts[i] = np.bincount(points[points < 128], minlength=128)[letters]
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, length, out=counts, where=length > 0)
    return encode


def embed_text(df: DataFrame, text: str, output: str = "embedding", embedder=None, features: int = 256) -> DataFrame:
    """Text to vector. ``embedder`` is a user's pandas UDF (string -> array<float>), such as ``model_embedder`` makes;
    without one, hashed term frequencies weighted by inverse document frequency, of unit length."""
    if embedder is not None:
        ship(df.sparkSession)
        return df.withColumn(output, embedder(fill_text(text)))
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array
    steps = Pipeline(stages=[
        Tokenizer(inputCol="_text", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ])
    source = df.withColumn("_text", fill_text(text))
    out = steps.fit(source).transform(source)
    return (out.withColumn(output, vector_to_array("_unit", "float32"))
            .drop("_text", "_words", "_tf", "_tfidf", "_unit"))
