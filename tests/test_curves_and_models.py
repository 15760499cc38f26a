import math
import random

import pytest
from pyspark.sql import functions as F

from pairlog.operators import alignment as A, curves as V, models as M, reshape as R


def test_curve_distance_with_an_absent_curve(spark):
    target = spark.createDataFrame([("S", "F", 1, 3.0), ("S", "F", 2, 4.0)], "Structure string, Content string, TrialNumber int, target double")
    curves = spark.createDataFrame([("r", "S", "F", 1, 3.0), ("r", "S", "F", 2, 4.5), ("empty", "S", "F", 9, 1.0)],
                                   "Identifier string, Structure string, Content string, TrialNumber int, value double")
    got = {r.Identifier: r.distance for r in V.curve_distance(curves, target, ["Identifier"], ["Structure", "Content"]).collect()}
    assert got == {"r": pytest.approx(0.5), "empty": pytest.approx(5.0)}


def test_select_alpha(spark):
    rows = [("S", "F", 0.0, 1.0), ("S", "F", 0.1, 0.5), ("S", "F", 0.2, 0.8), ("H", "F", 0.0, 2.0), ("H", "F", 0.1, 1.6), ("H", "F", 0.2, 1.2)]
    d = spark.createDataFrame(rows, "Structure string, Content string, alpha double, distance double")
    r = V.select_alpha(d).first()
    # means of (1, .5, .8) and (1, .8, .6) are (1, .65, .7)
    assert r.alpha == 0.1 and r.normalized == pytest.approx(0.65)


def test_facets_and_gaps(spark):
    wide = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.8, 0.6)], ["Trial", "Human Spatial Face", "Sim Spatial Face"])
    long = R.curves_long(wide)
    both = R.duplicate_reference_rows(long, "Human", ["Sim", "Other"])
    assert both.count() == 2 + 4 and both.where("Marking = 'Human' and Model = 'Other'").count() == 2
    g = V.mean_abs_gap(V.difference_curves(long, "Human")).first()
    assert g.mean_gap == pytest.approx(0.3) and g.l2_gap == pytest.approx(math.sqrt(0.2))


def fake_log(spark, n=4000):
    rng = random.Random(8)
    rows = []
    for _ in range(n):
        t, s, c, d = rng.randrange(1, 41), rng.choice(["Homogeneous", "Spatial"]), rng.choice(["Face", "Hashtag"]), rng.choice(["BN", "EC", "RS", "RP"])
        eta = -1 + 0.04 * t + 0.8 * (s == "Spatial")
        y = int(rng.random() < 1 / (1 + math.exp(-eta)))
        rows.append((t, s, c, rng.choice([20, 50]), d, y, 0.5 - 0.02 * t + 0.3 * (c == "Hashtag")))
    return spark.createDataFrame(rows, "TrialNumber int, Structure string, Content string, Size int, DecisionType string, Coordinate int, EntropyDifference double")


def test_fits_recover_coefficients(spark):
    log = fake_log(spark)
    fit = {r.term: r.estimate for r in M.fit_coordination(log).collect()}
    assert set(fit) == {"Intercept", *M.INTERACTED}
    assert fit["TrialNumber"] == pytest.approx(0.04, abs=0.02) and fit["Spatial"] == pytest.approx(0.8, abs=0.45)
    gauss = {r.term: r.estimate for r in M.fit_entropy(log).collect()}
    assert gauss["TrialNumber"] == pytest.approx(-0.02, abs=1e-3) and gauss["Hashtag"] == pytest.approx(0.3, abs=1e-2)
    kinds = M.fit_decision_type(log)
    assert {r.decision for r in kinds.collect()} == {"EC", "RS", "RP"} and kinds.count() == 3 * (1 + len(M.SAMPLED))
    by_decision = M.fit_decision_coordination(log)
    effects = M.conditional_effects(log, by_decision, M.BY_DECISION).collect()
    assert len(effects) == 8 and all(0 < r.estimate < 1 for r in effects)


def test_dominance_fit(spark):
    rows = [(t, s, c, 20, 20, 1 / (1 + math.exp(1 - 0.05 * t))) for t in range(1, 41) for s in ("Homogeneous", "Spatial") for c in ("Face", "Hashtag")]
    d = spark.createDataFrame(rows, "TrialNumber int, Structure string, Content string, Size int, NumRespondents int, DomResponseProp double")
    fit = {r.term: r.estimate for r in M.fit_dominance(d).collect()}
    assert fit["TrialNumber"] == pytest.approx(0.05, abs=5e-3)


def test_design_has_treatment_coding(spark):
    d = spark.createDataFrame([(3, "Spatial", "Hashtag", 20), (3, "Homogeneous", "Face", 20)], "TrialNumber int, Structure string, Content string, Size int")
    x = [list(r.features.toArray()) for r in M.design_factors(d, M.INTERACTED).collect()]
    assert x == [[3, 1, 1, 3, 3, 1, 3, 20], [3, 0, 0, 0, 0, 0, 0, 20]]


def test_alignment(spark):
    segments = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "idx int, embedding array<float>")
    resp = spark.createDataFrame([("p", "Spatial", "Hashtag", [0.0, 2.0]), ("q", "Spatial", "Face", [1.0, 0.0]), ("z", "Spatial", "Hashtag", [0.0, 0.0])],
                                 "Player string, Structure string, Content string, embedding array<float>")
    d = A.narrative_alignment(resp, segments, tau=0.5)
    r = {x.Player: x for x in d.collect()}
    assert r["p"].loading == pytest.approx([0, 1, 1]) and r["p"].segment_index == 1 and r["p"].segment_label == "Causes"
    assert sum(r["p"].loading_normed) == pytest.approx(1.0) and r["q"].segment_index == 0
    long = A.explode_loadings(d.where("Player <> 'z'"))
    assert {x.Player for x in long.collect()} == {"p"} and long.count() == 3


def test_embed_text(spark):
    d = spark.createDataFrame([("waves and waves",), ("quake",), (None,)], "t string")
    v = [r.embedding for r in A.embed_text(d, "t", features=64).collect()]
    assert len(v[0]) == 64 and sum(x * x for x in v[0]) == pytest.approx(1.0, abs=1e-5)
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [float(len(x))])

    assert [list(r.embedding) for r in A.embed_text(d, "t", embedder=lengths).collect()] == [[15.0], [5.0], [0.0]]


def test_many_segments_by_parts(spark):
    """Two thousand segments: beyond one array, with the same loadings."""
    import numpy as np
    from pairlog.operators import alignment as A
    rng = np.random.default_rng(4)
    segments, responses = rng.normal(size=(2000, 8)), rng.normal(size=(7, 8))
    s = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(segments)], "idx int, embedding array<double>")
    r = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(responses)], "vec_id int, embedding array<double>")
    got = {x.vec_id: x.loading for x in A.cosine_loadings_by_parts(r, s).collect()}
    want = responses @ segments.T / np.linalg.norm(responses, axis=1)[:, None] / np.linalg.norm(segments, axis=1)
    assert all(np.allclose(got[i], want[i]) for i in range(7))
    with pytest.raises(Exception, match="more than 1000 segments"):
        A.cosine_loadings(r, s).collect()


def test_no_job_before_the_loadings_run(spark):
    tracker = spark.sparkContext.statusTracker()
    segments = spark.range(9).select(F.col("id").cast("int").alias("idx"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    responses = spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    before = len(tracker.getJobIdsForGroup(None))
    d = A.narrative_alignment(responses, segments)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert d.count() == 5


def test_a_model_is_loaded_once(spark):
    """Texts of many batches and tasks: in every worker the first load is the only one."""
    def counting_model():
        import builtins
        builtins.loads = getattr(builtins, "loads", 0) + 1
        loads = builtins.loads
        return lambda texts: [[len(t), loads] for t in texts]

    d = spark.range(4000).select(F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("t"), "id").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = A.embed_text(d, "t", embedder=A.model_embedder(counting_model)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(list(r.embedding) == [r.id % 7, 1.0] for r in got)
    letters = {r.t: r.embedding for r in A.embed_text(spark.createDataFrame([("abab",), ("",), (None,), ("Ünc1",)], "t string"), "t",
                                                      embedder=A.model_embedder(A.letter_model)).collect()}
    assert letters["abab"][:3] == pytest.approx([0.5**0.5, 0.5**0.5, 0]) and not any(letters[""]) and not any(letters[None])
    assert letters["Ünc1"][13] == pytest.approx(0.5**0.5)
