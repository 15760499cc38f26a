"""Regression models of the study as penalised maximum likelihood.

Each model has the priors it was published with (``PRIORS``): normal on slopes and on the intercept at the mean of
the covariates, gamma on the precision of the Beta model, half-Cauchy on the residual deviation of the Gaussian
one. The figures are modes of the posterior, not means, and no posterior intervals are claimed.

All covariates are discrete (trial, condition, size, decision), so a log of any length has
only some thousand distinct rows. It is counted down to those in one mergeable aggregate,
and the Newton steps (``regression``) sum over weighted patterns instead of passing over the log again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import DECISIONS
from ..functions.special import digamma
from ..session import truncate_lineage
from . import regression as R

CONDITION = ("Structure", "Content")
# The priors of the published models.
PRIORS = {"dominance": R.Prior(10.0), "entropy": R.Prior(10.0), "coordination": R.Prior(5.0), "decision": R.Prior(5.0)}
PHI_PRIOR = (0.01, 0.01)
SIGMA_SCALE = 2.0
INTERACTED = ["TrialNumber", "Spatial", "Hashtag", "TrialNumber:Spatial", "TrialNumber:Hashtag",
              "Spatial:Hashtag", "TrialNumber:Spatial:Hashtag", "Size"]
SAMPLED = ["TrialNumber", "Hashtag", "TrialNumber:Hashtag", "Spatial", "Size"]
BY_DECISION = ["EC", "RS", "RP", "Hashtag", "EC:Hashtag", "RS:Hashtag", "RP:Hashtag", "Spatial", "Size"]


def design_columns(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Treatment coding with Face and Homogeneous as reference: columns x0, x1, ... of 0/1 values and products, in the
    order of ``terms`` ("a:b" is a product)."""
    base = {
        "Spatial": lambda: (F.col("Structure") == "Spatial").cast("double"),
        "Hashtag": lambda: (F.col("Content") == "Hashtag").cast("double"),
        **{d: (lambda d=d: (F.col("DecisionType") == d).cast("double")) for d in DECISIONS if d != "BN"},
    }
    value = lambda name: base[name]() if name in base else F.col(name).cast("double")

    def term(t: str):
        parts = [value(p) for p in t.split(":")]
        out = parts[0]
        for p in parts[1:]:
            out = out * p
        return out

    return df.withColumns({f"x{i}": term(t) for i, t in enumerate(terms)})


def design_factors(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``design_columns``, assembled in ``features`` as well."""
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(terms))], outputCol="features").transform(design_columns(df, terms))


def covariate_patterns(df: DataFrame, label: str, covariates: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct (covariates, label) rows with their weight, written to the work folder: the fit
    passes over them many times and the log is read once. Rows with a NULL among them take no part."""
    w = F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.col(weight).cast("double"))
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (label, *covariates)))
    return truncate_lineage(
        whole.groupBy(*covariates, F.col(label).cast("double").alias("label")).agg(w.alias("weight")), "patterns")


def _fit(df: DataFrame, terms: Sequence[str], label: str, covariates: Sequence[str], family, prior: R.Prior, **more) -> R.Fit:
    patterns = design_columns(covariate_patterns(df, label, covariates), terms)
    return R.fit(patterns, [f"x{i}" for i in range(len(terms))], family, prior, **more)


def _coefficients(df: DataFrame, terms: Sequence[str], values, intercept: float, extra: dict[str, float] | None = None, **keys) -> DataFrame:
    """A handful of numbers per model, as a table."""
    rows = [(*keys.values(), t, float(v)) for t, v in (("Intercept", intercept), *zip(terms, values), *(extra or {}).items())]
    names = ", ".join([*(f"{k} string" for k in keys), "term string", "estimate double"])
    return df.sparkSession.createDataFrame(rows, names)


def inner_share(share: str = "DomResponseProp", n: str = "NumRespondents") -> Column:
    """A share as the Beta model takes it: 0 and 1, for which it has no density, move inwards by half a respondent."""
    s = F.col(share).cast("double")
    return F.when((s <= 0) | (s >= 1), (s * (F.col(n) - 1) + 0.5) / F.col(n)).otherwise(s)


def fit_dominance(df: DataFrame) -> DataFrame:
    """Share of the dominant answer ~ trial x structure x content + size, Beta with a logit link; one observation for
    each run and trial. Wants DomResponseProp and NumRespondents. ``phi`` is the precision."""
    f = _fit(df.withColumn("_share", inner_share()), INTERACTED, "_share", ["TrialNumber", *CONDITION, "Size"], R.beta, PRIORS["dominance"],
             extra={"log_phi": R.Extra(1.0, R.gamma_prior(*PHI_PRIOR))})
    return _coefficients(df, INTERACTED, f.slopes[0], f.intercept[0], {"phi": f.extra["log_phi"]})


def fit_entropy(df: DataFrame) -> DataFrame:
    """EntropyDifference ~ trial x structure x content + size, Gaussian with deviation ``sigma``."""
    f = _fit(df, INTERACTED, "EntropyDifference", ["TrialNumber", *CONDITION, "Size"], R.gaussian, PRIORS["entropy"],
             extra={"log_sigma": R.Extra(0.0, R.half_cauchy_prior(SIGMA_SCALE))})
    return _coefficients(df, INTERACTED, f.slopes[0], f.intercept[0], {"sigma": f.extra["log_sigma"]})


def fit_coordination(df: DataFrame) -> DataFrame:
    """Coordinate ~ trial x content x structure + size, Bernoulli."""
    f = _fit(df, INTERACTED, "Coordinate", ["TrialNumber", *CONDITION, "Size"], R.bernoulli, PRIORS["coordination"])
    return _coefficients(df, INTERACTED, f.slopes[0], f.intercept[0])


def decision_class() -> Column:
    """0 for the reference BN, then the other decisions in their order."""
    return F.array_position(F.array(*[F.lit(d) for d in DECISIONS]), F.col("DecisionType")) - 1


def fit_decision_type(df: DataFrame) -> DataFrame:
    """DecisionType ~ trial x content + structure + size, categorical with BN as reference and priors on the
    contrasts with it: one row per decision and term."""
    f = _fit(df.withColumn("_d", decision_class()), SAMPLED, "_d", ["TrialNumber", *CONDITION, "Size"], R.categorical,
             PRIORS["decision"], predictors=len(DECISIONS) - 1)
    out = None
    for i, d in enumerate(DECISIONS[1:]):
        part = _coefficients(df, SAMPLED, f.slopes[i], f.intercept[i], decision=d)
        out = part if out is None else out.unionByName(part)
    return out


def fit_decision_coordination(df: DataFrame) -> DataFrame:
    """Coordinate ~ decision x content + structure + size, Bernoulli."""
    f = _fit(df, BY_DECISION, "Coordinate", ["DecisionType", *CONDITION, "Size"], R.bernoulli, PRIORS["coordination"])
    return _coefficients(df, BY_DECISION, f.slopes[0], f.intercept[0])


def score_equations(df: DataFrame, fits: DataFrame, terms: Sequence[str], label: Column, family: str, prior: R.Prior) -> DataFrame:
    """(decision,) term, n, score: the derivative of the log posterior by every coefficient, at the estimates of ``fits``,
    summed over the rows of the log themselves. All are zero at the mode. ``family``: beta, gaussian, bernoulli, categorical."""
    number = {tuple(r[:-1]): r[-1] for r in fits.collect()}  # a handful
    keyed = len(next(iter(number))) == 2
    groups = sorted({k[0] for k in number}, key=DECISIONS.index) if keyed else [None]
    get = lambda g, t: number[(g, t) if keyed else (t,)]
    xs = [f"x{i}" for i in range(len(terms))]
    d = design_columns(df.withColumn("_y", label.cast("double")), terms).where(" AND ".join(f"{c} IS NOT NULL" for c in ("_y", *xs)))
    d = d.select("_y", *xs)
    eta = {g: sum((F.col(x) * get(g, t) for x, t in zip(xs, terms)), F.lit(get(g, "Intercept"))) for g in groups}
    y = F.col("_y")
    if family == "categorical":
        total = sum((F.exp(e) for e in eta.values()), F.lit(1.0))
        residual = {g: (y == DECISIONS.index(g)).cast("double") - F.exp(eta[g]) / total for g in groups}
    elif family == "bernoulli":
        residual = {None: y - 1 / (1 + F.exp(-eta[None]))}
    elif family == "gaussian":
        residual = {None: (y - eta[None]) / get(None, "sigma") ** 2}
    else:
        mu, phi = 1 / (1 + F.exp(-eta[None])), get(None, "phi")
        gap = F.log(y / (1 - y)) - digamma(mu * phi) + digamma((1 - mu) * phi)
        residual = {None: phi * gap * mu * (1 - mu)}
    sums = {(g, t): F.sum(residual[g] * (F.col(x) if x else 1.0)) for g in groups for t, x in (("Intercept", None), *zip(terms, xs))}
    r = d.agg(F.count(F.lit(1)), *[F.avg(x) for x in xs], *sums.values()).first()
    n, means, found = r[0], np.array(r[1:1 + len(xs)], dtype=float), dict(zip(sums, r[1 + len(xs):]))
    rows = []
    for g in groups:
        slopes = np.array([get(g, t) for t in terms])
        pull = (get(g, "Intercept") + means @ slopes) / prior.intercept_sd ** 2  # the prior holds the intercept at the means
        for t, b, m in (("Intercept", 0.0, 1.0), *zip(terms, slopes, means)):
            rows.append((*([g] if keyed else []), t, n, float(found[g, t] - b / prior.slope_sd ** 2 - pull * m)))
    return df.sparkSession.createDataFrame(rows, ("decision string, " if keyed else "") + "term string, n bigint, score double")


def conditional_effects(df: DataFrame, fit: DataFrame, terms: Sequence[str], logit: bool = True) -> DataFrame:
    """Predicted mean by decision and content at the mean size of the log, homogeneous
    structure: the fitted terms, unfolded over a grid of levels and summed."""
    size = df.select("Size").agg(F.avg("Size")).scalar()
    levels = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in DECISIONS])).alias("DecisionType"))
    grid = (levels.withColumn("Content", F.explode(F.array(F.lit("Face"), F.lit("Hashtag"))))
            .withColumn("Structure", F.lit("Homogeneous")).withColumn("Size", size))
    coefs = fit.agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate")))).scalar()
    flat = {"Hashtag": (F.col("Content") == "Hashtag").cast("double"), "Spatial": F.lit(0.0), "Size": F.col("Size"),
            **{d: (F.col("DecisionType") == d).cast("double") for d in DECISIONS}}
    eta = F.try_element_at(F.col("_c"), F.lit("Intercept"))
    for t in terms:
        x = F.try_element_at(F.col("_c"), F.lit(t))
        for p in t.split(":"):
            x = x * flat[p]
        eta = eta + x
    mean = 1 / (1 + F.exp(-eta)) if logit else eta
    return grid.withColumn("_c", coefs).select("DecisionType", "Content", mean.alias("estimate"))


def hurdle_gaussian(diffs: DataFrame, value: str = "difference", keys: Sequence[str] = CONDITION) -> DataFrame:
    """Maximum likelihood of the zero-hurdle normal model: hu, the overall share of zeros;
    mu, the mean of a cell's non-zero values; sigma, pooled over non-zero residuals."""
    nonzero = F.when(F.col(value) != 0, F.col(value).cast("double"))
    cells = diffs.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(nonzero).alias("k"), F.avg(nonzero).alias("mu"),
        F.coalesce(F.var_pop(nonzero) * F.count(nonzero), F.lit(0.0)).alias("ss"))
    pooled = cells.agg((1 - F.sum("k") / F.sum("n")).alias("hu"), F.sqrt(F.sum("ss") / F.sum("k")).alias("sigma"))
    return (cells.select(*keys, "n", "mu")
            .withColumn("hu", pooled.select("hu").scalar()).withColumn("sigma", pooled.select("sigma").scalar()))


def hurdle_expected(fit: DataFrame) -> DataFrame:
    return fit.withColumn("expected", F.col("mu") * (1 - F.col("hu")))


def hash_uniform(*parts) -> Column:
    """A number in (0, 1) drawn by a hash of its arguments: the same for a row wherever it is computed."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hurdle_predict(diffs: DataFrame, fit: DataFrame, seed: int = 420, keys: Sequence[str] = CONDITION,
                   record: Sequence[str] | None = None) -> DataFrame:
    """One draw per observation: 0 with probability hu, else normal(mu, sigma). Draws come from a hash of
    ``record`` (columns that tell rows apart; all of them by default) and the seed, so they do not depend
    on partitions; the normal deviate is made of two uniform ones."""
    own = [F.col(c) for c in record or diffs.columns]
    zero, radius, angle = (hash_uniform(*own, F.lit(seed + i)) for i in range(3))
    normal = F.sqrt(-2 * F.log(radius)) * F.cos(2 * math.pi * angle)
    return diffs.withColumn("_draw", F.struct(zero.alias("z"), normal.alias("n"))).join(fit.drop("n"), list(keys)).withColumn(
        "predicted", F.when(F.col("_draw.z") < F.col("hu"), F.lit(0.0)).otherwise(
            F.col("mu") + F.col("sigma") * F.col("_draw.n"))).drop("_draw")
