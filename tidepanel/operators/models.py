"""Standardized ridge models fitted by sums that Spark aggregates: logistic by Newton's method, linear by normal equations.

Rows are never gathered. Each Newton step is one aggregation by group (gradient and Hessian, some dozens of sums a group); the driver
holds one small system per group, such as a fold, and solves it. Coefficients go back to the rows as a table of one row per group.

Cases: rows with a null feature, target or group are left out; a feature without spread keeps a scale of 1; a group whose target has one
value has no logistic model; empty tables give no models.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import cut

GROUPS = 100_000  # models that are fitted at once; more groups are fitted part by part, each with its own passes


def _known(rows: DataFrame, by: str, features: list[str], target: str) -> DataFrame:
    known = F.lit(True)
    for name in (by, *features, target):
        known = known & F.col(name).isNotNull()
    return rows.filter(known).select(F.col(by).alias("_g"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("_y"))


def _collected(sums: DataFrame) -> dict:
    return {r["_g"]: r for r in sums.collect()}  # GROUPS rows and somewhat more at most, see _by_parts


def _by_parts(fit: Callable[[DataFrame], DataFrame], rows: DataFrame, by: str) -> DataFrame:
    """`fit` of all rows, or of parts of the groups, so that the driver never holds more than about GROUPS small systems."""
    groups = rows.filter(F.col(by).isNotNull()).agg(F.approx_count_distinct(by)).first()[0]
    parts = 1 + int(groups * 1.1) // GROUPS
    if parts == 1:
        return fit(rows)
    models = None
    for k in range(parts):
        own = cut(fit(rows.filter(F.pmod(F.xxhash64(by), F.lit(parts)) == k)))
        models = own if models is None else models.unionByName(own)
    return models


def _moments(rows: DataFrame, n: int, sample_sd: bool) -> dict:
    spread = F.stddev_samp if sample_sd else F.stddev_pop
    return _collected(rows.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_y").alias("y"), F.min("_y").alias("low"), F.max("_y").alias("high"), *[f(f"_f{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("s", spread))]))


def _table(spark, by: str, features: list[str], models: dict, schema_of: DataFrame) -> DataFrame:
    kind = schema_of.schema["_g"].dataType.simpleString()
    rows = [(g, *(m[k] for k in ("n", "base", "intercept", "weights", "means", "scales", "steps"))) for g, m in models.items()]
    return spark.createDataFrame(rows, f"{by} {kind}, rows long, base_rate double, intercept double, weights array<double>, means array<double>, scales array<double>, steps int")


def _scaled(n: int) -> list[Column]:
    return [(F.col(f"_f{i}") - F.col("_means")[i]) / F.col("_scales")[i] for i in range(n)]


def fit_logistic(rows: DataFrame, features: list[str], target: str, by: str, *, ridge: float, iterations: int = 32, sample_sd: bool = True, clip: float = 60.0, base_start: bool = True, standardize: bool = True, slope_start: float = 0.0, all_ridge: float = 0.0) -> DataFrame:
    """One row per group: rows, base_rate, intercept, weights (of standardized features), means, scales, steps."""
    how = {"ridge": ridge, "iterations": iterations, "sample_sd": sample_sd, "clip": clip, "base_start": base_start, "standardize": standardize, "slope_start": slope_start, "all_ridge": all_ridge}
    return _by_parts(lambda part: _logistic(part, features, target, by, **how), rows, by)


def _logistic(rows: DataFrame, features: list[str], target: str, by: str, *, ridge: float, iterations: int, sample_sd: bool, clip: float, base_start: bool, standardize: bool, slope_start: float, all_ridge: float) -> DataFrame:
    spark, n = rows.sparkSession, len(features)
    data = cut(_known(rows, by, features, target))
    start = {g: r for g, r in _moments(data, n, sample_sd).items() if r["low"] != r["high"]}
    models = {}
    for g, r in start.items():
        means = [r[f"m{i}"] if standardize else 0.0 for i in range(n)]
        scales = [r[f"s{i}"] if standardize and (r[f"s{i}"] or 0) > 1e-12 else 1.0 for i in range(n)]
        base = max(1e-6, r["y"]) / max(1e-6, 1 - r["y"])
        models[g] = {"n": r["n"], "base": r["y"], "means": means, "scales": scales, "intercept": math.log(base) if base_start else 0.0, "weights": [slope_start] * n, "steps": 0}
    open_ = set(models)
    names = [f"_x{i}" for i in range(n)]
    kind = data.schema["_g"].dataType.simpleString()
    for _ in range(iterations):
        if not open_:
            break
        now = spark.createDataFrame([(g, [models[g]["intercept"], *models[g]["weights"]], models[g]["means"], models[g]["scales"]) for g in open_], f"_k {kind}, _b array<double>, _means array<double>, _scales array<double>")
        at = data.join(F.broadcast(now), F.col("_g") == F.col("_k")).select("_g", "_y", "_b", *[x.alias(name) for x, name in zip(_scaled(n), names)])  # about GROUPS rows at most
        logit = F.col("_b")[0]
        for i, x in enumerate(names):
            logit = logit + F.col("_b")[i + 1] * F.col(x)
        at = at.withColumn("_p", 1 / (1 + F.exp(-F.least(F.lit(clip), F.greatest(F.lit(-clip), logit))))).withColumn("_w", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-6)))
        one = [F.lit(1.0), *map(F.col, names)]
        gradient = [F.sum((F.col("_y") - F.col("_p")) * x).alias(f"g{i}") for i, x in enumerate(one)]
        hessian = [F.sum(F.col("_w") * one[i] * one[j]).alias(f"h{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)]
        for g, r in _collected(at.groupBy("_g").agg(*gradient, *hessian)).items():
            m = models[g]
            beta = np.array([m["intercept"], *m["weights"]])
            slope = np.array([r[f"g{i}"] for i in range(n + 1)])
            curve = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n + 1)])
            penalty = np.full(n + 1, ridge)
            penalty[0] = 0.0
            step = _solve(curve + np.diag(penalty + all_ridge), slope - penalty * beta)
            beta = beta + step
            m["intercept"], m["weights"], m["steps"] = float(beta[0]), beta[1:].tolist(), m["steps"] + 1
            if float(np.abs(step).max()) < 1e-8:
                open_.discard(g)
    return _table(spark, by, features, models, data)


def fit_linear(rows: DataFrame, features: list[str], target: str, by: str, *, ridge: float) -> DataFrame:
    """As `fit_logistic`, for a linear target: two aggregations, for the scales and for the normal equations."""
    return _by_parts(lambda part: _linear(part, features, target, by, ridge), rows, by)


def _linear(rows: DataFrame, features: list[str], target: str, by: str, ridge: float) -> DataFrame:
    spark, n = rows.sparkSession, len(features)
    data = cut(_known(rows, by, features, target))
    start, kind = _moments(data, n, True), data.schema["_g"].dataType.simpleString()
    if not start:
        return _table(spark, by, features, {}, data)
    scale = {g: ([r[f"m{i}"] for i in range(n)], [r[f"s{i}"] if (r[f"s{i}"] or 0) > 1e-12 else 1.0 for i in range(n)]) for g, r in start.items()}
    now = spark.createDataFrame([(g, *x) for g, x in scale.items()], f"_k {kind}, _means array<double>, _scales array<double>")
    names = [f"_x{i}" for i in range(n)]
    at = data.join(F.broadcast(now), F.col("_g") == F.col("_k")).select("_g", "_y", *[x.alias(name) for x, name in zip(_scaled(n), names)])
    one = [F.lit(1.0), *map(F.col, names)]
    sums = [F.sum(F.col("_y") * x).alias(f"v{i}") for i, x in enumerate(one)] + [F.sum(one[i] * one[j]).alias(f"h{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)]
    models = {}
    for g, r in _collected(at.groupBy("_g").agg(*sums)).items():
        gram = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n + 1)])
        penalty = np.diag([0.0] + [ridge] * n)
        beta = _solve(gram + penalty, np.array([r[f"v{i}"] for i in range(n + 1)]))
        models[g] = {"n": start[g]["n"], "base": None, "means": scale[g][0], "scales": scale[g][1], "intercept": float(beta[0]), "weights": beta[1:].tolist(), "steps": 1}
    return _table(spark, by, features, models, data)


def _solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, vector)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(matrix) @ vector


def score(rows: DataFrame, models: DataFrame, features: list[str], by: str, out: str = "raw_score") -> DataFrame:
    """`rows` of groups that have a model, with their linear score."""
    own = models.select(F.col(by).alias("_k"), F.col("intercept").alias("_intercept"), F.col("weights").alias("_weights"), F.col("means").alias("_means"), F.col("scales").alias("_scales"))
    total = F.col("_intercept")
    for i, f in enumerate(features):
        total = total + F.col("_weights")[i] * (F.col(f) - F.col("_means")[i]) / F.col("_scales")[i]
    few = own.limit(GROUPS + 1).count() <= GROUPS
    joined = rows.join(F.broadcast(own) if few else own, rows[by] == own["_k"])
    return joined.select(*[rows[c] for c in rows.columns], total.alias(out))


def fit_platt(rows: DataFrame, score_: str, target: str, by: str, ridge: float = 2.0) -> DataFrame:
    """Platt calibrators: a logistic model of the score, standardized by its population deviation."""
    return fit_logistic(rows, [score_], target, by, ridge=ridge, iterations=40, sample_sd=False)


def calibrated(rows: DataFrame, calibrators: DataFrame, score_: str, by: str, out: str = "calibrated") -> DataFrame:
    scored = score(rows, calibrators, [score_], by, "_line")
    return scored.withColumn(out, 1 / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), F.col("_line")))))).drop("_line")


def calibration_line(rows: DataFrame, p: str, y: str, by: str) -> DataFrame:
    """(by, intercept, slope) of a logistic line through the logits of the probabilities; (0, 1) is perfect."""
    logit = F.ln(F.greatest(F.lit(1e-6), F.col(p)) / F.greatest(F.lit(1e-6), 1 - F.col(p)))
    fitted = fit_logistic(rows.withColumn("_logit", logit), ["_logit"], y, by, ridge=0.0, iterations=40, standardize=False, slope_start=1.0, all_ridge=1e-9)
    return fitted.select(by, "intercept", F.col("weights")[0].alias("slope"))


def coefficient_stability(models: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: the share of models whose weight has the more frequent sign, and the weights' population deviation."""
    each = models.select(F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("name"), F.col("weights").alias("weight"))).alias("_w")).select(F.col("_w.name").alias("feature"), F.col("_w.weight").alias("weight"))
    nonzero = F.abs("weight") > 1e-12
    plus, minus = F.count_if(nonzero & (F.col("weight") > 0)), F.count_if(nonzero & (F.col("weight") < 0))
    return each.groupBy("feature").agg(F.coalesce(F.try_divide(F.greatest(plus, minus), plus + minus), F.lit(1.0)).alias("sign_stability"), F.stddev_pop("weight").alias("dispersion"))
