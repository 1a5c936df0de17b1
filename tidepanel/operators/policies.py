"""Policies as tables: rules are rows, and metrics are judged by joining them.

A rule names a metric, an operator and a bound, for one group (such as a horizon) or for all, and says what an unknown metric means. So a policy
can be stored, versioned and compared like any table; the tables below are those of the abstention and publication rules.

Cases: a rule whose metric isn't there counts it as unknown; NaN is unknown; a key without any metric row isn't judged; rules are a few dozen rows and
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "place int, name string, metric string, op string, bound double, upper double, only string, unknown boolean"
#: Why a ranking isn't published, in order; each reason holds if its comparison does.
ABSTENTION = [
    (1, "narrow-range", "range", "<", 0.03, None, None, True),
    (2, "near-even", "near_even", "=", 1.0, None, None, False),
    (3, "low-dispersion", "dispersion", "<", 0.01, None, None, False),
    (4, "incomplete-data", "completeness", "<", 0.8, None, None, True),
    (5, "no-brier-skill", "brier_skill", "<=", 0.0, None, None, True),
    (6, "no-rank-correlation", "rank_ic", "<=", 0.0, None, None, True),
    (7, "no-spread-after-costs", "after_cost", "<=", 0.0, None, None, True),
    (8, "windows-disagree", "positive_share", "<=", 0.5, None, None, True),
    (9, "calibration-not-enabled", "calibrated", "<>", 1.0, None, None, True),
]
#: The checks of a publication gate, in order; all have to hold.
PUBLICATION = [
    (1, "dataset_status_ready", "dataset_ready", "=", 1.0, None, None, False),
    (2, "model_availability_trained", "model_trained", "=", 1.0, None, None, False),
    (3, "required_source_health", "sources_ready", "=", 1.0, None, None, False),
    (4, "valid_fold_count", "folds", ">=", 5.0, None, None, False),
    (5, "oos_sample_count", "samples", ">=", 252.0, None, "1", False),
    (5, "oos_sample_count", "samples", ">=", 126.0, None, "5", False),
    (5, "oos_sample_count", "samples", ">=", 63.0, None, "20", False),
    (6, "aggregate_brier_skill", "brier_skill", ">", 0.0, None, None, False),
    (7, "aggregate_log_loss_skill", "log_loss_skill", ">", 0.0, None, None, False),
    (8, "fold_brier_skill_share", "fold_share", ">=", 0.6, None, None, False),
    (9, "auc_above_minimum", "auc", ">", 0.52, None, None, True),
    (10, "calibration_slope", "slope", "within", 0.5, 1.5, None, False),
    (11, "calibration_intercept", "intercept", "within", -0.15, 0.15, None, False),
    (12, "probability_std", "dispersion", ">=", 0.03, None, None, False),
    (13, "coverage", "coverage", ">=", 0.8, None, None, False),
    (14, "no_cross_fold_leakage", "leakage_free", "=", 1.0, None, None, False),
    (15, "fold_stability", "largest_share", "<=", 0.6, None, None, False),
]
DATA_CHECKS = ("model_availability_trained", "valid_fold_count", "oos_sample_count")


def policy(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def judged(metrics: DataFrame, rules: DataFrame, key: str, only: str | None = None) -> DataFrame:
    """(key, place, name, value, holds) of every rule for every key; `metrics` has one row a key and a column a metric, `only` is the column that rules may be limited to."""
    names = [c for c in metrics.columns if c not in (key, only)]
    value = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    own = metrics.select(F.col(key).alias("_key"), value.alias("_values"), (F.col(only).cast("string") if only else F.lit(None).cast("string")).alias("_only"))
    met = own.join(F.broadcast(rules), F.col("only").isNull() | (F.col("only") == F.col("_only")))  # rules are a few dozen
    v = F.nanvl(F.try_element_at("_values", F.col("metric")), F.lit(None).cast("double"))
    met = met.withColumn("value", v)
    x, b = F.col("value"), F.col("bound")
    holds = (
        F.when(F.col("op") == "<", x < b).when(F.col("op") == "<=", x <= b).when(F.col("op") == ">", x > b).when(F.col("op") == ">=", x >= b)
        .when(F.col("op") == "=", x == b).when(F.col("op") == "<>", x != b).when(F.col("op") == "within", x.between(b, F.col("upper")))
    )
    return met.select(F.col("_key").alias(key), "place", "name", "value", F.coalesce(holds, F.col("unknown")).alias("holds"))


def _names(which: str) -> Column:
    marked = F.array_sort(F.collect_set(F.when(F.expr(which), F.struct("place", "name"))))  # as many as the policy has rules
    return F.transform(marked, lambda r: r["name"])


def reasons(metrics: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, reasons): the names of the rules that hold, in their order."""
    return judged(metrics, rules, key).groupBy(key).agg(_names("holds").alias("reasons"))


def publication(metrics: DataFrame, rules: DataFrame, key: str, only: str | None = None, data_checks: tuple[str, ...] = DATA_CHECKS) -> DataFrame:
    """(key, status, failed, passed): insufficient_data if a check of the data fails, else abstained if any does, else published; both lists in order."""
    each = judged(metrics, rules, key, only)
    found = each.groupBy(key).agg(_names("not holds").alias("failed"), _names("holds").alias("passed"))
    status = F.when(F.arrays_overlap("failed", F.array(*map(F.lit, data_checks))), "insufficient_data").when(F.size("failed") > 0, "abstained").otherwise("published")
    return found.select(key, status.alias("status"), "failed", "passed")
