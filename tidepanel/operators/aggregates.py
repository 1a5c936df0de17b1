"""Aggregates over panels, labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Share of rows on which a condition holds; rows where it is null don't count."""
    return F.avg(condition.cast("int"))


def unpivoted(rows: DataFrame, columns: list[str], name: str = "feature") -> DataFrame:
    """(feature, value) for each of the numeric columns: one pass, no union."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])).alias("_s")).select("_s.*")


def null_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    return unpivoted(rows, columns).groupBy("feature").agg(
        F.count("*").alias("rows"), F.avg(F.col("value").isNull().cast("int")).alias("null_rate"), (F.max("value") - F.min("value") <= 1e-15).alias("constant")
    )


def top_share(rows: DataFrame, by: list[str], value: str, tie: str, n: int = 3) -> DataFrame:
    """Per group: what share of `value` its `n` largest rows hold."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))
    return rows.withColumn("_t", turn).groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("_t") <= n, F.col(value))), F.sum(value)).alias("concentration"), F.count("*").alias("members"))


def breadth(rows: DataFrame, by: list[str], flags: list[str], expected: int) -> DataFrame:
    """Per group: the share of each flag, the members covered, and whether all are."""
    return rows.groupBy(*by).agg(*[share(F.col(f)).alias(f) for f in flags], F.count("*").alias("covered"), F.when(F.count("*") == expected, "complete").otherwise("partial").alias("status"))


def constant_features(rows: DataFrame, features: list[str], spread: float = 1e-15) -> DataFrame:
    """(feature, constant): features whose values lie within `spread`, or that have none. One pass over the rows."""
    each = rows.agg(*[(F.max(f) - F.min(f)).alias(f) for f in features])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f) <= spread, F.lit(True)).alias("constant")) for f in features])).alias("_p")
    return each.select(pairs).select("_p.*")


def duplicate_vectors(rows: DataFrame, by: list[str], features: list[str], name: str) -> DataFrame:
    """Per group the vectors of features that occur more than once: how often, and the first and last of the rows' names."""
    found = rows.groupBy(*by, *features).agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last")).filter("n > 1")
    return found.select(*by, "n", "first", "last")
