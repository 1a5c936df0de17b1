"""Recurrences y(t) = r y(t-1) + u(t) over series of any length, by blocks: no task and no row holds a whole series.

A block of BLOCK rows turns the value before it into the value after it by one factor and one addend, so blocks follow the same
recurrence with the factor r^BLOCK. Its solution, found the same way over blocks of blocks, gives each block its start; levels grow with
the logarithm of the longest series (10^7 rows need four).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import cut

BLOCK = 64
BROADCAST_ROWS = 100_000


def ordinals(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """`rows` with `at`, the place of each among the rows of its `key`, from 0, and `size`, the number of those rows.

    Rows lie in a range partitioning by key and order, so a key with most of the rows is in many tasks. They are written once; only counts
    per partition are added up, and meet the rows by broadcast up to BROADCAST_ROWS of them, counted first.
    """
    ranged = cut(rows.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_part").agg(F.count("*").alias("_own"))
    every = Window.partitionBy(key)  # a row per partition
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(counts.select(key, "_part", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_before"), F.sum("_own").over(every).alias("size")))
    small = before.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = ranged.withColumn("at", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1)
    return own.join(F.broadcast(before) if small else before, [key, "_part"]).withColumn("at", F.col("at") + F.col("_before")).drop("_part", "_before")


def linear_recurrence(inputs: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, at, y) of inputs (keys, at from 0 without gaps, u, r the same for a key); y before the first row is 0."""
    parts = inputs.groupBy(*keys, F.floor(F.col("at") / block).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("at", "u"))).alias("_rows"), F.first("r").alias("r"))
    step = lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) * F.col("r") + x["u"]))
    solved = cut(parts.withColumn("_y", F.aggregate("_rows", F.array().cast("array<double>"), step)))
    deepest = solved.agg(F.max("_b")).first()[0]
    if deepest:
        ends = solved.select(*keys, F.col("_b").alias("at"), F.element_at("_y", -1).alias("u"), F.pow("r", F.lit(block)).alias("r"))
        starts = linear_recurrence(ends, keys, block).select(*keys, (F.col("at") + 1).alias("_b"), F.col("y").alias("_start"))
        solved = solved.join(starts, [*keys, "_b"], "left")
    else:
        solved = solved.withColumn("_start", F.lit(0.0))
    rows = solved.select(*keys, "r", F.coalesce("_start", F.lit(0.0)).alias("_start"), F.posexplode(F.arrays_zip(F.col("_rows.at").alias("at"), F.col("_y").alias("y"))).alias("_k", "_v"))
    return rows.select(*keys, F.col("_v.at").alias("at"), (F.col("_v.y") + F.pow("r", F.col("_k") + 1) * F.col("_start")).alias("y"))


def exponential_averages(panel: DataFrame, periods: list[int]) -> DataFrame:
    """(code, date, close) with `ema<n>`: the exponential average seeded by the mean of the first n closes; null before it and for shorter series."""
    base = cut(ordinals(panel.select("code", "date", "close"), "code", [F.col("date")]))
    inputs = None
    for n in periods:
        alpha = 2.0 / (n + 1)
        seeds = base.filter(f"at < {n}").groupBy("code").agg(F.avg("close").alias("u"), F.count("*").alias("_n")).filter(f"_n = {n}").select("code", F.lit(0).cast("long").alias("at"), "u")
        rest = base.filter(f"at >= {n}").select("code", (F.col("at") - (n - 1)).alias("at"), (F.col("close") * alpha).alias("u"))
        own = seeds.unionByName(rest).withColumn("n", F.lit(n)).withColumn("r", F.lit(1 - alpha))
        inputs = own if inputs is None else inputs.unionByName(own)
    found = linear_recurrence(inputs, ["code", "n"]).withColumn("at", F.col("at") + F.col("n") - 1)
    wide = found.groupBy("code", "at").agg(*[F.max(F.when(F.col("n") == n, F.col("y"))).alias(f"ema{n}") for n in periods])
    return base.join(wide, ["code", "at"], "left").select("code", "date", "close", *[f"ema{n}" for n in periods])
