"""Forward-return labels on the calendar of the benchmark: horizons count sessions, and a cross-section is all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.features import cross


def calendar(bench: DataFrame) -> DataFrame:
    """(date, session): one row per session, small whatever the panel's size."""
    return bench.select("date").distinct().withColumn("session", F.row_number().over(Window.orderBy("date")))


def targets(bench: DataFrame, horizons: list[int]) -> DataFrame:
    """(date, horizon, target_date, bench_start, bench_end): the h-th later session of each session."""
    order = Window.orderBy("date")
    rows = [
        bench.select("date", F.lit(h).alias("horizon"), F.lead("date", h).over(order).alias("target_date"), F.col("close").alias("bench_start"), F.lead("close", h).over(order).alias("bench_end"))
        for h in horizons
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("target_date is not null")


def realized_rank(column: str = "excess", by: tuple[str, ...] = ("date", "horizon")) -> Column:
    """1 for the largest; ties break on the code. Rounded, so that float noise cannot decide."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(column, 10)), "code"))


def forward_labels(panel: DataFrame, bench: DataFrame, size: int, horizons: list[int]) -> DataFrame:
    """Per (date, code, horizon): returns, excess, flags, rank, percentile and top quartile.

    A code without a close on the target date leaves out the whole cross-section of that date and horizon.
    """
    at = panel.select("date", "code", "close")
    goals = F.broadcast(targets(bench, horizons))  # one row per session and horizon
    ends = at.select(F.col("date").alias("target_date"), "code", F.col("close").alias("end_close"))
    rows = at.join(goals, "date").join(ends, ["target_date", "code"], "left")
    group = Window.partitionBy("date", "horizon")
    rows = rows.withColumn("_n", F.count("end_close").over(group)).filter(F.col("_n") == size)
    forward = F.col("end_close") / F.col("close") - 1
    bench_forward = F.col("bench_end") / F.col("bench_start") - 1
    rows = rows.select("date", "code", "horizon", "target_date", forward.alias("forward"), bench_forward.alias("bench_forward"), (forward - bench_forward).alias("excess"))
    rank = realized_rank()
    return rows.select(
        "*", (F.col("forward") > 0).cast("int").alias("absolute_up"), (F.col("excess") > 0).cast("int").alias("outperformed"), rank.alias("rank")
    ).withColumn("top_quartile", (F.col("rank") <= F.lit(-(-size // 4))).cast("int")).withColumn("percentile", 1 - (F.col("rank") - 1) / F.lit(max(1, size - 1)))


def percentile_score(column: str, over=None) -> Column:
    """100 for the largest down to 0, one decimal; ties break on the code."""
    over = over or cross()
    turn = F.row_number().over(over.orderBy(F.desc(F.round(column, 10)), "code"))
    return F.round(100 * (1 - (turn - 1) / F.greatest(F.lit(1), F.count("*").over(over) - 1)), 1)


def wide_labels(labels: DataFrame, horizons: list[int]) -> DataFrame:
    """One row per (date, code), the labels of each horizon in columns of their own."""
    pick = lambda c, h: F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}{h}")
    return labels.groupBy("date", "code").agg(*[pick(c, h) for h in horizons for c in ("target_date", "forward", "excess", "rank", "top_quartile")])


def breaks_in_labels(labels: DataFrame, panel: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose forward return isn't what the panel gives again, or whose target isn't later; none if all is well."""
    start = panel.select("date", "code", F.col("close").alias("a"))
    end = panel.select(F.col("date").alias("target_date"), "code", F.col("close").alias("b"))
    again = labels.join(start, ["date", "code"]).join(end, ["target_date", "code"])
    return again.filter((F.abs(F.col("b") / F.col("a") - 1 - F.col("forward")) > tolerance) | (F.col("target_date") <= F.col("date")))


def calendar_faults(labels: DataFrame, bench: DataFrame) -> DataFrame:
    """`labels` with `violations`: no-session (the target isn't a session), horizon (it isn't the horizon-th session after the date)."""
    from tidepanel.functions.scalars import violations

    days = calendar(bench)
    start = F.broadcast(days.select("date", F.col("session").alias("_from")))  # one row per session
    end = F.broadcast(days.select(F.col("date").alias("target_date"), F.col("session").alias("_to")))
    met = labels.join(start, "date", "left").join(end, "target_date", "left")
    known = F.col("_to").isNotNull()
    wrong = known & F.coalesce(F.col("_to") - F.col("_from") != F.col("horizon"), F.lit(True))
    return met.withColumn("violations", violations((~known, "no-session"), (wrong, "horizon"))).drop("_from", "_to")
