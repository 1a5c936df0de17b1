"""Metrics of probabilities and rankings, as aggregates.

Cases: null probabilities or outcomes are left out; a group without both outcomes has a null AUC; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import features as X

BUCKETS = 4096  # of probabilities, that are ranked apart
COST = 0.004  # of a round trip on both legs
TOP_SHARE = 0.25


def _pairs(rows: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    return rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(p).cast("double").alias("_p"), F.col(y).cast("int").alias("_y"))


def brier(rows: DataFrame, by: list[str], p: str = "p", y: str = "y", base: str | None = None) -> DataFrame:
    """Per group: n, brier, baseline_brier (of the column `base`, or else of the group's own rate), brier_skill, log_loss."""
    kept = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    pairs = kept.select(*by, F.col(p).cast("double").alias("_p"), F.col(y).cast("int").alias("_y"), (F.col(base).cast("double") if base else F.lit(None).cast("double")).alias("_b"))
    loss = -(F.col("_y") * F.ln(F.greatest("_p", F.lit(1e-12))) + (1 - F.col("_y")) * F.ln(F.greatest(1 - F.col("_p"), F.lit(1e-12))))
    # Against the group's own rate r the mean of (r - y)^2 is r(1 - r).
    own = F.avg("_y") * (1 - F.avg("_y"))
    given = F.avg((F.col("_b") - F.col("_y")) * (F.col("_b") - F.col("_y")))
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("brier"), (given if base else own).alias("baseline_brier"), F.avg(loss).alias("log_loss"))
    return out.withColumn("brier_skill", 1 - F.try_divide("brier", F.nullif(F.col("baseline_brier"), F.lit(0.0))))


def auc(rows: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Per group: the chance that a row with outcome 1 has the higher probability, ties counting half.

    Rows are first counted by probability. A group's probabilities are ranked in BUCKETS parts, whose counts add up to what lies below
    each part, so no task sorts a whole group.
    """
    counts = _pairs(rows, by, p, y).groupBy(*by, "_p").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    counts = counts.withColumn("_bucket", F.floor(F.least(F.greatest("_p", F.lit(0.0)), F.lit(1.0)) * BUCKETS))
    parts = counts.groupBy(*by, "_bucket").agg(F.sum("_neg").alias("_part"))
    below = F.sum("_part").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_part")
    met = counts.join(parts.select(*by, "_bucket", below.alias("_below")), [*by, "_bucket"])
    inside = F.sum("_neg").over(Window.partitionBy(*by, "_bucket").orderBy("_p")) - F.col("_neg")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_inside") + F.col("_neg") / 2))
    return met.withColumn("_inside", inside).groupBy(*by).agg(F.try_divide(wins, F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auc"))


def calibration_error(rows: DataFrame, by: list[str], p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Per group: the mean distance of probability and rate over equal bins, weighted by their rows; 1 is in the last bin."""
    each = _pairs(rows, by, p, y).withColumn("_bin", F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1)))
    part = each.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.abs(F.avg("_p") - F.avg("_y")).alias("_gap"))
    return part.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("ece"))


def daily_ranking(rows: DataFrame, p: str = "p", excess: str = "excess") -> DataFrame:
    """Per date with a rank correlation: rank_ic, hit (share of the predicted top quartile that is in the real one), spread, after_cost, dispersion, range."""
    date = X.cross()
    first = lambda c: F.row_number().over(date.orderBy(F.desc(F.round(c, 10)), "code"))
    last = F.row_number().over(date.orderBy(F.round(p, 10), F.desc("code")))
    marked = rows.select("date", "code", F.col(p).alias("_p"), F.col(excess).alias("_e"), first(p).alias("_a"), last.alias("_z"), first(excess).alias("_r"), F.greatest(F.lit(1), F.ceil(F.count("*").over(date) * TOP_SHARE)).alias("_top"))
    top, real, low = F.col("_a") <= F.col("_top"), F.col("_r") <= F.col("_top"), F.col("_z") <= F.col("_top")
    each = marked.groupBy("date").agg(
        (F.count_if(top & real) / F.max("_top")).alias("hit"), (F.avg(F.when(top, F.col("_e"))) - F.avg(F.when(low, F.col("_e")))).alias("spread"), F.stddev_pop("_p").alias("dispersion"), (F.max("_p") - F.min("_p")).alias("range"),
    )
    ic = X.rank_correlation(rows, p, excess).filter("ic is not null")
    return each.join(ic.select("date", F.col("ic").alias("rank_ic")), "date").withColumn("after_cost", F.col("spread") - COST)


def ranking_summary(daily: DataFrame, block: int = 63) -> DataFrame:
    """One row: means over dates, the share of blocks of `block` dates with a positive correlation, the worst block, abstentions and the largest drawdown of the cumulated spread."""
    order = Window.orderBy("date")  # one row per date
    cumulated = F.sum("after_cost").over(order)
    placed = daily.withColumn("_block", F.floor((F.row_number().over(order) - 1) / block)).withColumn("_sum", cumulated)
    placed = placed.withColumn("_drop", F.col("_sum") - F.greatest(F.lit(0.0), F.max("_sum").over(order)))
    blocks = placed.groupBy("_block").agg(F.avg("rank_ic").alias("_ic"), F.avg("after_cost").alias("_cost")).agg(F.avg((F.col("_ic") > 0).cast("int")).alias("positive_share"), F.min("_cost").alias("worst_block"))
    silent = ((F.col("dispersion") < 0.01) | (F.col("range") < 0.03)).cast("int")
    means = placed.agg(
        F.count("*").alias("dates"), F.avg("rank_ic").alias("rank_ic"), F.avg("hit").alias("hit_rate"), F.avg("spread").alias("spread"), F.avg("after_cost").alias("after_cost"),
        F.avg("dispersion").alias("dispersion"), F.avg(silent).alias("abstention_share"), F.least(F.lit(0.0), F.min("_drop")).alias("max_drawdown"),
    )
    return means.withColumn("_k", F.lit(1)).join(F.broadcast(blocks.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row each


def bundle(rows: DataFrame, by: list[str], p: str = "p", y: str = "y", base: str = "base", least: int = 5) -> DataFrame:
    """Per group: n and the metrics, which are null with the reason `insufficient_sample` below `least` rows."""
    one = brier(rows, by, p, y, base).join(auc(rows, by, p, y), by).join(calibration_error(rows, by, p, y), by)
    enough = F.col("n") >= least
    return one.select(*by, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("brier", "baseline_brier", "brier_skill", "auc", "ece")], F.when(~enough, "insufficient_sample").alias("reason"))


def calibration_rule(rows: DataFrame, by: list[str], raw: str, calibrated: str, y: str) -> DataFrame:
    """Per group: whether calibration is used. The raw model has to discriminate (AUC over .52, positive skill), the calibrated one to be no worse and to keep a third of the dispersion."""
    before, after = brier(rows, by, raw, y), brier(rows, by, calibrated, y).select(*by, F.col("brier").alias("_after"))
    spread = rows.groupBy(*by, "date").agg(F.count("*").alias("_n"), F.stddev_pop(raw).alias("_a"), F.stddev_pop(calibrated).alias("_b")).filter("_n >= 3").groupBy(*by).agg(F.avg("_a").alias("_a"), F.avg("_b").alias("_b"))
    all_ = before.join(after, by).join(auc(rows, by, raw, y), by).join(spread, by)
    enabled = (F.col("auc") > 0.52) & (F.col("brier_skill") > 0) & (F.col("_after") <= F.col("brier")) & (F.col("_b") >= F.greatest(F.lit(0.01), F.col("_a") * 0.35))
    return all_.withColumn("enabled", F.coalesce(enabled, F.lit(False)))


def fold_checks(rows: DataFrame, fold: str, p: str = "p", y: str = "y") -> DataFrame:
    """One row: how many folds there are, the share of them that gain on their own rate, and the largest one's share of all gains."""
    each = brier(rows, [fold], p, y).withColumn("_gain", F.col("baseline_brier") - F.col("brier"))
    gain = F.when(F.col("_gain") > 0, F.col("_gain"))
    return each.agg(F.count("*").alias("folds"), F.avg((F.col("_gain") > 0).cast("int")).alias("pass_share"), F.try_divide(F.max(gain), F.sum(gain)).alias("largest_share")).filter("folds > 0")


def block_bootstrap(daily: DataFrame, value: str, *, block: int = 63, repetitions: int = 1000, seed: int = 20260731) -> DataFrame:
    """One row: the mean of `value` over resampled dates and its 95 % bounds. Dates are drawn in moving blocks of `block`; no row with fewer dates.

    The draws are a table of (repetition, place) made in the driver; its size is repetitions * dates / block, which a calendar bounds.
    """
    import math

    import numpy as np

    spark = daily.sparkSession
    placed = daily.select("date", F.col(value).alias("_v")).withColumn("_place", F.row_number().over(Window.orderBy("date")) - 1)  # one row per date
    n = placed.count()
    if n < block:
        return spark.createDataFrame([], "point double, lower double, upper double")
    rng, need = np.random.default_rng(seed), math.ceil(n / block)
    draws = [(r, k * block, int(s)) for r in range(repetitions) for k, s in enumerate(rng.integers(0, n - block + 1, size=need))]
    starts = spark.createDataFrame(draws, "_rep int, _at int, _start int")
    drawn = starts.select("_rep", F.explode(F.sequence(F.lit(0), F.least(F.lit(block), F.lit(n) - F.col("_at")) - 1)).alias("_i"), "_start").select("_rep", (F.col("_start") + F.col("_i")).alias("_place"))
    means = drawn.join(F.broadcast(placed), "_place").groupBy("_rep").agg(F.avg("_v").alias("_m"))
    return means.agg(F.avg("_m").alias("point"), F.percentile("_m", F.lit(0.025)).alias("lower"), F.percentile("_m", F.lit(0.975)).alias("upper"))
