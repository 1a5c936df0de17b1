"""Trailing-window features of a panel, by code. All windows are of rows; a missing input gives null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WARM_UP = 60  # sessions before the first feature row


def trailing(first: int, last: int = 0):
    return Window.partitionBy("code").orderBy("date").rowsBetween(first, last)


def series() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def cross() -> WindowSpec:
    return Window.partitionBy("date")


def change(column: str, back: int) -> Column:
    """Relative change over `back` rows; null without the earlier value or when it is zero."""
    return F.try_divide(F.col(column), F.lag(column, back).over(series())) - 1


def complete_mean(column: str, first: int, last: int) -> Column:
    """Mean of a frame, null unless all of its rows are there and not null."""
    frame = trailing(first, last)
    return F.when(F.count(column).over(frame) == last - first + 1, F.avg(column).over(frame))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def trailing_features(panel: DataFrame) -> DataFrame:
    """`panel` with session (from 0) and the nine raw features; one sort by (code, date) serves them all."""
    out = panel.select(
        "*",
        (F.row_number().over(series()) - 1).alias("session"),
        change("close", 1).alias("ret"),
        change("close", 5).alias("momentum5"),
        change("close", 20).alias("momentum20"),
        change("close", 60).alias("momentum60"),
        (-change("close", 1)).alias("reversal1"),
        F.when(F.count("close").over(trailing(-59)) == 60, F.col("close") / F.max("close").over(trailing(-59)) - 1).alias("drawdown60"),
        log_ratio(complete_mean("amount", -4, 0), complete_mean("amount", -24, -5)).alias("amount_ratio"),
        log_ratio(complete_mean("volume", -4, 0), complete_mean("volume", -24, -5)).alias("volume_ratio"),
    )
    volatility = F.when(F.count("ret").over(trailing(-19)) >= 15, F.stddev_pop("ret").over(trailing(-19)))
    return out.withColumn("volatility20", volatility).withColumn("acceleration", F.col("momentum5") * F.col("amount_ratio"))


FEATURES = ["momentum5", "momentum20", "momentum60", "reversal1", "volatility20", "drawdown60", "amount_ratio", "volume_ratio", "acceleration"]


def feature_rows(panel: DataFrame) -> DataFrame:
    """(date, code, nine features) from the warm-up on, rows with a missing feature left out."""
    known = F.lit(True)
    for f in FEATURES:
        known = known & F.col(f).isNotNull()
    return trailing_features(panel).filter((F.col("session") >= WARM_UP) & known).select("date", "code", *FEATURES)


def z_score(column: str, over: WindowSpec | None = None) -> Column:
    """Population z-score; no spread counts as a spread of one."""
    over = over or cross()
    return (F.col(column) - F.avg(column).over(over)) / F.coalesce(F.nullif(F.stddev_pop(column).over(over), F.lit(0.0)), F.lit(1.0))


def cross_section(features: DataFrame, size: int, columns: list[str] | None = None) -> DataFrame:
    """z-scores of the columns as `z_<column>` on dates that have all `size` codes."""
    columns = columns or FEATURES
    whole = features.withColumn("_n", F.count("*").over(cross())).filter(F.col("_n") == size)
    return whole.select(*[c for c in features.columns], *[z_score(c).alias(f"z_{c}") for c in columns])


def nonlinear_terms() -> dict[str, Column]:
    """The eight products and differences of z-scores that models may use beside them (the pairs are fixed values)."""
    z = lambda name: F.col(f"z_{name}")
    return {
        "momentum_acceleration": z("momentum5") - z("momentum20"),
        "trend_acceleration": z("momentum20") - z("momentum60"),
        "momentum5_amount": z("momentum5") * z("amount_ratio"),
        "momentum20_volume": z("momentum20") * z("volume_ratio"),
        "trend_drawdown": z("momentum20") * z("drawdown60"),
        "reversal_volatility": z("reversal1") * z("volatility20"),
        "momentum5_square": z("momentum5") * z("momentum5"),
        "drawdown_square": z("drawdown60") * z("drawdown60"),
    }


def universe_size(panel: DataFrame) -> int:
    """The number of codes: one number, read before the plan is made."""
    return panel.select("code").distinct().count()


def price_rows(panel: DataFrame) -> DataFrame:
    """Features that need exactly 20 returns and let a drawdown expand up to 60 rows."""
    base = panel.select("*", change("close", 1).alias("return1"), change("close", 5).alias("return5"), change("close", 20).alias("return20"), (F.lead("close", 1).over(series()) / F.col("close") - 1).alias("next1"))
    return base.select(
        "date", "code", "return1", "return5", "return20", "next1",
        F.when(F.count("return1").over(trailing(-19)) == 20, F.stddev_pop("return1").over(trailing(-19))).alias("volatility20"),
        (F.col("close") / complete_mean("close", -19, 0) - 1).alias("distance20"),
        (F.col("close") / complete_mean("close", -59, 0) - 1).alias("distance60"),
        (F.col("close") / F.max("close").over(trailing(-59)) - 1).alias("drawdown60"),
    )


def session_faults(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """(code, missing) of the codes that lack sessions of the benchmark; relative rows of such codes are not comparable. Only counts are needed, since sessions are distinct."""
    sessions = bench.select("date").distinct()
    all_ = sessions.agg(F.count("*").alias("_all"), F.lit(1).alias("_k"))
    own = panel.join(F.broadcast(sessions), "date", "left_semi").groupBy("code").agg(F.countDistinct("date").alias("_own"), F.lit(1).alias("_k"))  # one row per session
    return own.join(F.broadcast(all_), "_k").select("code", (F.col("_all") - F.col("_own")).alias("missing")).filter("missing > 0")


def moving_average(panel: DataFrame, period: int) -> DataFrame:
    return panel.select("date", "code", complete_mean("close", -(period - 1), 0).alias("average"))


def aligned(panel: DataFrame, bench: DataFrame, last: int = 25) -> DataFrame:
    """Panel and benchmark on their common dates, the newest `last` rows of each code."""
    other = bench.select("date", *[F.col(c).alias(f"bench_{c}") for c in ("close", "volume", "amount")])
    both = panel.join(other, "date")
    newest = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return both.withColumn("_turn", newest).filter(F.col("_turn") <= last).drop("_turn")


def history_metrics(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Per code: 5 against 20 earlier rows for amount, volume and share of the benchmark's amount; relative return over 5."""
    rows = aligned(panel, bench).withColumn("share", F.try_divide("amount", "bench_amount")).withColumn("_turn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date"))))
    late, early = F.col("_turn") <= 5, F.col("_turn").between(6, 25)
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    at = lambda c, t: F.max(F.when(F.col("_turn") == t, F.col(c)))
    return rows.groupBy("code").agg(
        *[F.try_divide(mean(c, late), mean(c, early)).alias(f"{c}_5_20") for c in ("amount", "volume", "share")],
        (at("close", 1) / at("close", 6) - at("bench_close", 1) / at("bench_close", 6)).alias("relative5"),
        F.count("*").alias("rows"),
    )


def average_ranks(column: str, over) -> Column:
    """Ascending ranks, equal values sharing the mean of theirs. `over`: the partition."""
    return F.rank().over(over.orderBy(column)) + (F.count("*").over(Window.partitionBy("date", column)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null without variance (the built-in one divides by zero)."""
    cov = F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)
    return F.try_divide(cov, F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def rank_correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Per date with three rows or more: Spearman's correlation of two columns."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.withColumn("_a", average_ranks(a, cross())).withColumn("_b", average_ranks(b, cross()))
    return ranked.groupBy("date").agg(F.count("*").alias("n"), correlation("_a", "_b").alias("ic")).filter("n >= 3")


def leaders(metrics: DataFrame, count: int) -> DataFrame:
    """The codes with the largest product of the amount, volume and share ratios of `history_metrics`; ties by code."""
    product = F.col("amount_5_20") * F.col("volume_5_20") * F.col("share_5_20")
    return metrics.withColumn("product", F.round(product, 9)).filter("product is not null").orderBy(F.desc("product"), "code").limit(count)


def latest(rows: DataFrame, key: str = "code", by: str = "date") -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by)))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def blocks(dates: DataFrame, size: int = 63) -> DataFrame:
    """Dates with the number of their block of `size` sessions."""
    return dates.select("date", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / size).cast("long").alias("block"))


def longest_run(rows: DataFrame, flag: Column) -> DataFrame:
    """Per code: the longest run of rows on which `flag` is true."""
    marked = rows.withColumn("_on", flag).withColumn("_all", F.row_number().over(series()))
    marked = marked.withColumn("_own", F.row_number().over(Window.partitionBy("code", "_on").orderBy("date")))
    runs = marked.groupBy("code", (F.col("_all") - F.col("_own")).alias("_run"), "_on").agg(F.count("*").alias("n"))
    return runs.groupBy("code").agg(F.coalesce(F.max(F.when(F.col("_on"), F.col("n"))), F.lit(0)).cast("long").alias("longest"))
