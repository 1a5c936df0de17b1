"""Cleaning and checking of bars and cross-sections.

Cases: a null or malformed date is an invalid date; a missing price is invalid OHLC; of repeated dates the last valid row stays; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import valid_ohlc


def reject_reason(launch: str | None = None, as_of: str | None = None) -> Column:
    """Why a raw bar (date text, open, high, low, close) is refused: invalidDate, preLaunch, future, invalidOhlc; null if it isn't."""
    day = F.when(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("date").try_cast("date"))
    high, low = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    known = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    why = F.when(day.isNull(), "invalidDate")
    if launch:
        why = why.when(F.col("date") < launch, "preLaunch")
    if as_of:
        why = why.when(F.col("date") > as_of, "future")
    return why.when(~known | (F.col("high") < high) | (F.col("low") > low), "invalidOhlc")


def clean_bars(rows: DataFrame, by: list[str], sequence: str, launch: str | None = None, as_of: str | None = None) -> DataFrame:
    """The last accepted row of each key and date."""
    good = rows.filter(reject_reason(launch, as_of).isNull())
    kept = [c for c in rows.columns if c not in (*by, "date")]
    last = good.groupBy(*by, "date").agg(F.max_by(F.struct(*kept), F.col(sequence)).alias("_last"))
    return last.select(*by, "date", *[F.col(f"_last.{c}").alias(c) for c in kept])


def reject_counts(rows: DataFrame, by: list[str], sequence: str, launch: str, as_of: str) -> DataFrame:
    """Per key: how many rows came, were refused for each reason, were repeats of a date, and stayed."""
    marked = rows.withColumn("_why", reject_reason(launch, as_of))
    names = ("invalidDate", "preLaunch", "future", "invalidOhlc")
    out = marked.groupBy(*by).agg(
        F.count("*").alias("input"), *[F.count_if(F.col("_why") == n).alias(n) for n in names], F.countDistinct(F.when(F.col("_why").isNull(), F.col("date"))).alias("rows"), F.count_if(F.col("_why").isNull()).alias("_good"),
    )
    return out.select(*by, "input", *names, (F.col("_good") - F.col("rows")).alias("duplicates"), "rows")


def source_status(rows: Column, least: int) -> Column:
    """ready from `least` rows on, partial below, unavailable without any."""
    return F.when(rows >= least, "ready").when(rows > 0, "partial").otherwise("unavailable")


def is_complete_close(date: Column, stamp: Column, target: Column) -> Column:
    """Whether a quote is of the target date and of 14:57:00 or later; the stamp has 14 digits."""
    return F.coalesce((date == target) & stamp.rlike("^[0-9]{14}$") & (F.substring(stamp, 9, 6) >= "145700"), F.lit(False))


def without_echo(panel: DataFrame) -> DataFrame:
    """`panel` without the first row of a code that repeats the second one's close, volume and amount."""
    order = Window.partitionBy("code").orderBy("date")
    same = F.lit(True)
    for c in ("close", "volume", "amount"):
        same = same & F.col(c).eqNullSafe(F.lead(c).over(order))
    marked = panel.withColumn("_turn", F.row_number().over(order)).withColumn("_same", same & F.lead("code").over(order).isNotNull())
    return marked.filter(~((F.col("_turn") == 1) & F.col("_same"))).drop("_turn", "_same")


def cross_section_faults(panel: DataFrame, codes: list[str]) -> DataFrame:
    """(date, rows, codes, missing, repeated) of the dates whose rows are not each of the codes once."""
    known = F.col("code").isin(*codes)
    each = panel.groupBy("date").agg(F.count("*").alias("rows"), F.countDistinct("code").alias("codes"), F.countDistinct(F.when(known, F.col("code"))).alias("_known"))
    out = each.select("date", "rows", "codes", (F.lit(len(codes)) - F.col("_known")).alias("missing"), (F.col("rows") - F.col("codes")).alias("repeated"))
    return out.filter((F.col("missing") > 0) | (F.col("rows") != len(codes)) | (F.col("codes") != len(codes)))


def usable_features(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, present, usable): usable with 20 values or 2 % of the rows, whichever is more. One pass over the rows."""
    counts = rows.agg(F.count("*").alias("_n"), *[F.count(f).alias(f) for f in features])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("present")) for f in features])).alias("_p")
    least = F.greatest(F.lit(20), F.floor(F.col("_n") * 0.02))
    return counts.select("_n", pairs).select("_p.feature", "_p.present", ((F.col("_p.present") >= least) & (F.col("_n") > 0)).alias("usable"))


def bar_faults(bars: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """Bars that are not valid, or not after the bar before them in their own order `sequence`."""
    before = F.lag(date).over(Window.partitionBy(*by).orderBy("sequence"))
    fault = F.when(~valid_ohlc(F.col("open"), F.col("high"), F.col("low"), F.col("close"), 0.0), "ohlc").when(F.col(date) <= before, "order")
    return bars.withColumn("fault", fault).filter("fault is not null")
