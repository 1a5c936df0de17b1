"""Time-series panels made of the driver's tables: (date, code, close, volume, amount) and a benchmark without code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.scalars import rounded
from tidepanel.session import table


def _bars(rows: DataFrame, *keys: Column) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy(*keys).agg(
        rounded(F.sum(net) / F.sum("l_quantity"), 6).alias("close"), rounded(F.sum("l_quantity"), 4).alias("volume"), rounded(F.sum("l_extendedprice"), 4).alias("amount")
    )


def _week(column: str) -> Column:
    return F.date_trunc("week", column).cast("date").alias("date")


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each part brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    return _bars(lines.join(part, lines["l_partkey"] == part["p_partkey"]), _week("l_shipdate"), F.col("code"))


def flag_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each return flag: complete even at the smallest scale."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice", "l_discount", "l_quantity", F.col("l_returnflag").alias("code"))
    return _bars(lines, _week("l_shipdate"), F.col("code"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of everything: its dates are the trading calendar, and it is no member of the universe."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    return _bars(lines, _week("l_shipdate"))


def priority_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each order priority: mean price, count and sum."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(_week("o_orderdate"), F.col("o_orderpriority").alias("code")).agg(
        rounded(F.avg("o_totalprice"), 6).alias("close"), F.count("*").cast("double").alias("volume"), rounded(F.sum("o_totalprice"), 4).alias("amount")
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type; many cells are missing."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", "ts").alias("date"), F.col("event_type").alias("code")).agg(
        rounded(F.avg("value"), 6).alias("close"), F.count("*").cast("double").alias("volume"), rounded(F.sum("value"), 4).alias("amount")
    )
