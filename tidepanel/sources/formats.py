"""Readers of loose formats: wrapped JSON, delimited payloads, arrays of arrays, columns under other names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_bars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Bars from (gzip) CSV with a fixed schema; rows without a positive close are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(folder, header=True).filter("close is not null and close > 0")


def first_alias(df: DataFrame, names: list[str]) -> Column:
    """The first value that isn't null among the columns with these names, upper and lower case alike."""
    by_lower = {c.lower(): c for c in df.columns}
    return F.coalesce(*[F.col(by_lower[n.lower()]) for n in names if n.lower() in by_lower])


def wrapped_rows(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows of the first of records, rows, data and datas that a JSON payload has."""
    keys = ("records", "rows", "data", "datas")
    parsed = F.from_json(payload, T.StructType([T.StructField(k, T.ArrayType(T.StructType.fromDDL(schema))) for k in keys]))
    return df.withColumn("_p", parsed).withColumn("_r", F.explode(F.coalesce(*[F.col(f"_p.{k}") for k in keys]))).select(*[c for c in df.columns if c != payload], "_r.*")


def delimited_rows(df: DataFrame, payload: str, cells: list[tuple[str, str]], row: str = ";", cell: str = ",") -> DataFrame:
    """Rows of a payload cut at `row` and `cell`; cells by place, a missing or bad cell is null."""
    rows = df.withColumn("_r", F.explode(F.split(payload, row))).withColumn("_c", F.split("_r", cell))
    return rows.select(*[c for c in df.columns if c != payload], *[F.get("_c", i).try_cast(t).alias(n) for i, (n, t) in enumerate(cells)])


def kline_rows(df: DataFrame, body: str) -> DataFrame:
    """(date, close) rows of a JSON array of arrays of text."""
    rows = df.withColumn("_r", F.explode(F.from_json(body, "array<array<string>>")))
    return rows.select(*[c for c in df.columns if c != body], F.get("_r", 0).try_cast("date").alias("date"), F.get("_r", 1).try_cast("double").alias("close"))
