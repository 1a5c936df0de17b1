"""Event time: arrivals out of order, windows that close at the watermark, and the rows that came too late.

A stream is run arrival by arrival (`availableNow` with one checkpoint), as a job does that is started whenever new files are there. The
watermark of an arrival is the latest event time of all arrivals before it, less the delay. Windows are emitted once, when the watermark
passes their end, and their state goes with them, so state holds the windows of the last `delay` at most, however long the stream
has run. Rows of windows that are closed are not silently gone: `labelled` keeps every row with its status in a table beside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.streaming.sinks import drained, new_folder, stream


def in_arrivals(rows: DataFrame, arrival: Column, run: Callable[[DataFrame], object]) -> None:
    """Writes the rows arrival by arrival, in the order of that number, and calls `run` with the stream of all files so far after each.

    It stands for files that come in from elsewhere; arrivals are few (they are listed by the driver), their rows are not.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "arrivals")
    marked = rows.withColumn("_arrival", arrival)
    for (number,) in marked.select("_arrival").distinct().orderBy("_arrival").collect():
        marked.filter(F.col("_arrival").eqNullSafe(F.lit(number))).drop("_arrival").write.mode("append").parquet(folder)
        run(stream(spark, folder, rows.schema))


def closed_windows(result: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> Callable[[DataFrame], list]:
    """A run of `result` (a stream with a watermark, aggregated) that appends what has closed to `folder`, one part for each batch; gives the run's progress."""

    def run(source: DataFrame) -> list:
        return drained(result(source), lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}"), "append", checkpoint)

    return run


def labelled(at: str, delay: str, folder: str, checkpoint: str, *, end: Column | None = None, late: str = "late", fresh: str = "fresh") -> Callable[[DataFrame], list]:
    """A run that keeps every row of the stream in `folder`/rows with `status`: `late` if `end` (its own time unless given) isn't after the watermark.

    The watermark is that of all earlier batches, from one small row that each batch leaves in `folder`/marks. A batch that runs again finds
    the same marks before it and overwrites its own rows.
    """
    end = F.col(at) if end is None else end

    def run(source: DataFrame) -> list:
        spark = source.sparkSession
        marks = T.StructType([T.StructField("latest", T.TimestampType()), T.StructField("batch", T.LongType())])

        def each(batch: DataFrame, number: int) -> None:
            batch.agg(F.max(at).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
            latest = spark.read.schema(marks).parquet(f"{folder}/marks").filter(F.col("batch") < number).agg(F.max("latest")).first()[0]
            watermark = F.date_trunc("millisecond", F.lit(latest).cast("timestamp")) - F.expr(f"INTERVAL {delay}")
            status = F.when(end <= watermark, late).otherwise(fresh)
            batch.withColumn("status", status).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

        return drained(source, each, "append", checkpoint)

    return run


def latest_of_keys(keys: list[str], order: list[str], value: str, folder: str, checkpoint: str) -> Callable[[DataFrame], list]:
    """A run that keeps, for each batch, its newest `value` and its number of rows by key, without any state in the stream; `merged_keys` reads them."""

    def run(source: DataFrame) -> list:
        def each(batch: DataFrame, number: int) -> None:
            newest = batch.groupBy(*keys).agg(F.max(F.struct(*dict.fromkeys([*order, value]))).alias("newest"), F.count("*").alias("n"))
            newest.write.mode("overwrite").parquet(f"{folder}/batch={number}")

        return drained(source, each, "append", checkpoint)

    return run


def merged_keys(newest: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key the newest `value` of all batches and how many rows it superseded."""
    return newest.groupBy(*keys).agg(F.max("newest").alias("newest"), F.sum("n").alias("n")).select(*keys, F.col(f"newest.{value}").alias(value), (F.col("n") - 1).alias("superseded"))
