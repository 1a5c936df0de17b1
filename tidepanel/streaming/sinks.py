"""Sinks of micro-batches in the shared folder, each of which gives the same result when a batch is replayed.

A batch writes a folder of its own, named by its number, and overwrites that folder when it runs again. So a lost executor or driver
repeats work, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.session import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files under `path` (a folder, file or pattern) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drained(rows: DataFrame, each: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None) -> list:
    """Runs the stream over all that its source has now; `each` gets every micro-batch with its number. With the same checkpoint nothing is read twice.

    Gives the run's last progress reports.
    """
    spark = rows.sparkSession
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_folder(spark, "stream")).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query.recentProgress


def latest_result(rows: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """The whole result of a complete-mode aggregation after the last batch."""
    spark, folder, last = rows.sparkSession, new_folder(rows.sparkSession, "complete"), []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        last.append(number)

    drained(rows, each, "complete", checkpoint)
    if not last:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{folder}/{max(last)}")


def appended_once(rows: DataFrame, key: str, folder: str, source: str, checkpoint: str | None = None) -> DataFrame:
    """Appends the rows whose key no other batch of the store holds, one row a key, and returns the store.

    A batch is known by its source and number: running it again overwrites its own part, and a second source with the same rows adds nothing.
    """
    spark, schema = rows.sparkSession, rows.schema

    def each(batch: DataFrame, number: int) -> None:
        name = f"{source}-{number}"
        fresh = batch.dropDuplicates([key])
        if _exists(spark, folder):
            held = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(folder)
            fresh = fresh.join(held.filter(F.col("batch") != name).select(key), key, "left_anti").select(*rows.columns)
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={name}")

    if "batch" in schema.names:
        raise ValueError("the store's own column is named batch")
    drained(rows, each, "append", checkpoint)
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).select(*rows.columns)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
