"""What the Arrow-batched operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.session import cut

SLICE_BYTES = 2 << 20  # text that a task works on at once; memory, not results, depends on it

BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """The rows of `docs` whose id isn't in the one column of `ids`; a null id is a value.

    The ids are counted; up to BROADCAST_IDS go to where the documents are, more of them meet the documents by shuffle.
    """
    bad = cut(ids.toDF("_bad").distinct())
    few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, docs[doc_id].eqNullSafe(bad["_bad"]), "left_anti")


def placed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """`rows` with `at`, the place of each among the rows of its `key`, from 0, and `size`, the number of those rows.

    The order is that of a range partitioning, so a key with most of the rows lies in many tasks; the rows are written once, and only counts
    per partition are added up. They meet the rows by broadcast up to BROADCAST_IDS of them, counted first.
    """
    ranged = cut(rows.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_part").agg(F.count("*").alias("_own"))
    every = Window.partitionBy(key)  # one row per partition; few keys lie in more than one
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(counts.select(key, "_part", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_before"), F.sum("_own").over(every).alias("size")))
    small = before.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = ranged.withColumn("at", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1)
    return own.join(F.broadcast(before) if small else before, [key, "_part"]).withColumn("at", F.col("at") + F.col("_before")).drop("_part", "_before")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column with about `limit` bytes each; a longer value stands alone."""
    n = len(column)
    if not n:
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < n:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, last
        first = last


def release() -> None:
    """Gives memory that a finished task no longer uses back to the machine: workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def add_columns(df: DataFrame, text: str, added: T.StructType, work: Callable[[list], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the columns that `work` makes of the values of column `text`, slice by slice.

    A column of `df` that has the name of an added one is replaced. Nulls reach `work` as None.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    source = df.select(*[df[c] for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([*[source.schema[c] for c in keep], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, last in slices(column):
                part = batch.slice(first, last - first)
                made = work(column.slice(first, last - first).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], *made], names=schema.names)
        release()

    return source.mapInArrow(run, schema)
