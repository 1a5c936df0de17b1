"""Records that wait until they are due, and are evaluated exactly once, whatever the order in which rows arrive within the watermark's delay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024  # keys share a state in so many parts; fixed while a checkpoint lives


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need; it has to be set when a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Maturing(StatefulProcessor):
    """By bucket of keys: the open records, by the time from which they can mature, and the rows above the watermark that may mature them.

    A row is final when the watermark has reached it, because none before it can come any more. Of a bucket only one timer runs: at the first
    row that will mature a record. Rows that can mature nothing (below every open record's time of their key and below any that can still open)
    are never stored, so the state is bounded by the open records and the rows of the delay. The state of a bucket is one packed table, so
    calls to the store don't grow with the keys. `ttl_ms` drops the rows of keys that nothing comes for, in processing time; none unless it is set.
    """

    def __init__(self, wait_us: int, ttl_ms: int | None):
        self.wait, self.ttl = wait_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packed = handle.getValueState("packed", "held binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows)
        moments = pd.DataFrame({"key": batch["key"], "at": batch["at_us"].astype("int64"), "id": batch["id"].astype("int64"), "waits": False})
        opened = moments[batch["opens"].fillna(False).to_numpy(bool)]
        yield self.settled([moments, opened.assign(at=opened["at"] + self.wait, waits=True)], timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield self.settled([], timerValues)

    def settled(self, new: list[pd.DataFrame], timerValues) -> pd.DataFrame:
        """Records that mature by rows up to the watermark; the state is what remains."""
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        parts = [part.assign(touched=now) for part in new]
        if self.packed.exists():
            before = pa.ipc.open_stream(self.packed.get()[0]).read_pandas()
            parts.insert(0, before[before["touched"] + self.ttl > now] if self.ttl else before)
        if not parts:
            return pd.DataFrame({"id": np.empty(0, np.int64), "matured_by": np.empty(0, np.int64)})
        held = pd.concat(parts, ignore_index=True)
        code, keys = pd.factorize(held["key"], use_na_sentinel=False)
        if self.ttl:
            touched = np.zeros(len(keys), np.int64)
            np.maximum.at(touched, code, held["touched"].to_numpy(np.int64))
            held["touched"] = touched[code]
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        at, ids, waits = held["at"].to_numpy(np.int64), held["id"].to_numpy(np.int64), held["waits"].to_numpy(bool)
        moment, rank = np.unique(at, return_inverse=True)
        place = code.astype(np.int64) * max(1, len(moment)) + rank  # orders (key, time)
        waiting = np.flatnonzero(waits)
        later = np.flatnonzero(~waits)
        later = later[np.lexsort((ids[later], place[later]))]
        first = np.searchsorted(place[later], place[waiting])  # of the rows that may mature each record
        by = np.append(later, -1)[first]
        found = (by >= 0) & (code[by] == code[waiting])
        final = found & (at[by] <= watermark)
        done = pd.DataFrame({"id": ids[waiting[final]], "matured_by": ids[by[final]]})
        coming = at[by[found & ~final]]
        rest = waiting[~final]
        needed = np.full(len(keys), watermark + self.wait)
        np.minimum.at(needed, code[rest], at[rest])
        kept = np.concatenate([rest, later[(at[later] > watermark) & (at[later] >= needed[code[later]])]])
        self.put(held.iloc[kept])
        self.set_timer(int(coming.min()) // 1000 if len(coming) else None)
        return done

    def put(self, held: pd.DataFrame) -> None:
        if len(held):
            table, out = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as w:
                w.write_table(table)
            self.packed.update((out.getvalue().to_pybytes(),))
        elif self.packed.exists():
            self.packed.clear()

    def set_timer(self, ms: int | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == ms:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def close(self) -> None:
        pass


def matured(rows: DataFrame, key: str, at: str, row_id: str, opens: str, wait: pd.Timedelta, delay: str, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(row_id, matured_by): for each row whose flag `opens` is true, the first row of its key, by (at, row_id), that is `wait` or more after it.

    A pair appears when the watermark (latest time less `delay`) has reached the row that matures; rows that come later than that are left
    out, and so are rows without key, time or id.
    """
    use_rocksdb(rows.sparkSession)
    known = rows.withWatermark(at, delay).filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(row_id).isNotNull())
    small = known.select(F.col(key).alias("key"), at, F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(row_id).cast("long").alias("id"), F.col(opens).alias("opens"))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = small.groupBy("bucket").transformWithStateInPandas(Maturing(int(wait.value // 1000), ttl_ms), "id long, matured_by long", "append", "eventTime")
    return found.withColumnRenamed("id", row_id)
