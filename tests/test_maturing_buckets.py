"""Keys that share a state mature as each alone, and calls to the state store don't grow with the keys."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from tidepanel.streaming.maturing import Maturing, matured
from tidepanel.streaming.sinks import new_folder
from tidepanel.streaming.watermarks import closed_windows, in_arrivals

T0 = datetime.datetime(2026, 1, 1)
HOUR = datetime.timedelta(hours=1)


class Store:
    """A value state and the handle of a processor, counting calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema, ttl=None):
        state = Store()
        self.states = [*getattr(self, "states", []), state]
        return state

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, ms):
        self.calls += 1

    deleteTimer = registerTimer


class Clock:
    def __init__(self, watermark, now=0):
        self.watermark, self.now = watermark, now

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getCurrentProcessingTimeInMs(self):
        return self.now


def run(processor, rows, clock):
    df = pd.DataFrame(rows, columns=["key", "at_us", "id", "opens"])
    return sorted(tuple(r) for part in processor.handleInputRows((0,), iter([df]), clock) for r in part.to_numpy().tolist())


def test_calls_to_the_store_do_not_grow_with_keys():
    counts = []
    for n in (3, 3_000):
        handle, p = Store(), Maturing(10, None)
        p.init(handle)
        assert run(p, [(f"k{i}", 5, i, True) for i in range(n)], Clock(0)) == []
        assert run(p, [(f"k{i}", 20, n + i, None) for i in range(n)], Clock(1)) == [(i, n + i) for i in range(n)]
        counts.append(handle.calls + sum(s.calls for s in handle.states))
    assert counts[0] == counts[1]


def test_rows_of_quiet_keys_go_after_their_time():
    handle, p = Store(), Maturing(10, 100)
    p.init(handle)
    run(p, [("a", 5, 1, True), ("b", 5, 2, True)], Clock(0, 1))
    run(p, [("b", 6, 3, False)], Clock(0, 90))
    assert run(p, [("a", 20, 4, False), ("b", 20, 5, False)], Clock(1, 120)) == [(2, 5)]


def test_few_buckets_give_what_many_give(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh"), T0 + HOUR * (10 * a + rng.randint(0, 15)), 100 * a + i, rng.random() < 0.5, a) for a in range(3) for i in range(40)]
    df, out = spark.createDataFrame(rows, "k string, at timestamp, id long, opens boolean, arrival int"), []
    for buckets in (1, 64):
        folder = new_folder(spark, "m")
        in_arrivals(df, F.col("arrival"), closed_windows(lambda s: matured(s, "k", "at", "id", "opens", pd.Timedelta(hours=7), "31 hours", buckets=buckets), folder, new_folder(spark, "c")))  # noqa: B023
        out.append(sorted((r["id"], r["matured_by"]) for r in spark.read.parquet(folder).collect()))
    assert out[0] == out[1]
