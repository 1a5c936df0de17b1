"""Streams over several files out of order: windows that close, late rows, idempotent appends, and records that mature across batches."""

import datetime
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from tidepanel.streaming.maturing import matured
from tidepanel.streaming.sinks import appended_once, drained, latest_result, new_folder, stream
from tidepanel.streaming.watermarks import closed_windows, in_arrivals, labelled, latest_of_keys, merged_keys

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, id long, opens boolean"
HOUR = datetime.timedelta(hours=1)


def files(spark, tmp_path, parts):
    """One file for each part, in the order of their times."""
    import time

    folder = str(tmp_path / "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame([(k, T0 + h * HOUR, n, o) for k, h, n, o in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        new = [f for f in os.listdir(folder) if f.endswith(".parquet") and not os.path.exists(f"{folder}/.{f}.seen")]
        for f in new:
            open(f"{folder}/.{f}.seen", "w").close()
            os.utime(f"{folder}/{f}", (time.time() - 1000 + i, time.time() - 1000 + i))
    return folder


PARTS = [
    [("a", 0, 1, True), ("a", 1, 2, True), ("b", 0, 3, True), (None, 0, 4, True)],
    [("a", 24, 5, False), ("b", 23, 6, True)],
    [("a", 24, 7, False), ("a", 25, 8, False), ("b", 23, 9, False)],
    [("b", 60, 10, False), ("a", 90, 11, True)],
]


def out_of_order(days, late, seed):
    """Rows of 24 a day with the number of the arrival (one a day), up to `late` hours after their own time."""
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), T0 + datetime.timedelta(minutes=rng.randrange(days * 1440)), n, rng.random() < 0.3) for n in range(days * 24)]
    return [(*r, int(((r[1] - T0) + rng.random() * late * HOUR) / (24 * HOUR))) for r in rows]


def watermarks(rows, delay):
    """The watermark that each arrival meets, and the last one."""
    out, latest = {}, None
    for n in sorted({r[4] for r in rows}):
        out[n] = latest - delay if latest else datetime.datetime(1970, 1, 1)
        latest = max([r[1] for r in rows if r[4] == n] + ([latest] if latest else []))
    return out, latest - delay


def test_windows_close_once_and_their_state_goes(spark):
    rows = out_of_order(6, 40, 1)
    df = spark.createDataFrame(rows, SCHEMA + ", arrival int")
    folder, aside, progress = new_folder(spark, "w"), new_folder(spark, "l"), []
    of = lambda s: s.withWatermark("at", "12 hours").groupBy(F.window("at", "2 hours").alias("w"), "k").agg(F.count("*").alias("n")).select("w.start", "k", "n")
    run, keep = closed_windows(of, folder, new_folder(spark, "c")), labelled("at", "12 hours", aside, new_folder(spark, "c"), end=F.window("at", "2 hours")["end"])

    def each(source):
        progress.extend(run(source))
        keep(source)

    in_arrivals(df, F.col("arrival"), each)
    before, last = watermarks(rows, 12 * HOUR)
    start = lambda at: at.replace(hour=at.hour // 2 * 2, minute=0)
    on_time, late = {}, set()
    for k, at, n, _, arrival in rows:
        if start(at) + 2 * HOUR <= before[arrival]:
            late.add(n)
        elif start(at) + 2 * HOUR <= last:
            on_time[start(at), k] = on_time.get((start(at), k), 0) + 1
    assert {(r["start"], r["k"]): r["n"] for r in spark.read.parquet(folder).collect()} == on_time and len(late) > 10
    kept = spark.read.parquet(f"{aside}/rows").collect()
    assert len(kept) == len(rows) and {r["id"] for r in kept if r["status"] == "late"} == late
    states = [p["stateOperators"][0] for p in progress]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) >= 1
    # After an arrival only windows of the delay and of the arrival itself are open, though 6 days of 12 windows and 3 keys have come.
    assert states[-1]["numRowsTotal"] <= 12 / 2 * 3 + 3 < len(on_time) / 3
    assert max(s["numRowsTotal"] for s in states) <= (12 + 24 + 40) / 2 * 3 + 3


def test_rows_keep_their_status_when_a_batch_runs_again(spark):
    rows = out_of_order(4, 60, 2)
    df, aside = spark.createDataFrame(rows, SCHEMA + ", arrival int"), new_folder(spark, "l")
    for checkpoint in (new_folder(spark, "c"), new_folder(spark, "c")):  # all batches again, from the first
        in_arrivals(df, F.col("arrival"), labelled("at", "6 hours", aside, checkpoint))
    before, _ = watermarks(rows, 6 * HOUR)
    late = {r[2] for r in rows if r[1] <= before[r[4]]}
    kept = spark.read.parquet(f"{aside}/rows").collect()
    assert sorted(r["id"] for r in kept) == sorted(r[2] for r in rows) and {r["id"] for r in kept if r["status"] == "late"} == late and late


def brute_matured(rows, wait, last):
    out = []
    for k, at, n, opens, *_ in rows:
        later = [(b, m) for j, b, m, *_ in rows if j == k and k is not None and b >= at + wait]
        if opens and later and min(later)[0] <= last:
            out.append((n, min(later)[1]))
    return sorted(out)


def test_records_mature_once_in_any_order_and_after_restarts(spark):
    for seed in (3,):
        rows = out_of_order(5, 30, seed)
        rows.append((None, T0 + HOUR, 9_999, True, 0))
        df, folder, progress = spark.createDataFrame(rows, SCHEMA + ", arrival int"), new_folder(spark, "m"), []
        run = closed_windows(lambda s: matured(s, "k", "at", "id", "opens", pd.Timedelta(hours=7), "31 hours"), folder, new_folder(spark, "c"))
        in_arrivals(df, F.col("arrival"), lambda s: progress.extend(run(s)))  # each arrival starts anew from the checkpoint
        _, last = watermarks(rows, 31 * HOUR)
        assert sorted((r["id"], r["matured_by"]) for r in spark.read.parquet(folder).collect()) == brute_matured(rows, 7 * HOUR, last)
        assert len(progress) >= 5


def test_records_of_one_batch_with_ties(spark, tmp_path):
    source, folder = files(spark, tmp_path, PARTS), new_folder(spark, "m")
    rows = matured(stream(spark, source, spark.createDataFrame([], SCHEMA).schema), "k", "at", "id", "opens", pd.Timedelta(days=1), "0 seconds")
    drained(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}"), "append")
    assert sorted((r["id"], r["matured_by"]) for r in spark.read.parquet(folder).collect()) == [(1, 5), (2, 8), (3, 10), (6, 10)]


def test_newest_of_each_key_without_state(spark):
    rows = out_of_order(3, 30, 5)
    df, folder, progress = spark.createDataFrame(rows, SCHEMA + ", arrival int"), new_folder(spark, "r"), []
    run = latest_of_keys(["k"], ["at", "id"], "id", folder, new_folder(spark, "c"))
    in_arrivals(df, F.col("arrival"), lambda s: progress.extend(run(s)))
    newest = {r[0]: max((x[1], x[2]) for x in rows if x[0] == r[0])[1] for r in rows}
    found = merged_keys(spark.read.parquet(folder).drop("batch"), ["k"], "id").collect()
    assert {r["k"]: r["id"] for r in found} == newest
    assert {r["k"]: r["superseded"] for r in found} == {k: sum(r[0] == k for r in rows) - 1 for k in newest}
    assert all(not p["stateOperators"] for p in progress)


def test_a_store_holds_each_key_once(spark, tmp_path):
    source, folder, state = files(spark, tmp_path, [*PARTS, PARTS[0]]), new_folder(spark, "s"), new_folder(spark, "c")
    rows = stream(spark, source, spark.createDataFrame([], SCHEMA).schema, 1)
    for name, checkpoint in (("x", state), ("x", state), ("x", None), ("y", None)):
        store = appended_once(rows, "id", folder, name, checkpoint)
        assert sorted(r["id"] for r in store.collect()) == list(range(1, 12))


def test_windows_of_all_batches(spark, tmp_path):
    rows = stream(spark, files(spark, tmp_path, PARTS), spark.createDataFrame([], SCHEMA).schema, 1)
    found = latest_result(rows.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n"))
    assert {r["start"]: r["n"] for r in found.collect()} == {T0: 6, T0 + datetime.timedelta(1): 3, T0 + datetime.timedelta(2): 1, T0 + datetime.timedelta(3): 1}
