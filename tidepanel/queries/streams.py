"""Streaming queries (W1 to W7): each drains the events as a stream and returns what its sink holds."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from tidepanel.queries.registry import query
from tidepanel.session import table
from tidepanel.streaming.maturing import matured
from tidepanel.streaming.sinks import appended_once, new_folder, stream
from tidepanel.streaming.watermarks import closed_windows, in_arrivals, labelled, latest_of_keys, merged_keys

c = F.col


def events(spark, d):
    """The events as a stream. The last letter is a pattern, because a stream reads folders or patterns."""
    return stream(spark, os.path.join(d, "events.parque[t]"), table(spark, d, "events").schema)


def arrival():
    """Event e arrives in blocks of ten days, every tenth one three days late; the watermark of an arrival is made of those before it."""
    return F.floor((F.unix_date(F.to_date("ts")) + F.when(c("event_id") % 10 == 0, 3).otherwise(0)) / 10)


def arrivals_sql(days: int) -> str:
    """CTEs: a has the events with `arrival` and `wm`, the watermark that they meet; z the last one."""
    return f"""WITH n AS (SELECT *, (epoch_us(ts) // 86400000000 + CASE WHEN event_id % 10 = 0 THEN 3 ELSE 0 END) // 10 AS arrival FROM events),
    b AS (SELECT arrival, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL {days} DAY AS wm FROM n GROUP BY arrival),
    a AS (SELECT n.*, coalesce(wm, TIMESTAMP '1970-01-01') AS wm FROM n JOIN b USING (arrival)), z AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {days} DAY AS wm FROM events)"""


def closed(spark, d, result):
    """What `result` has emitted after all arrivals."""
    folder, seen = new_folder(spark, "closed"), []

    def watched(source):
        seen[:] = [result(source.withColumn("ts", c("ts").cast("timestamp")))]
        return seen[0]

    in_arrivals(table(spark, d, "events"), arrival(), closed_windows(watched, folder, new_folder(spark, "stream")))
    return spark.read.schema(seen[0].schema).parquet(folder).select(*seen[0].columns)


@query(
    "w1_tumbling_windows",
    f"""{arrivals_sql(1)} SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM a
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > wm AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT wm FROM z) GROUP BY 1, 2""",
)
def w1(spark, d):
    """Hours that the watermark has closed, each once; rows that came after their hour was closed aren't in it."""
    of = lambda s: s.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return closed(spark, d, lambda s: of(s).select(c("w.start").alias("start"), "event_type", "n", "total"))


@query(
    "w2_sliding_windows",
    f"""{arrivals_sql(1)}, k AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS start, value, wm FROM a, (VALUES (0), (1), (2)) v(k))
    SELECT start, count(*) AS n, round(avg(value), 6) AS mean FROM k WHERE start + INTERVAL 6 HOUR > wm AND start + INTERVAL 6 HOUR <= (SELECT wm FROM z) GROUP BY 1""",
)
def w2(spark, d):
    of = lambda s: s.withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return closed(spark, d, lambda s: of(s).select(c("w.start").alias("start"), "n", "mean"))


@query(
    "w3_session_windows",
    f"""{arrivals_sql(4)}, g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM a), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT wm FROM z)""",
)
def w3(spark, d):
    """Sessions that the watermark has closed; its delay is over the three days by which rows are late, so no row is left out."""
    of = lambda s: s.withWatermark("ts", "4 days").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return closed(spark, d, lambda s: of(s).select("user_id", c("w.start").alias("start"), "n"))


@query("w4_stale_rows", f"{arrivals_sql(1)} SELECT event_type, CASE WHEN ts <= wm THEN 'stale' ELSE 'fresh' END AS status, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM a GROUP BY 1, 2")
def w4(spark, d):
    """Every row with its status: stale rows came after the watermark had passed them, and are kept beside the fresh ones."""
    rows, folder = table(spark, d, "events"), new_folder(spark, "late")
    in_arrivals(rows, arrival(), labelled("ts", "1 day", folder, new_folder(spark, "stream"), late="stale"))
    kept = spark.read.schema(rows.schema.add("status", "string")).parquet(f"{folder}/rows")
    return kept.groupBy("event_type", "status").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("w5_append_once", "SELECT event_id, user_id, event_type FROM events")
def w5(spark, d):
    rows, folder = events(spark, d).select("event_id", "user_id", "event_type"), new_folder(spark, "store")
    appended_once(rows, "event_id", folder, "first")
    appended_once(rows, "event_id", folder, "first")  # the same batches again
    return appended_once(rows, "event_id", folder, "second")  # another source with the same rows


@query(
    "w6_matured_once",
    f"""{arrivals_sql(4)} SELECT p.event_id, arg_min(e.event_id, (e.ts, e.event_id)) AS matured_by FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 1 DAY
    WHERE p.event_type = 'purchase' GROUP BY 1 HAVING min(e.ts) <= (SELECT wm FROM z)""",
)
def w6(spark, d):
    """Purchases with the first event of their user a day or more later, once the watermark has reached it; each arrival is a new start from the checkpoint."""
    return closed(spark, d, lambda s: matured(s.withColumn("opens", c("event_type") == "purchase"), "user_id", "ts", "event_id", "opens", pd.Timedelta(days=1), "4 days"))


@query("w7_revisions", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS superseded FROM events GROUP BY 1, 2")
def w7(spark, d):
    """The newest event of each user and type over all arrivals, and how many it superseded."""
    keys, folder = ["user_id", "event_type"], new_folder(spark, "revisions")
    in_arrivals(table(spark, d, "events"), arrival(), latest_of_keys(keys, ["ts", "event_id"], "event_id", folder, new_folder(spark, "stream")))
    return merged_keys(spark.read.parquet(folder).drop("batch"), keys, "event_id")
