"""Recurrences by blocks against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from tidepanel.operators import recurrence as R


def plain(values, n):
    out, y = [None] * min(n - 1, len(values)), None
    for i in range(n - 1, len(values)):
        y = sum(values[:n]) / n if y is None else y * (1 - 2 / (n + 1)) + values[i] * 2 / (n + 1)
        out.append(y)
    return out


def test_averages_of_series_of_all_lengths(spark):
    rng = np.random.default_rng(1)
    series = {f"c{k}": rng.normal(100, 5, k).tolist() for k in (1, 8, 9, 10, 63, 64, 65, 72, 73, 128, 129, 500)}
    rows = [(code, i * 7, v, "x") for code, values in series.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    panel = spark.createDataFrame([(str(a), int(b), float(c), d) for a, b, c, d in rows], "code string, date long, close double, at string").repartition(6)
    found = R.exponential_averages(panel, [9, 2]).collect()
    assert len(found) == len(rows)
    for code, values in series.items():
        own = sorted((r["date"], r["ema9"], r["ema2"]) for r in found if r["code"] == code)
        for k, n in ((1, 9), (2, 2)):
            for a, b in zip([r[k] for r in own], plain(values, n)):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert R.exponential_averages(panel.limit(0), [9]).count() == 0


def test_one_long_series_lies_in_many_tasks(spark):
    n = 300_000
    panel = spark.range(n).select(F.lit("one").alias("code"), F.col("id").alias("date"), (F.sin(F.col("id") / 50.0) + F.col("id") / 1000.0).alias("close"))
    ordered = R.ordinals(panel, "code", [F.col("date")])
    shares = ordered.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) > 1 and max(r["count"] for r in shares) < 0.8 * n  # small ranges are joined up
    assert ordered.filter("at <> date or size <> 300000").isEmpty()
    found = R.exponential_averages(panel, [26])
    values = [float(np.sin(i / 50.0) + i / 1000.0) for i in range(n)]
    expected = plain(values, 26)
    probe = {r["date"]: r["ema26"] for r in found.filter(f"date % 9973 = 0 or date > {n - 70}").collect()}
    assert len(probe) > 90 and all((expected[i] is None and v is None) or abs(expected[i] - v) < 1e-8 for i, v in probe.items())
