"""Chained digests: every kind of fault is named, and only parts that differ are opened."""

from pyspark.sql import functions as F

from tidepanel.operators import chained as CH

LEVELS = [["month", "code"], ["month"], []]
CONTENT = ["id", "month", "code", "v", "tags"]


def ledger(spark, change=lambda rows: rows):
    rows = [(f"p{i}", f"2024-{i % 6 + 1:02d}", None if i % 5 == 0 else f"c{i % 5}", float(i) if i % 7 else None, {"b": i, "a": 1}) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in change(rows)], "id string, month string, code string, v double, tags map<string, int>, n string").repartition(4)
    return CH.with_digest(df, CONTENT)


def faults(spark, change):
    return sorted(((r["month"], r["code"], r["id"], r["fault"]) for r in CH.row_faults(ledger(spark, change), ledger(spark), "id", LEVELS).collect()), key=str)


def test_equal_ledgers_have_equal_roots_in_any_order(spark):
    a, b = CH.level_digests(ledger(spark), LEVELS), CH.level_digests(ledger(spark, lambda rows: rows[::-1]), LEVELS)
    assert a[2].first() == b[2].first() and a[2].first()["n"] == 300
    assert faults(spark, lambda rows: rows) == []
    assert CH.manifest_faults(a, b, LEVELS).count() == 0


def test_each_fault_is_named(spark):
    altered = lambda rows: [(*r[:3], 1e9, r[4]) if r[0] == "p17" else (*r[:4], {"a": 2}) if r[0] == "p30" else r for r in rows]
    assert faults(spark, altered) == [("2024-01", None, "p30", "altered"), ("2024-06", "c2", "p17", "altered")]
    assert faults(spark, lambda rows: [r for r in rows if r[0] != "p4"]) == [("2024-05", "c4", "p4", "missing")]
    assert faults(spark, lambda rows: rows + [("new", "2024-02", "c1", 1.0, None)]) == [("2024-02", "c1", "new", "unknown")]
    assert faults(spark, lambda rows: rows + [rows[8]]) == [("2024-03", "c3", "p8", "unknown")]  # the same row twice
    assert faults(spark, lambda rows: [r for r in rows if r[1:3] != ("2024-04", "c3")]) == [("2024-04", "c3", None, "lost-shard")]
    moved = lambda rows: [(r[0], "2024-12", *r[2:]) if r[0] == "p1" else r for r in rows]
    assert faults(spark, moved) == [("2024-02", "c1", "p1", "missing"), ("2024-12", "c1", "p1", "unknown")]


def test_manifests_that_tell_other_counts(spark):
    derived = CH.level_digests(ledger(spark), LEVELS)
    claimed = [derived[0].filter("code = 'c1' or month <> '2024-01'"), derived[1].withColumn("n", F.col("n") + (F.col("month") == "2024-03").cast("int")), derived[2].withColumn("digest", F.lit("0"))]
    found = {(r["level"], r["month"], r["code"], r["fault"]) for r in CH.manifest_faults(claimed, derived, LEVELS).collect()}
    assert {f for f in found if f[0] > 0} == {(1, "2024-03", None, "false-count"), (2, None, None, "false-digest")}
    assert {f[3] for f in found if f[0] == 0} == {"unlisted"} and all(f[1] == "2024-01" and f[2] != "c1" for f in found if f[0] == 0)


def test_only_parts_that_differ_are_opened(spark):
    a, b = (CH.level_digests(x, LEVELS) for x in (ledger(spark, lambda rows: [(*r[:3], 5.5, r[4]) if r[0] == "p17" else r for r in rows]), ledger(spark)))
    assert [(r["month"], r["code"]) for r in CH.opened(a, b, LEVELS).collect()] == [("2024-06", "c2")]
    assert CH.row_faults(ledger(spark).limit(0), ledger(spark).limit(0), "id", LEVELS).count() == 0
