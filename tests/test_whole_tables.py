"""Queries over whole tables: no row of the input is left out."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import ledger
from tidepanel.queries import QUERIES, scalars, sets
from tidepanel.session import table

SF = "/root/testdata/sf0.001"
ROWS = {"c2_ratio": "lineitem", "c23_due_of_list": "orders", "c24_latest_complete_session": "events", "c43_normalized_content": "events"}


@pytest.mark.parametrize("name", ROWS)
def test_every_row_comes_out(spark, name):
    assert QUERIES[name](spark, SF).count() == table(spark, SF, ROWS[name]).count()


def test_sessions_before_between_and_after_a_calendar(spark):
    day = lambda n: datetime.date(2020, 1, n)
    sessions = spark.createDataFrame([(day(n),) for n in (3, 10, 17, 17, 24)], "date date")
    rows = spark.createDataFrame([(n, day(n) if n else None) for n in (0, 1, 3, 9, 17, 30)], "k int, day date")
    found = lambda later: {r["k"]: r["s"] and r["s"].day for r in scalars.session_of(rows, "day", sessions, later, "s").collect()}
    assert found(0) == {0: None, 1: None, 3: 3, 9: 3, 17: 17, 30: 24}
    assert found(3) == {0: None, 1: 17, 3: 24, 9: 24, 17: None, 30: None}


def test_editions_of_whole_tables(spark):
    rows = [("a", 1), ("a", 2), ("a", 900), ("b", 2), ("b", 2), ("b", 900), ("b", 901), ("c", None), ("d", 5)]
    found = sets.new_and_reused(spark.createDataFrame(rows, "o_orderpriority string, o_custkey long"))
    assert sorted((r["edition"], r["fresh"], r["reused"]) for r in found.collect()) == [("a", None, None), ("b", 1, 2), ("c", 0, 0), ("d", 1, 0)]


def test_pairs_of_every_thread(spark):
    keys = [(r["o_orderkey"], r["o_custkey"]) for r in table(spark, SF, "orders").collect()]
    sources = {}
    for k, thread in keys:
        sources.setdefault(k // 40, set()).add(thread)
    expected = Counter((a, b) for threads in sources.values() for a in threads for b in threads if a < b)
    assert {(r["a"], r["b"]): r["shared"] for r in QUERIES["j18_shared_sources"](spark, SF).collect()} == expected


def test_places_and_retention_need_no_single_task(spark, capsys):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("day"), (F.col("id") % 11).alias("size")).repartition(5)
    order = [F.desc("day"), F.col("id").asc()]
    found = ledger.placed(rows, order, "place")
    expected = sorted(((-(i % 7), i) for i in range(5000)))
    assert [r["id"] for r in found.orderBy("place").collect()] == [i for _, i in expected]
    assert sorted(r["place"] for r in found.collect()) == list(range(1, 5001))
    assert ledger.placed(rows.limit(0), order, "place").count() == 0
    kept = ledger.kept_by_bytes(rows, [F.desc("id")], "size", 1500, 4000)
    total, newest = 0, []
    for i in range(4999, 3499, -1):
        total += i % 11
        if total > 4000:
            break
        newest.append(i)
    assert sorted(r["id"] for r in kept.collect()) == sorted(newest)
    kept.explain()
    assert "_s#" in capsys.readouterr().out.split("hashpartitioning(", 1)[1].split(")")[0]
    QUERIES["t9_document_order"](spark, SF).explain()
    assert "row_number" not in capsys.readouterr().out


def test_terms_after_the_first_characters_are_found(spark):
    docs = spark.createDataFrame([(1, "x" * 500 + " The end"), (2, "no match"), (3, "and " + "y" * 90 + "QUE")], "doc_id long, text string")
    assert {r["doc_id"]: r["terms"] for r in scalars.sensational(docs).collect()} == {1: ["the"], 2: [], 3: ["and", "que"]}
