"""Cleaning, contracts and text measures on rows that reach each rule."""

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import editorial as D
from tidepanel.operators import cleaning as B
from tidepanel.operators import contracts as K
from tidepanel.operators import ledger as G

c = F.col
GOOD = dict(prediction_id="pred-0001", prediction_date="2024-01-01", due_date="2024-01-02", horizon=5, model="trained", status="published", mode="probability", source="raw_model", target="top_quartile", probability=30.0, reasons=0, legacy=False)
SCHEMA = "prediction_id string, prediction_date string, due_date string, horizon int, model string, status string, mode string, source string, target string, probability double, reasons int, legacy boolean"


@pytest.mark.parametrize(
    "change,found",
    [
        ({}, []), ({"due_date": None}, []), ({"prediction_id": "short"}, ["id"]), ({"prediction_id": None}, ["id"]), ({"due_date": "2024-01-01"}, ["due-date"]), ({"horizon": 2}, ["horizon"]), ({"model": "guessed"}, ["model", "published-model"]),
        ({"probability": 100.0}, []), ({"probability": 100.5}, ["probability-range"]), ({"probability": None}, ["published-probability"]), ({"target": "none"}, ["published-probability"]), ({"source": "none"}, ["published-lineage"]),
        ({"status": "abstained", "mode": "evidence_observation", "probability": None, "reasons": 1}, []), ({"status": "abstained", "mode": "evidence_observation", "probability": None}, ["abstained-reasons"]),
        ({"status": "insufficient_data", "probability": 1.0}, ["hidden-probability"]), ({"status": "unavailable", "model": "not_trained", "probability": None, "source": "none", "target": "none"}, []),
        ({"status": "unavailable", "probability": None, "source": "none", "target": "none"}, ["trained-without-output"]), ({"legacy": True}, ["legacy"]), ({"legacy": True, "target": "absolute_up", "source": "legacy_unknown"}, []),
    ],
)
def test_prediction_contract(spark, change, found):
    row = spark.createDataFrame([tuple((GOOD | change).values())], SCHEMA)
    assert row.select(K.prediction_violations().alias("v")).first()["v"] == found


def test_bars_are_cleaned_and_counted(spark):
    rows = [("2024-01-02", 1.0, 2.0, 0.5, 1.5, 1), ("2024-01-02", 1.0, 2.0, 0.5, 1.6, 3), ("2024-01-02", 1.0, 2.0, 0.5, 1.4, 2), ("02.01.2024", 1.0, 2.0, 0.5, 1.5, 4), (None, 1.0, 2.0, 0.5, 1.5, 5), ("2024-02-30", 1.0, 2.0, 0.5, 1.5, 6),
            ("2023-12-31", 1.0, 2.0, 0.5, 1.5, 7), ("2024-03-01", 1.0, 2.0, 0.5, 1.5, 8), ("2024-01-03", 1.0, None, 0.5, 1.5, 9), ("2024-01-04", 1.0, 1.4, 0.5, 1.5, 10), ("2024-01-05", 1.0, 2.0, 1.1, 1.5, 11)]
    df = spark.createDataFrame([("x", *r) for r in rows], "code string, date string, open double, high double, low double, close double, seq long")
    clean = B.clean_bars(df, ["code"], "seq", "2024-01-01", "2024-02-01").collect()
    assert [(r["date"], r["close"]) for r in clean] == [("2024-01-02", 1.6)]
    counts = B.reject_counts(df, ["code"], "seq", "2024-01-01", "2024-02-01").first().asDict()
    assert counts == {"code": "x", "input": 11, "invalidDate": 3, "preLaunch": 1, "future": 1, "invalidOhlc": 3, "duplicates": 2, "rows": 1}
    assert B.clean_bars(df.limit(0), ["code"], "seq").count() == 0


@pytest.mark.parametrize("stamp,date,complete", [("20260721150512", "2026-07-21", True), ("20260721145700", "2026-07-21", True), ("20260721145659", "2026-07-21", False), ("20260721092838", "2026-07-21", False), ("202607211505", "2026-07-21", False), ("20260721150512", "2026-07-20", False), (None, "2026-07-21", False)])
def test_quotes_after_the_close(spark, stamp, date, complete):
    df = spark.createDataFrame([(stamp, date)], "stamp string, date string")
    assert df.select(B.is_complete_close(c("date"), c("stamp"), F.lit("2026-07-21")).alias("x")).first()["x"] is complete


def test_cross_sections_that_are_not_whole(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "z")], "date int, code string")
    found = {r["date"]: (r["rows"], r["missing"], r["repeated"]) for r in B.cross_section_faults(df, ["a", "b"]).collect()}
    assert found == {2: (1, 1, 0), 3: (3, 0, 1), 4: (2, 1, 0)}


def test_evidence_states(spark):
    rows = [(1, "supports", "press", "p", None), (1, "contradicts", "official", "q", None), (2, "supports", "official", "p", None), (3, "supports", "press", "p", None), (3, "supports", "press", "q", None), (4, "supports", "press", "p", "k"), (4, "supports", "press", "q", "k"), (5, "supports", "signal", "p", None), (6, "contradicts", "signal", "p", None)]
    df = spark.createDataFrame(rows, "observation int, relation string, source_class string, publisher string, cluster string")
    assert {r["observation"]: r["state"] for r in K.evidence_state(df).collect()} == {1: "conflicting", 2: "confirmed", 3: "corroborated", 4: "single-source", 5: "unverified", 6: "single-source"}


def test_measures_of_style(spark):
    long_ = "this sentence says the very same thing"
    text = f"{long_}. A short one!{long_}? x1 2 3.\n{long_}.{'w' * 120}."
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = df.select(D.duplicate_sentences(c("t")).alias("d"), D.repeated_share(c("t")).alias("r"), D.longest_run(c("t"), "same|short").alias("run"), D.long_sentences(c("t")).alias("n"), D.sentences(c("t")).alias("s"), D.mean_sentence(c("t")).alias("m")).collect()
    assert (rows[0]["d"], rows[0]["run"], rows[0]["n"]) == (2, 3, 1)
    once = len(long_.replace(" ", ""))
    assert rows[0]["r"] == round(once / len("".join(text.split())), 4)
    assert rows[0]["s"] == [long_, "A short one", long_, "x1 2 3", long_, "w" * 120]
    assert [tuple(r)[:4] for r in rows[1:]] == [(0, 0.0, 0, 0)] * 2 and rows[1]["m"] == 0.0


def test_fields_that_changed(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3)], "k int, n string, v int")
    b = spark.createDataFrame([(1, "x", 4), (2, "z", 3), (9, "q", 1)], "k int, n string, v int")
    assert sorted(map(tuple, G.changed_fields(a, b, "k").collect())) == [(1, "v"), (2, "n")]
    assert sorted(map(tuple, G.differences(a.select("k"), b.select("k")).collect())) == [(9, "missing")]


def test_rankings_and_charts_name_their_faults(spark):
    good = [(1, 100.0, "a"), (2, 50.0, "b"), (3, 0.0, "c")]
    bad = {"good": good, "ranks": [(1, 9.0, "a"), (3, 8.0, "b")], "zero": [(0, 9.0, "a"), (1, 8.0, "b")], "range": [(1, 101.0, "a"), (2, 50.0, "b")], "order": [(1, 5.0, "a"), (2, 6.0, "b")], "code": [(1, 6.0, "a"), (2, 5.0, "a")], "null": [(None, None, None)]}
    rows = spark.createDataFrame([(k, *r) for k, own in bad.items() for r in own], "g string, rank int, score double, code string")
    found = {r["g"]: r["faults"] for r in K.ranking_faults(rows, "g", "rank", "score", ["code"]).collect()}
    assert found == {"good": [], "ranks": ["ranks"], "zero": ["ranks"], "range": ["range"], "order": ["order"], "code": ["code"], "null": ["ranks", "range", "code"]}
    charts = {"good": [1, 2, 5], "fall": [1, 3, 2, 5], "same": [1, 1, 5], "early": [1, 2], "null": [1, None, 5]}
    points = spark.createDataFrame([(k, i, d) for k, own in charts.items() for i, d in enumerate(own)], "g string, place int, day int")
    end = spark.createDataFrame([(5,)], "day int")
    assert {r["g"]: r["faults"] for r in K.chart_faults(points, "g", "place", "day", end).collect()} == {"good": [], "fall": ["ascending"], "same": ["ascending"], "early": ["as-of"], "null": ["ascending"]}
