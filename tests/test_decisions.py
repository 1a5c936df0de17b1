"""Decisions from metric rows, and bindings of claims, on rows that reach each rule."""

import datetime

from tidepanel.operators import decisions as N
from tidepanel.operators import folds, labels

DAY = datetime.date(2024, 1, 1)


def test_promotion(spark):
    rows = [(1, 0.2, 0.6, 0.1, 0.2, 0.6, 0.2), (2, 0.2, 0.6, 0.1, 0.3, 0.5, 0.0), (3, 0.2, 0.6, 0.1, 0.2005, 0.595, 0.1), (4, 0.2, 0.6, 0.1, None, 0.6, 0.2)]
    df = spark.createDataFrame(rows, "k int, a_brier double, a_auc double, a_ic double, b_brier double, b_auc double, b_ic double")
    found = {r["k"]: r["v"] for r in df.select("k", N.promotion_reasons("a", "b").alias("v")).collect()}
    assert found == {1: [], 2: ["inferior-brier", "inferior-auc", "no-positive-evidence"], 3: ["no-positive-evidence"], 4: ["inferior-brier"]}


def test_claims_and_their_facts(spark):
    facts = spark.createDataFrame([(1, 5, "verified"), (2, None, "reported")], "fact int, value int, status string")
    claims = spark.createDataFrame([(10, 1, "body.a", 5, "certain"), (11, 1, "title", 6, "certain"), (12, 2, "body.b", None, "certain"), (13, 9, "title", 1, "certain"), (14, None, "title", 1, "certain")], "claim int, fact int, path string, value int, wording string")
    found = {r["claim"]: r["faults"] for r in N.claim_faults(claims, facts).collect()}
    assert found == {10: [], 11: ["path", "value"], 12: ["wording"], 13: ["unknown-fact"], 14: ["unknown-fact"]}
    observations = spark.createDataFrame([(1, "x"), (2, "y")], "id int, state string")
    asked = spark.createDataFrame([(1, [1], "x"), (2, [1, 2], "x"), (3, [], "x"), (4, [7], "x"), (5, None, "x")], "claim int, ids array<int>, state string")
    assert {r["claim"]: r["bound"] for r in N.bound_observations(asked, observations).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_targets_are_sessions(spark):
    bench = spark.createDataFrame([(DAY + datetime.timedelta(i),) for i in (0, 1, 4, 5)], "date date")
    rows = [(1, 0, 1, 1), (2, 0, 4, 1), (3, 0, 2, 1), (4, 0, None, 1), (5, 0, 5, 3)]
    df = spark.createDataFrame([(k, DAY + datetime.timedelta(a), None if b is None else DAY + datetime.timedelta(b), h) for k, a, b, h in rows], "k int, date date, target_date date, horizon int")
    assert {r["k"]: r["violations"] for r in labels.calendar_faults(df, bench).collect()} == {1: [], 2: ["horizon"], 3: ["no-session"], 4: ["no-session"], 5: []}


def test_expanding_folds_keep_an_embargo(spark):
    df = spark.createDataFrame([(DAY + datetime.timedelta(i), None) for i in range(60)], "date date, target_date date")
    rows = folds.expanding_folds(df, 3, count=3, block=10, least=20).collect()
    for k in range(3):
        train = [r["date"] for r in rows if r["fold"] == k and r["role"] == "train"]
        test = [r["date"] for r in rows if r["fold"] == k and r["role"] == "test"]
        assert len(test) == 10 and max(train) + datetime.timedelta(3) < min(test) and len(train) == 30 + 10 * k - 3
    assert folds.expanding_folds(df.limit(0), 3).count() == 0
