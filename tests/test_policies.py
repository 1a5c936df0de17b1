"""Policy tables: each reason and each check by itself, unknown metrics, limits by horizon."""

import pytest

from tidepanel.operators import policies as P

QUIET = {"range": 0.2, "near_even": 0, "dispersion": 0.1, "completeness": 0.9, "brier_skill": 0.1, "rank_ic": 0.1, "after_cost": 0.01, "positive_share": 0.6, "calibrated": 1}
LOUD = {"range": 0.02, "near_even": 1, "dispersion": 0.009, "completeness": 0.79, "brier_skill": 0.0, "rank_ic": 0.0, "after_cost": 0.0, "positive_share": 0.5, "calibrated": 0}
GOOD = {"dataset_ready": 1, "model_trained": 1, "sources_ready": 1, "folds": 5, "samples": 252, "brier_skill": 0.01, "log_loss_skill": 0.01, "fold_share": 0.6, "auc": 0.53, "slope": 0.5, "intercept": -0.15, "dispersion": 0.03, "coverage": 0.8, "leakage_free": 1, "largest_share": 0.6}
BAD = {"dataset_ready": 0, "model_trained": 0, "sources_ready": 0, "folds": 4, "samples": 251, "brier_skill": 0.0, "log_loss_skill": 0.0, "fold_share": 0.59, "auc": 0.52, "slope": 1.51, "intercept": 0.16, "dispersion": 0.029, "coverage": 0.79, "leakage_free": 0, "largest_share": 0.61}


def table(spark, rows, names):
    return spark.createDataFrame([(k, *[None if r.get(n) is None else float(r[n]) for n in names]) for k, r in rows.items()], "k string, " + ", ".join(f"`{n}` double" for n in names))


def test_each_reason_by_itself(spark):
    rows = {"quiet": QUIET, "all": LOUD, "none": {}, "nan": QUIET | {"rank_ic": float("nan")}} | {m: QUIET | {m: v} for m, v in LOUD.items()}
    found = {r["k"]: r["reasons"] for r in P.reasons(table(spark, rows, list(QUIET)), P.policy(spark, P.ABSTENTION), "k").collect()}
    names = [r[1] for r in P.ABSTENTION]
    assert len(names) == 9 and found["quiet"] == [] and found["all"] == names and found["nan"] == ["no-rank-correlation"]
    assert found["none"] == [n for n in names if n not in ("near-even", "low-dispersion")]  # of no probabilities neither is known
    assert {m: found[m] for m in LOUD} == {r[2]: [r[1]] for r in P.ABSTENTION}


def test_each_check_by_itself(spark):
    rows = {"good": GOOD, "bad": BAD, "none": {}} | {m: GOOD | {m: v} for m, v in BAD.items()} | {f"no {m}": GOOD | {m: None} for m in GOOD}
    metrics = table(spark, {k: {"_h": 1.0} | r for k, r in rows.items()}, ["_h", *GOOD]).selectExpr("k", "cast(_h as int) AS _h", *GOOD)
    found = {r["k"]: r for r in P.publication(metrics, P.policy(spark, P.PUBLICATION), "k", "_h").collect()}
    names = list(dict.fromkeys(r[1] for r in P.PUBLICATION))
    of = {r[2]: r[1] for r in P.PUBLICATION}
    assert len(names) == 15 and found["good"]["status"] == "published" and found["good"]["passed"] == names and found["good"]["failed"] == []
    assert found["bad"]["failed"] == names and found["bad"]["status"] == "insufficient_data"
    assert found["none"]["failed"] == [n for n in names if n != "auc_above_minimum"]  # the one check that an unknown value passes
    for m in BAD:
        assert found[m]["failed"] == [of[m]] and found[m]["status"] == ("insufficient_data" if of[m] in P.DATA_CHECKS else "abstained")
        assert found[f"no {m}"]["failed"] == ([] if m == "auc" else [of[m]])


@pytest.mark.parametrize("horizon, least", [(1, 252), (5, 126), (20, 63)])
def test_samples_are_limited_by_horizon(spark, horizon, least):
    metrics = table(spark, {n: GOOD | {"samples": least - (n == "few"), "_h": horizon} for n in ("few", "enough")}, ["_h", *GOOD]).selectExpr("k", "cast(_h as int) AS _h", *GOOD)
    found = {r["k"]: r["status"] for r in P.publication(metrics, P.policy(spark, P.PUBLICATION), "k", "_h").collect()}
    assert found == {"few": "insufficient_data", "enough": "published"}
