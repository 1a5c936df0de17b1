"""Models, metrics and folds against plain numpy."""

import datetime
import math

import numpy as np
import pytest

from tidepanel.operators import folds, metrics, models

DAY = datetime.date(2020, 1, 1)


def newton(x, y, ridge, ddof, start, clip=60.0, steps=32):
    means, scales = x.mean(0), x.std(0, ddof=ddof)
    design = np.column_stack([np.ones(len(x)), (x - means) / np.where(scales > 1e-12, scales, 1.0)])
    beta = np.zeros(design.shape[1])
    beta[0] = start
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -clip, clip)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((design.T * w) @ design + penalty, design.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2)) * [1.0, 5.0] + [0.0, 2.0]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))).astype(int)
    return x, y, np.arange(600) % 3


def frame(spark, data):
    x, y, g = data
    rows = [(int(k), float(a), float(b), int(v), 7.0) for k, (a, b), v in zip(g, x, y)] + [(0, None, 1.0, 1, 7.0), (None, 1.0, 1.0, 1, 7.0), (9, 1.0, 2.0, 1, 7.0), (9, 2.0, 2.0, 1, 7.0)]
    return spark.createDataFrame(rows, "g int, a double, b double, y int, flat double")


def test_logistic_models_equal_newton_in_numpy(spark, data):
    x, y, g = data
    found = {r["g"]: r for r in models.fit_logistic(frame(spark, data), ["a", "b"], "y", "g", ridge=10.0).collect()}
    assert set(found) == {0, 1, 2}  # group 9 has one class
    for k in range(3):
        own = g == k
        expected = newton(x[own], y[own], 10.0, 1, math.log(y[own].mean() / (1 - y[own].mean())))
        assert np.allclose([found[k]["intercept"], *found[k]["weights"]], expected, atol=1e-9)
    zero = models.fit_logistic(frame(spark, data), ["a", "b", "flat"], "y", "g", ridge=4.0, iterations=80, sample_sd=False, clip=30.0, base_start=False)
    row = zero.filter("g = 1").first()
    expected = newton(np.column_stack([x[g == 1], np.full((g == 1).sum(), 7.0)]), y[g == 1], 4.0, 0, 0.0, 30.0, 80)
    assert np.allclose([row["intercept"], *row["weights"]], expected, atol=1e-8) and row["scales"][2] == 1.0
    assert models.fit_logistic(frame(spark, data).limit(0), ["a"], "y", "g", ridge=1.0).count() == 0


def test_linear_models_equal_the_normal_equations(spark, data):
    x, y, g = data
    found = {r["g"]: r for r in models.fit_linear(frame(spark, data), ["a", "b"], "y", "g", ridge=3.0).collect()}
    for k in range(3):
        own = x[g == k]
        design = np.column_stack([np.ones(len(own)), (own - own.mean(0)) / own.std(0, ddof=1)])
        expected = np.linalg.solve(design.T @ design + np.diag([0, 3.0, 3.0]), design.T @ y[g == k])
        assert np.allclose([found[k]["intercept"], *found[k]["weights"]], expected, atol=1e-9)


def test_scores_and_calibration(spark, data):
    x, y, g = data
    rows = frame(spark, data).filter("a is not null and g < 3")
    fitted = models.fit_platt(rows, "a", "y", "g")
    row = fitted.filter("g = 0").first()
    own = x[g == 0][:, :1]
    expected = newton(own, y[g == 0], 2.0, 0, math.log(y[g == 0].mean() / (1 - y[g == 0].mean())), steps=40)
    assert np.allclose([row["intercept"], *row["weights"]], expected, atol=1e-9)
    found = [r["calibrated"] for r in models.calibrated(rows, fitted, "a", "g").filter("g = 0").orderBy("a").collect()]
    line = expected[0] + expected[1] * (np.sort(own[:, 0]) - own.mean()) / own.std()
    assert np.allclose(found, 1 / (1 + np.exp(-line)), atol=1e-9)
    p = spark.createDataFrame([(1, float(v), int(k)) for v, k in zip(np.clip(x[:, 0] / 8 + 0.5, 0.01, 0.99), y)], "g int, p double, y int")
    line = models.calibration_line(p, "p", "y", "g").first()
    logit = np.log(np.clip(x[:, 0] / 8 + 0.5, 0.01, 0.99) / (1 - np.clip(x[:, 0] / 8 + 0.5, 0.01, 0.99)))
    gradient = [(y - 1 / (1 + np.exp(-(line["intercept"] + line["slope"] * logit)))) @ v for v in (np.ones(len(y)), logit)]
    assert np.abs(gradient).max() < 1e-5


def test_metrics_equal_their_definitions(spark):
    rng = np.random.default_rng(5)
    p, y = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    p[:3] = [0.0, 1.0, 1.0]
    rows = spark.createDataFrame([(int(i % 2), float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))] + [(0, None, 1), (5, 0.5, 1)], "g int, p double, y int")
    auc = {r["g"]: r["auc"] for r in metrics.auc(rows, ["g"]).collect()}
    ece = {r["g"]: r["ece"] for r in metrics.calibration_error(rows, ["g"]).collect()}
    brier = {r["g"]: r for r in metrics.brier(rows, ["g"]).collect()}
    assert auc[5] is None and brier[5]["brier_skill"] is None
    for k in (0, 1):
        a, b = p[k::2], y[k::2]
        wins = [(1.0 if i > j else 0.5 if i == j else 0.0) for i in a[b == 1] for j in a[b == 0]]
        assert math.isclose(auc[k], np.mean(wins))
        bins = np.minimum(np.floor(a * 10), 9)
        assert math.isclose(ece[k], sum((bins == i).sum() * abs(a[bins == i].mean() - b[bins == i].mean()) for i in np.unique(bins)) / len(a), rel_tol=1e-9)
        assert math.isclose(brier[k]["brier"], ((a - b) ** 2).mean()) and math.isclose(brier[k]["baseline_brier"], ((b.mean() - b) ** 2).mean())
    assert metrics.auc(rows.limit(0), ["g"]).count() == 0


def test_bootstrap_equals_numpy(spark):
    values = np.random.default_rng(8).normal(size=40)
    daily = spark.createDataFrame([(DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(values)], "date date, v double")
    row = metrics.block_bootstrap(daily, "v", block=7, repetitions=200, seed=4).first()
    rng, means = np.random.default_rng(4), []
    for _ in range(200):
        at = np.concatenate([np.arange(s, s + 7) for s in rng.integers(0, 34, size=6)])[:40]
        means.append(values[at].mean())
    assert np.allclose([row["point"], row["lower"], row["upper"]], [np.mean(means), *np.quantile(means, [0.025, 0.975])])
    assert metrics.block_bootstrap(daily.limit(3), "v", block=7).count() == 0


def label_rows(spark, n, horizon):
    day = lambda i: DAY + datetime.timedelta(i)
    return spark.createDataFrame([(day(i), day(i + horizon) if i + horizon < n else None, k) for i in range(n) for k in "ab"], "date date, target_date date, code string")


def test_no_training_label_reaches_into_its_block(spark):
    labels = label_rows(spark, 100, 5)
    dates = folds.fold_dates(labels, training=30, evaluation=40, block=10)
    blocks = {r["fold"]: r for r in folds.folds(labels, training=30, evaluation=40, block=10).collect()}
    assert len(blocks) == 4 and all(r["sessions"] == 10 for r in blocks.values())
    rows = dates.collect()
    for k, b in blocks.items():
        train = sorted(r["date"] for r in rows if r["fold"] == k and r["role"] == "train")
        assert len(train) == 30 and train[-1] + datetime.timedelta(5) < b["start"]
        assert len([r for r in rows if r["fold"] == k and r["role"] == "test"]) == 10
    assert folds.fold_dates(labels, training=70, evaluation=40, block=10).filter("fold = 0").count() == 0  # not enough matured dates
    assert folds.training_window(labels, "2020-03-01", 30).count() == 30
    assert folds.training_window(labels, "2020-01-20", 30).count() == 0
    windows = {r["window"]: r["sessions"] for r in folds.holdout_windows(labels, selection=40, holdout=20).collect()}
    assert windows == {"holdout": 20, "selection": 40}
    assert folds.holdout_windows(labels, selection=90, holdout=20).count() == 0
