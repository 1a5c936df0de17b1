"""Candidates from shared sums against models that read the rows, and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import candidates as C
from tidepanel.operators import models as M

NAMES = ["a", "b", "n", "center"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal([3, -200, 0, 5], [1, 7, 0.01, 0], (900, 4))  # the last has no spread
    y = 0.3 * x[:, 0] - 0.02 * x[:, 1] + 9 * x[:, 2] + rng.normal(0, 0.5, 900)
    group = rng.integers(0, 3, 900)
    role = np.where(rng.random(900) < 0.7, "train", "test")
    return [(int(g), str(r), *map(float, v), float(t)) for g, r, v, t in zip(group, role, x, y)] + [(0, "train", None, 1.0, 1.0, 1.0, 1.0), (None, "train", 1.0, 1.0, 1.0, 1.0, 1.0), (7, "train", 1.0, 1.0, 1.0, 1.0, 5.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, role string, a double, b double, n double, center double, y double").repartition(5)


def test_every_candidate_equals_its_own_fit(spark, rows):
    df, grid = frame(spark, rows), C.plan(NAMES, {"x": ["a"], "y": ["b", "n"]}, [0.5, 40.0], [10.0])
    found = {(r["g"], r["candidate"]): r for r in C.fitted(C.shared_sums(df, NAMES, "y", ["g"]), NAMES, grid, ["g"]).collect()}
    assert len(found) == 4 * len(grid)
    for k in grid[::3]:
        for m in M.fit_linear(df.dropna(), list(k.features), "y", "g", ridge=k.ridge).collect():
            r = found[m["g"], k.name]
            plain = np.array(m["weights"]) / np.array(m["scales"])
            own = [r["weights"][NAMES.index(f)] for f in k.features]
            assert np.allclose(own, plain, atol=1e-7) and abs(r["intercept"] - (m["intercept"] - plain @ np.array(m["means"]))) < 1e-6 and r["n"] == m["rows"]
            assert all(w == 0 for f, w in zip(NAMES, r["weights"]) if f not in k.features)


def test_errors_on_other_rows_need_no_rows(spark, rows):
    df, grid = frame(spark, rows), C.plan(NAMES, {"x": ["a"]}, [1.0, 100.0])
    walks = C.walked(C.shared_sums(df, NAMES, "y", ["g", "role"]), NAMES, grid, ["g"], "role").collect()
    assert {r["g"] for r in walks} == {0, 1, 2}  # group 7 has no rows to test on
    models = {(r["g"], r["candidate"]): r for r in C.fitted(C.shared_sums(df.filter("role = 'train'"), NAMES, "y", ["g"]), NAMES, grid, ["g"]).collect()}
    for r in walks:
        m = models[r["g"], r["candidate"]]
        test = np.array([x[2:] for x in rows if x[0] == r["g"] and x[1] == "test"])
        assert abs(np.mean((test[:, 4] - m["intercept"] - test[:, :4] @ np.array(m["weights"])) ** 2) - r["error"]) < 1e-8
    best = C.selected(spark.createDataFrame(walks), []).collect()
    means = {k.name: np.mean([r["error"] for r in walks if r["candidate"] == k.name]) for k in grid}
    assert best[0]["candidate"] == min(means, key=means.get) and best[0]["folds"] == 3
    assert C.fitted(C.shared_sums(df.limit(0), NAMES, "y", ["g"]), NAMES, grid, ["g"]).count() == 0


def test_plans_are_bounded_and_without_repeats():
    with pytest.raises(ValueError):
        C.plan(NAMES, {}, list(range(121)))
    with pytest.raises(ValueError):
        C.plan(NAMES, {"none": []}, [1.0])
    assert len(C.plan(["a"], {}, [], [1.0, 2.0])) == 2


def test_more_groups_than_fit_at_once(spark, rows, monkeypatch):
    df = frame(spark, rows).withColumn("y2", (F.col("y") > 5).cast("int"))
    key = lambda models: {r["g"]: r for r in models.collect()}
    whole = key(M.fit_linear(df, ["a", "b"], "y", "g", ridge=3.0)), key(M.fit_logistic(df, ["a"], "y2", "g", ridge=3.0))
    monkeypatch.setattr(M, "GROUPS", 1)
    parts = key(M.fit_linear(df, ["a", "b"], "y", "g", ridge=3.0)), key(M.fit_logistic(df, ["a"], "y2", "g", ridge=3.0))
    for a, b in zip(whole, parts):
        assert set(a) == set(b) and len(a) >= 3
        assert all(np.allclose(a[g]["weights"], b[g]["weights"]) for g in a)
    assert M.score(df, M.fit_linear(df, ["a", "b"], "y", "g", ridge=3.0), ["a", "b"], "g").count() == df.filter("g is not null").count()
