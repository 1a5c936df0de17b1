"""Many ridge candidates from one scan: sums of products are shared, every candidate is solved from a part of them.

Each group (such as a fold's training rows, or a horizon) gives one row of sums over all features, the target and a constant. A candidate
takes some features and a ridge, so its normal equations are rows and columns of the group's matrix, and its error on other rows comes
from their matrix alone; rows are never read again. Systems are solved in tasks, one group at a time; nothing goes to the driver but
the features' means, which only shift the sums so that their digits hold.

Cases: rows with a null feature, target or group are left out; a feature without spread in a group keeps a scale of 1; a group of one row has a
constant as its model; features, targets and groups keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.session import cut

MAX_CANDIDATES = 120


@dataclass(frozen=True)
class Candidate:
    name: str
    features: tuple[str, ...]
    ridge: float


def plan(features: list[str], groups: dict[str, list[str]], ridges: list[float], singles: list[float] = ()) -> list[Candidate]:
    """Under every ridge all features and all but those of each group; under every ridge of `singles` each feature alone. At most MAX_CANDIDATES, all different."""
    sets = {"all": tuple(features)} | {f"without-{g}": tuple(f for f in features if f not in own) for g, own in sorted(groups.items())}
    found = [Candidate(f"{name}|{ridge:g}", own, float(ridge)) for name, own in sets.items() for ridge in ridges]
    found += [Candidate(f"{f}|{ridge:g}", (f,), float(ridge)) for f in features for ridge in singles]
    if len(found) > MAX_CANDIDATES:
        raise ValueError(f"{len(found)} candidates, {MAX_CANDIDATES} are allowed")
    if len({(c.features, c.ridge) for c in found}) < len(found):
        raise ValueError("a candidate stands twice in the plan")
    return found


def shared_sums(rows: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """(by, n, center, products): by group the number of rows and the upper triangle of the products of (1, shifted features, target)."""
    known = rows
    for name in (*by, *features, target):
        known = known.filter(F.col(name).isNotNull())
    plain = cut(known.select(*by, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("_y")))
    k = len(features)
    means = plain.agg(*[F.avg(f"_f{i}").alias(f"_m{i}") for i in range(k)]).first()
    center = [float(m) if m is not None else 0.0 for m in means]
    one = [F.lit(1.0), *[F.col(f"_f{i}") - F.lit(m) for i, m in enumerate(center)], F.col("_y")]
    products = [F.sum(one[i] * one[j]).alias(f"_p{i}_{j}") for i in range(k + 2) for j in range(i, k + 2)]
    sums = plain.groupBy(*by).agg(F.count("*").alias("n"), *products)
    return sums.select(*by, "n", F.array(*map(F.lit, center)).cast("array<double>").alias("center"), F.array(*[f"_p{i}_{j}" for i in range(k + 2) for j in range(i, k + 2)]).alias("products"))


def matrix_of(products: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k + 2, k + 2))
    m[np.triu_indices(k + 2)] = products
    return m + np.triu(m, 1).T


def solved(m: np.ndarray, center: np.ndarray, places: list[int], ridge: float) -> tuple[float, np.ndarray]:
    """Intercept and weights for plain features (places 0 and up), by the ridge on features of standard scale with the constant left free."""
    n, at = m[0, 0], np.array(places, int) + 1
    mean = m[0, at] / n
    spread = m[np.ix_(at, at)] - n * np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(spread), 0) / max(n - 1, 1))
    scale = np.where(deviation > 1e-12, deviation, 1.0)
    y = m[0, -1] / n
    moment = (m[at, -1] - n * mean * y) / scale
    gram = spread / np.outer(scale, scale) + np.diag(np.full(len(at), ridge))
    try:
        beta = np.linalg.solve(gram, moment) if len(at) else np.empty(0)
    except np.linalg.LinAlgError:
        beta = np.linalg.pinv(gram) @ moment
    weight = beta / scale
    return float(y - weight @ (mean + center[at - 1])), weight


def squared_error(m: np.ndarray, center: np.ndarray, places: list[int], intercept: float, weight: np.ndarray) -> float:
    """The sum of squared errors of a model over the rows that the matrix sums up."""
    v = np.zeros(len(m))
    v[0] = -intercept - weight @ center[np.array(places, int)] if len(places) else -intercept
    v[np.array(places, int) + 1] = -weight
    v[-1] = 1.0
    return max(0.0, float(v @ m @ v))


def fitted(sums: DataFrame, features: list[str], candidates: list[Candidate], by: list[str]) -> DataFrame:
    """(by, candidate, n, intercept, weights, error): every candidate's model of every group; weights of plain features, 0 for those it doesn't have; its mean squared error there."""
    return _solved(sums.select(*by, "n", "center", "products", F.lit(None).cast("array<double>").alias("tested")), features, candidates, by)


def walked(sums: DataFrame, features: list[str], candidates: list[Candidate], by: list[str], role: str) -> DataFrame:
    """As `fitted` on the groups whose `role` is train, with the error on those whose role is test; groups without either are left out."""
    train = sums.filter(F.col(role) == "train").select(*by, "n", "center", "products")
    test = sums.filter(F.col(role) == "test").select(*by, F.col("products").alias("tested"))
    return _solved(train.join(test, by), features, candidates, by)


def _solved(pairs: DataFrame, features: list[str], candidates: list[Candidate], by: list[str]) -> DataFrame:
    places = [[features.index(f) for f in c.features] for c in candidates]
    k = len(features)
    schema = T.StructType([*[pairs.schema[b] for b in by], *T.StructType.fromDDL("candidate string, n long, intercept double, weights array<double>, error double").fields])

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            made = []
            for row in block.itertuples(index=False):
                center, m = np.asarray(row.center, float), matrix_of(np.asarray(row.products, float), k)
                other = m if row.tested is None else matrix_of(np.asarray(row.tested, float), k)
                for c, own in zip(candidates, places):
                    intercept, weight = solved(m, center, own, c.ridge)
                    every = np.zeros(k)
                    every[own] = weight
                    made.append((*row[: len(by)], c.name, int(row.n), intercept, every.tolist(), squared_error(other, center, own, intercept, weight) / other[0, 0]))
            yield pd.DataFrame(made, columns=schema.names)

    return pairs.select(*by, "n", "center", "products", "tested").mapInPandas(run, schema)


def selected(walks: DataFrame, by: list[str]) -> DataFrame:
    """For each `by` the candidate with the smallest mean error over its folds, ties by name; with that error and the number of folds."""
    means = walks.groupBy(*by, "candidate").agg(F.avg("error").alias("error"), F.count("*").alias("folds"))
    return means.groupBy(*by).agg(F.min(F.struct(F.round("error", 12).alias("error"), "candidate", "folds")).alias("_b")).select(*by, "_b.candidate", "_b.error", "_b.folds")
