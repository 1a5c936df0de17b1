"""Decisions from metric rows: promotion, source audits and bindings of claims; gates are in `policies`.

Cases: a missing metric speaks against promotion; a claim without its fact has `unknown-fact` and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import violations


def promotion_reasons(champion: str, challenger: str, tolerance: float = 0.001) -> Column:
    """What speaks against the challenger, over columns <name>_brier, <name>_auc and <name>_ic: none is needed to promote it."""
    a, b = (lambda m: F.col(f"{champion}_{m}")), (lambda m: F.col(f"{challenger}_{m}"))
    worse = lambda x: F.coalesce(x, F.lit(True))
    return violations(
        (worse(b("brier") > a("brier") + tolerance), "inferior-brier"), (worse(b("auc") < a("auc") - 0.01), "inferior-auc"),
        (worse(~((b("ic") > a("ic")) | (b("brier") < a("brier")))), "no-positive-evidence"),
    )


def source_audit(sources: DataFrame, stats: DataFrame, key: str, least: int) -> DataFrame:
    """Every source with its rows, dates, status and whether it is required and not ready."""
    both = sources.join(stats, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    status = F.when(F.col("rows") >= least, "ready").when(F.col("rows") > 0, "partial").otherwise("unavailable")
    return both.withColumn("status", status).withColumn("failure", F.col("required") & (F.col("status") != "ready"))


def claim_faults(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim, faults) of claims (claim, fact, path, value, wording) against facts (fact, value, status); paths of a claim have to begin with `body.`."""
    own = facts.select("fact", F.col("value").alias("_value"), F.col("status").alias("_status"), F.lit(True).alias("_known"))
    met = claims.join(own, "fact", "left")
    known = F.col("_known").isNotNull()
    faults = violations(
        (~known, "unknown-fact"), (known & ~F.col("path").startswith("body."), "path"), (known & ~F.col("value").eqNullSafe(F.col("_value")), "value"),
        (known & (F.col("_status") != "verified") & (F.col("wording") == "certain"), "wording"),
    )
    return met.select("claim", faults.alias("faults"))


def bound_observations(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """(claim, bound): whether all ids of a claim (claim, ids, state) are observations (id, state) of the same state. A claim without ids is not bound."""
    each = claims.select("claim", "state", F.explode("ids").alias("id")).join(observations.select("id", F.col("state").alias("_state")), "id", "left")
    found = each.groupBy("claim").agg(F.bool_and(F.coalesce(F.col("state") == F.col("_state"), F.lit(False))).alias("bound"))
    return claims.select("claim").join(found, "claim", "left").select("claim", F.coalesce("bound", F.lit(False)).alias("bound"))
