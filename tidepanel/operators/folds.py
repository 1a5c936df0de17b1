"""Walk-forward evaluation windows on a calendar: labelled dates, purged training windows, blocks and holdouts.

Everything here has one row per date, or per date and fold; the panel meets it by an equi-join. A label is known at the fold's start only if
its target date is before that start, so no training row looks into its evaluation block.

Cases: null target dates are no labels; repeated rows of a date count once; with fewer dates than a window asks for there is no fold or window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAINING, EVALUATION, BLOCK, HOLDOUT = 504, 504, 63, 252  # sessions


def labelled_dates(labels: DataFrame, before: str | None = None) -> DataFrame:
    """(date, target_date): dates whose label is known, optionally before a date."""
    known = labels.filter("target_date is not null").groupBy("date").agg(F.max("target_date").alias("target_date"))
    return known if before is None else known.filter(F.col("target_date") < F.lit(before).cast("date"))


def _numbered(dates: DataFrame, out: str, newest_first: bool = False) -> DataFrame:
    order = F.desc("date") if newest_first else F.col("date")
    return dates.withColumn(out, F.row_number().over(Window.orderBy(order)))  # one row per session


def training_window(labels: DataFrame, start: str, sessions: int = TRAINING) -> DataFrame:
    """The last `sessions` dates that are matured before `start`; none if there are fewer."""
    turn = _numbered(labelled_dates(labels, start), "_turn", True).withColumn("_all", F.count("*").over(Window.partitionBy()))
    return turn.filter((F.col("_turn") <= sessions) & (F.col("_all") >= sessions)).select("date", "target_date")


def folds(labels: DataFrame, *, training: int = TRAINING, evaluation: int = EVALUATION, block: int = BLOCK) -> DataFrame:
    """(fold, start, end, sessions) of the blocks that the last `evaluation` labelled dates are cut into."""
    newest = _numbered(labelled_dates(labels), "_turn", True).filter(F.col("_turn") <= evaluation)
    place = _numbered(newest, "_place").withColumn("fold", F.floor((F.col("_place") - 1) / block).cast("long"))
    return place.groupBy("fold").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("sessions"))


def fold_dates(labels: DataFrame, *, training: int = TRAINING, evaluation: int = EVALUATION, block: int = BLOCK) -> DataFrame:
    """(fold, date, role): each fold's evaluation dates (`test`) and the `training` dates matured before its start (`train`). Folds without that many are left out."""
    blocks = F.broadcast(folds(labels, training=training, evaluation=evaluation, block=block))  # one row per block
    dates = labelled_dates(labels)
    matured = dates.join(blocks, F.col("target_date") < F.col("start"))
    turn = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("date")))
    train = matured.withColumn("_turn", turn).withColumn("_all", F.count("*").over(Window.partitionBy("fold"))).filter((F.col("_turn") <= training) & (F.col("_all") >= training))
    test = dates.join(blocks, F.col("date").between(F.col("start"), F.col("end")))
    whole = train.select("fold").distinct()
    return train.select("fold", "date", F.lit("train").alias("role")).unionByName(test.join(whole, "fold").select("fold", "date", F.lit("test").alias("role")))


def expanding_folds(labels: DataFrame, horizon: int, *, count: int = 5, block: int = BLOCK, least: int = HOLDOUT) -> DataFrame:
    """(fold, date, role) of an expanding evaluation: `count` blocks at the end, trained on all earlier dates but an embargo of `horizon` sessions before the block."""
    dates = _numbered(labels.select("date").distinct(), "_place").withColumn("_place", F.col("_place") - 1).withColumn("_all", F.count("*").over(Window.partitionBy()))
    starts = dates.select("_all").distinct().select("_all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("fold")).select("fold", F.greatest(F.lit(least), F.col("_all") - block * (count - F.col("fold"))).alias("_start"), "_all")
    starts = starts.filter("_start < _all").groupBy("_start").agg(F.min("fold").alias("fold"))
    both = dates.select("date", "_place").join(F.broadcast(starts), F.col("_place") < F.col("_start") + block)
    role = F.when(F.col("_place") >= F.col("_start"), "test").when(F.col("_place") + horizon < F.col("_start"), "train")
    return both.select("fold", "date", role.alias("role")).filter("role is not null")


def holdout_windows(labels: DataFrame, *, selection: int = EVALUATION, holdout: int = HOLDOUT) -> DataFrame:
    """(window, start, end, sessions): the last `holdout` labelled dates and the `selection` dates before them; none if there are fewer."""
    turn = _numbered(labelled_dates(labels), "_turn", True).withColumn("_all", F.count("*").over(Window.partitionBy()))
    name = F.when(F.col("_turn") <= holdout, "holdout").when(F.col("_turn") <= holdout + selection, "selection")
    named = turn.filter(F.col("_all") >= selection + holdout).withColumn("window", name).filter("window is not null")
    return named.groupBy("window").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("sessions"))
