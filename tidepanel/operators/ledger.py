"""The append-only ledger of predictions: records, evaluations, revisions, merges and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import cut


def prediction_id(date: str, code: str, horizon: str) -> Column:
    return F.concat_ws("|", F.col(date).cast("string"), F.col(code), F.col(horizon).cast("string"))


def predictions(scored: DataFrame) -> DataFrame:
    """Records of a scored panel: weak probabilities abstain, those before 1997 are legacy, the rest is published."""
    status = F.when(F.abs(F.col("p") - 0.5) < 0.02, "abstained").when(F.year("date") < 1997, "legacy").otherwise("published")
    return scored.select(
        prediction_id("date", "code", "horizon").alias("prediction_id"), F.col("date").alias("prediction_date"), "code", "horizon", status.alias("status"),
        F.concat(F.lit("m"), (F.month("date") % 3).cast("string")).alias("model"), "p", "y", "excess", "score",
    )


def union_of_snapshots(snapshots: list[DataFrame], key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): each id once, and the ids that have more than one content."""
    every = snapshots[0]
    for s in snapshots[1:]:
        every = every.unionByName(s)
    digest = F.sha2(F.to_json(F.struct(*sorted(content))), 256)
    marked = every.withColumn("_digest", digest)
    conflicts = marked.groupBy(key).agg(F.countDistinct("_digest").alias("contents")).filter("contents > 1")
    turn = F.row_number().over(Window.partitionBy(key).orderBy("_digest"))
    return marked.withColumn("_t", turn).filter("_t = 1").drop("_t", "_digest"), conflicts


def appended(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """`existing` and those incoming rows whose id is new: writing the same again changes nothing."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key]))


def upserted(existing: DataFrame, incoming: DataFrame, key: str, updated: str) -> DataFrame:
    """Each id once: the newest update, the incoming row where both are as new."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(updated), F.desc("_new")))
    return both.withColumn("_t", turn).filter("_t = 1").drop("_t", "_new")


def outcome(record_p: Column, y: Column, status: Column, base: Column | None = None, band: float = 0.01) -> Column:
    """correct, wrong or near_neutral for published records; others keep their status and never count as wrong.

    The edge is the probability less the base rate (0.5 where there is none); within `band` (0.03 for the top quartile, 0.01 for the
    other targets) it is near_neutral.
    """
    edge = record_p - F.coalesce(base if base is not None else F.lit(None), F.lit(0.5))
    side = F.when(F.abs(edge) < band, "near_neutral").when((edge > 0) == (y == 1), "correct").otherwise("wrong")
    return F.when(status != "published", status).when(y.isNull(), "pending").otherwise(side)


def latest_events(events: DataFrame, subject: str, at: str, event_id: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc(at), F.desc(event_id)))
    return events.withColumn("_t", turn).filter("_t = 1").drop("_t")


def placed(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """`rows` with their place in the order, from 1: ranges of the order are sorted apart, and one count per range gives the offsets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    marked = at.withColumn("_part", F.shiftright("_at", 33))
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return marked.join(F.broadcast(offsets), "_part").select(*rows.columns, place.alias(out))


SALTS = 64  # parts of a source that are reduced to their newest rows apart


def kept_by_bytes(items: DataFrame, newest_first: list[Column], size: str, count: int, limit: int, within: str | None = None) -> DataFrame:
    """The newest items up to a count and a sum of sizes: retention drops the oldest first.

    Each of SALTS parts of a source is first reduced to its newest `count`, among which all of the source's newest `count` are.
    """
    by = [within] if within else []
    salted = items.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    some = salted.withColumn("_t", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*newest_first))).filter(F.col("_t") <= count)
    order = Window.partitionBy(*by).orderBy(*newest_first)
    total = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = some.withColumn("_t", F.row_number().over(order)).withColumn("_b", total).filter((F.col("_t") <= count) & (F.col("_b") <= limit))
    return kept.drop("_s", "_t", "_b")


def differences(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that are derived again but not stored (`missing`), and stored ones that nothing derives (`unknown`); none if the ledger holds."""
    missing = again.exceptAll(stored).withColumn("fault", F.lit("missing"))
    return missing.unionByName(stored.exceptAll(again).withColumn("fault", F.lit("unknown")))


def changed_fields(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path) for every field that differs between the two rows of a key; null is a value."""
    names = [n for n in before.columns if n != key]
    both = before.select(key, *[F.col(n).alias(f"_a_{n}") for n in names]).join(after.select(key, *[F.col(n).alias(f"_b_{n}") for n in names]), key)
    paths = F.array_compact(F.array(*[F.when(~F.col(f"_a_{n}").eqNullSafe(F.col(f"_b_{n}")), n) for n in names]))
    return both.select(key, F.explode(paths).alias("path"))


def immutable_append(stored: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, ids in conflict): an incoming row whose id is stored with the same content is no work, with another content a conflict."""
    content = [n for n in stored.columns if n != key]
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    old = stored.select(key, digest.alias("_old"))
    fresh = incoming.join(old, key, "left_anti").dropDuplicates([key])
    both = incoming.select(key, digest.alias("_new")).join(old, key)
    return fresh, both.filter("_old <> _new").select(key).distinct()


def pruned(batches: DataFrame, by: str, order: str, done: Column, share: float) -> DataFrame:
    """The batches without those among each key's oldest `share` that are wholly evaluated."""
    own = Window.partitionBy(by)
    marked = batches.withColumn("_t", F.row_number().over(own.orderBy(order))).withColumn("_n", F.count("*").over(own)).withColumn("_done", F.coalesce(done, F.lit(False)))
    return marked.filter(~(F.col("_done") & (F.col("_t") <= F.ceil(F.col("_n") * share)))).drop("_t", "_n", "_done")
