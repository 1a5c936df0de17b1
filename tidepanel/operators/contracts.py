"""Contracts of records, as arrays of the violated rules; a valid record has an empty array. Names of fields and values are fixed by the records.

Cases: a missing field (null) violates the rules that need it and no others; rules are independent of each other, so one record can have several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import violations

HORIZONS = (1, 5, 20)
STATUSES = ("published", "abstained", "insufficient_data", "not_applicable", "unavailable")
MODELS = ("trained", "not_trained", "not_implemented")
TARGETS = ("absolute_up", "relative_outperformance", "top_quartile", "none")
LINEAGE = ("raw_model", "calibrated_model", "historical_base_rate", "legacy_unknown")


def _outside(c: str, values: tuple) -> Column:
    return F.coalesce(~F.col(c).isin(*values), F.lit(True))


def prediction_violations() -> Column:
    """Over prediction_id, prediction_date, due_date, horizon, model, status, mode, source, target, probability, reasons (count), legacy."""
    c, status = F.col, F.col("status")
    p = c("probability")
    return violations(
        (F.coalesce(F.length("prediction_id") < 8, F.lit(True)), "id"),
        (c("due_date") <= c("prediction_date"), "due-date"),
        (_outside("horizon", HORIZONS), "horizon"),
        (_outside("model", MODELS), "model"),
        (_outside("status", STATUSES), "status"),
        (_outside("target", TARGETS), "target"),
        (p.isNotNull() & ~p.between(0, 100), "probability-range"),
        ((status == "published") & ((c("model") != "trained") | (c("mode") != "probability")), "published-model"),
        ((status == "published") & (p.isNull() | (c("target") == "none")), "published-probability"),
        ((status == "published") & _outside("source", LINEAGE), "published-lineage"),
        ((status == "abstained") & ((c("model") != "trained") | (c("mode") != "evidence_observation")), "abstained-model"),
        ((status != "published") & p.isNotNull(), "hidden-probability"),
        ((status == "abstained") & (F.coalesce(c("reasons"), F.lit(0)) == 0), "abstained-reasons"),
        (status.isin("not_applicable", "unavailable") & (c("model") == "trained"), "trained-without-output"),
        (status.isin("not_applicable", "unavailable") & ((c("source") != "none") | (c("target") != "none")), "lineage-without-output"),
        (c("legacy") & ((c("target") != "absolute_up") | ~c("source").isin("historical_base_rate", "legacy_unknown")), "legacy"),
    )


def state_violations() -> Column:
    """Over state_id, horizon, model, status, mode, source, target, probability, reasons (count), legacy: states never carry a probability."""
    c, status = F.col, F.col("status")
    return violations(
        (F.coalesce(F.length("state_id") < 8, F.lit(True)), "id"),
        (_outside("horizon", HORIZONS), "horizon"),
        (_outside("model", MODELS), "model"),
        (_outside("status", STATUSES[1:]), "status"),
        (c("probability").isNotNull(), "probability"),
        ((c("source") != "none") | (c("target") != "none"), "lineage"),
        (c("mode") != "none", "mode"),
        ((c("model") == "trained") & status.isin("unavailable", "not_applicable"), "trained-without-output"),
        ((status == "abstained") & ((c("model") != "trained") | (F.coalesce(c("reasons"), F.lit(0)) == 0)), "abstained"),
        (c("legacy"), "legacy"),
    )


def evidence_state(basis: DataFrame) -> DataFrame:
    """(observation, state) from rows (observation, relation, source_class, publisher, cluster).

    A contradiction by an official or primary source is conflicting; support by one is confirmed; two independent publishers corroborate;
    support by signals alone is unverified; anything else is of a single source. Publishers of one cluster of copies count once.
    """
    supports, contradicts = F.col("relation") == "supports", F.col("relation") == "contradicts"
    authority = F.col("source_class").isin("official", "primary")
    signal = F.col("source_class") == "signal"
    publisher = F.coalesce(F.col("cluster"), F.col("publisher"))
    each = basis.groupBy("observation").agg(
        F.count_if(contradicts & (authority | (F.col("source_class") == "press"))).alias("_against"), F.count_if(supports & authority).alias("_sure"),
        F.countDistinct(F.when(supports & ~signal, publisher)).alias("_publishers"), F.count_if(supports).alias("_for"), F.count_if(supports & signal).alias("_signals"),
    )
    state = F.when(F.col("_against") > 0, "conflicting").when(F.col("_sure") > 0, "confirmed").when(F.col("_publishers") >= 2, "corroborated")
    state = state.when((F.col("_for") > 0) & (F.col("_for") == F.col("_signals")), "unverified").otherwise("single-source")
    return each.select("observation", state.alias("state"))


def duplicate_clusters(documents: DataFrame, doc_id: str, url: str, content: str, order: list[str]) -> DataFrame:
    """(method, canonical, member): documents that share a url, then those of the rest that share their content; the first in `order` is canonical.

    Groups are only counted and reduced to their first member; no list of members is made.
    """
    first = F.min_by(doc_id, F.struct(*order))
    by_url = documents.filter(F.col(url).isNotNull()).groupBy(url).agg(F.count("*").alias("_n"), first.alias("canonical")).filter("_n > 1")
    one = documents.join(by_url.drop("_n"), url).select(F.lit("exact-url").alias("method"), "canonical", F.col(doc_id).alias("member"))
    rest = documents.join(by_url.select(url), url, "left_anti").withColumn("_hash", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256))
    by_hash = rest.groupBy("_hash").agg(F.count("*").alias("_n"), first.alias("canonical")).filter("_n > 1")
    two = rest.join(by_hash.drop("_n"), "_hash").select(F.lit("content-hash").alias("method"), "canonical", F.col(doc_id).alias("member"))
    return one.unionByName(two)


def packet_status(date: Column, edition: Column, raw: Column) -> Column:
    """missing, invalid, future, stale, partial, unavailable or valid."""
    day = F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), date)
    return (
        F.when(raw.isNull() & date.isNull(), "missing").when(day.isNull(), "invalid").when(day > edition, "future").when(day != edition, "stale")
        .when(raw.isin("partial", "partial-valid"), "partial").when(raw == "unavailable", "unavailable").otherwise("valid")
    )


def publication_quality(daily: Column, review: Column, writer: Column, sunday: Column) -> Column:
    """no_report on Sundays; fallback when the writer fell back or failed; degraded without a valid daily packet; writer_only without a usable review."""
    return F.when(sunday, "no_report").when(writer.isin("fallback", "failed"), "fallback").when(daily != "valid", "degraded").when(~review.isin("valid", "partial"), "writer_only").otherwise("normal")


def ranking_faults(rows: DataFrame, by: str, rank: str, value: str, names: list[str], least: float = 0.0, most: float = 100.0) -> DataFrame:
    """(by, faults) of rankings: `ranks` aren't 1 to n, a value out of `range`, a value above the one of the rank before (`order`), a name that stands twice (each column of `names` by itself).

    A missing rank, value or name is a fault of its kind.
    """
    before = F.lag(value).over(Window.partitionBy(by).orderBy(rank, *names))
    marked = rows.withColumn("_rise", F.coalesce(F.col(value) > before, F.lit(False)))
    n = F.count("*")
    found = marked.groupBy(by).agg(
        (~((F.countDistinct(rank) == n) & (F.min(rank) == 1) & (F.max(rank) == n))).alias("ranks"), F.bool_or(~F.coalesce(F.col(value).between(least, most), F.lit(False))).alias("range"),
        F.bool_or("_rise").alias("order"), *[(F.countDistinct(x) < n).alias(f"_{x}") for x in names],
    )
    return found.select(by, violations((F.col("ranks"), "ranks"), (F.col("range"), "range"), (F.col("order"), "order"), *[(F.col(f"_{x}"), x) for x in names]).alias("faults"))


def chart_faults(points: DataFrame, by: str, place: str, date: str, as_of: DataFrame) -> DataFrame:
    """(by, faults) of charts whose dates have to rise from place to place (`ascending`) and to end at the one date of `as_of` (`as-of`); a missing date is a fault of the first kind."""
    before = F.lag(date).over(Window.partitionBy(by).orderBy(place))
    marked = points.withColumn("_bad", F.col(date).isNull() | F.coalesce(F.col(date) <= before, F.lit(False)))
    each = marked.groupBy(by).agg(F.bool_or("_bad").alias("_bad"), F.max_by(date, place).alias("_last"), F.lit(1).alias("_k"))
    end = as_of.select(F.col(as_of.columns[0]).alias("_end"), F.lit(1).alias("_k"))
    return each.join(F.broadcast(end), "_k").select(by, violations((F.col("_bad"), "ascending"), (~F.col("_last").eqNullSafe(F.col("_end")), "as-of")).alias("faults"))  # one row


#: Fixed values of the events' contracts.
AUTHORITIES = ("central", "ministry", "exchange", "hong-kong", "registry")
STAGES = ("not_applicable", "meeting_statement", "draft", "published", "effective", "implemented", "under_implementation", "suspended", "unknown")
EVIDENCE = ("official_confirmed", "reliable_report", "market_inference", "no_event_claimed")
DAY = r"^\d{4}-\d{2}-\d{2}"


def policy_event_faults(events: DataFrame, issuers: DataFrame) -> DataFrame:
    """The rows with `faults` of policy events (event_id, issuer, authority, document_type, published, effective, stage, url, threads, status) against the registry's issuers (issuer).

    An effective date and a url may be missing; a statement of a meeting can't be in force; bootstrap rows need no registered issuer.
    """
    known = issuers.select(F.col("issuer").alias("_issuer"), F.lit(True).alias("_known")).distinct()
    met = events.join(known, events["issuer"] == known["_issuer"], "left").drop("_issuer")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    day = lambda c: F.coalesce(F.col(c).rlike(DAY), F.lit(False))
    faults = violations(
        (blank("event_id"), "event-id"), (blank("issuer"), "issuer"), (_outside("authority", AUTHORITIES), "authority"), (blank("document_type"), "document-type"), (~day("published"), "published"),
        (F.col("effective").isNotNull() & ~day("effective"), "effective"), (_outside("stage", STAGES), "stage"), (F.col("url").isNotNull() & ~F.col("url").rlike("^https?://"), "url"), (F.col("threads").isNull(), "threads"),
        ((F.col("document_type") == "meeting_statement") & F.col("stage").isin("effective", "implemented"), "statement-in-force"), (~F.col("status").eqNullSafe("bootstrap") & F.col("_known").isNull(), "unregistered"),
    )
    return met.withColumn("faults", faults).drop("_known")


def capital_event_faults(events: DataFrame, payment: str, capital: str) -> DataFrame:
    """The rows with `faults` of state-capital events (event_id, subjects, scope, evidence, threads, url): payment matters (a pattern over the whole record) are no state capital (another)."""
    whole = F.to_json(F.struct(*events.columns))
    faults = violations(
        (F.coalesce(F.col("event_id"), F.lit("")) == "", "event-id"), (F.col("subjects").isNull() & F.col("scope").isNull(), "subjects"), (_outside("evidence", EVIDENCE), "evidence"), (F.col("threads").isNull(), "threads"),
        (whole.rlike(payment) & whole.rlike(capital), "payment-as-capital"), ((F.col("evidence") == "official_confirmed") & (F.coalesce(F.col("url"), F.lit("")) == ""), "official-without-url"),
    )
    return events.withColumn("faults", faults)
