"""Reports, panels of several markets and decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.operators import chained as CH
from tidepanel.operators import decisions as N
from tidepanel.operators import features as X
from tidepanel.operators import labels as L
from tidepanel.operators import ledger as G
from tidepanel.operators import metrics as E
from tidepanel.operators import policies as Q
from tidepanel.queries.aggregates import predictions
from tidepanel.queries.features import labels, r6, scored, z_scores
from tidepanel.queries.models import _holds, _named
from tidepanel.queries.registry import query
from tidepanel.queries.scalars import session_of
from tidepanel.session import shared_dir, table
from tidepanel.sources import panel as P

c = F.col
_AUC = "SELECT horizon, (sum(r) FILTER ({y} = 1) - count(*) FILTER ({y} = 1) * (count(*) FILTER ({y} = 1) + 1) / 2) / nullif(count(*) FILTER ({y} = 1) * count(*) FILTER ({y} = 0), 0) AS auc FROM (SELECT horizon, {y}, rank() OVER (PARTITION BY horizon ORDER BY {p}) + (count(*) OVER (PARTITION BY horizon, {p}) - 1) / 2 AS r FROM {t}) GROUP BY 1"


@query(
    "r1_source_audit",
    "WITH s AS (SELECT c_nationkey AS n_nationkey, count(*) AS rows, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT n_nationkey, coalesce(rows, 0) AS rows, first, last, CASE WHEN rows >= 600 THEN 'ready' WHEN rows > 0 THEN 'partial' ELSE 'unavailable' END AS status, n_regionkey < 2 AND coalesce(rows, 0) < 600 AS failure FROM nation LEFT JOIN s USING (n_nationkey)",
)
def r1(spark, d):
    bought = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    day = F.to_date("o_orderdate")
    stats = bought.groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"))
    sources = table(spark, d, "nation").select("n_nationkey", (c("n_regionkey") < 2).alias("required"))
    return N.source_audit(sources, stats, "n_nationkey", 600).select("n_nationkey", "rows", "first", "last", "status", "failure")


def wide_priorities(spark, d):
    """One row per week with the close of each priority."""
    rows = P.priority_panel(spark, d)
    return rows.groupBy("date").agg(*[F.max(F.when(c("code").startswith(str(i)), c("close"))).alias(f"m{i}") for i in range(1, 6)])


_MACRO = "macro AS (SELECT date, " + ", ".join(f"max(close) FILTER (code LIKE '{i}%') AS m{i}" for i in range(1, 6)) + " FROM prio GROUP BY 1)"


@query(
    "r5_two_object_panel",
    f"WITH {_MACRO} SELECT date, code, round(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1, 6) AS ret, m1, coalesce(m2, m3) AS backed, m4, m5 FROM flags LEFT JOIN macro USING (date) WHERE code IN ('A', 'N') AND date >= DATE '1996-01-01'",
    "prio", "flags",
)
def r5(spark, d):
    two = P.flag_panel(spark, d).filter(c("code").isin("A", "N") & (c("date") >= F.lit("1996-01-01").cast("date")))
    return two.select("date", "code", F.round(X.change("close", 1), 6).alias("ret")).join(wide_priorities(spark, d), "date", "left").select("date", "code", "ret", "m1", F.coalesce("m2", "m3").alias("backed"), "m4", "m5")


@query(
    "r6_index_panel",
    "WITH a AS (SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS r20 FROM flags WHERE code = 'A'), n AS (SELECT date, close AS vix, close / lag(close, 5) OVER (ORDER BY date) - 1 AS vix5 FROM flags WHERE code = 'N'), b AS (SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS b20 FROM bench) SELECT date, round(r20, 6) AS return20, vix, round(vix5, 6) AS vix5, round(r20 - b20, 6) AS relative20 FROM a JOIN n USING (date) JOIN b USING (date)",
    "flags", "bench",
)
def r6_(spark, d):
    flags = P.flag_panel(spark, d)
    a = flags.filter("code = 'A'").select("date", X.change("close", 20).alias("r20"))
    n = flags.filter("code = 'N'").select("date", c("close").alias("vix"), X.change("close", 5).alias("vix5"))
    b = P.benchmark(spark, d).withColumn("code", F.lit("=")).select("date", X.change("close", 20).alias("b20"))
    return a.join(n, "date").join(b, "date").select("date", F.round("r20", 6).alias("return20"), "vix", F.round("vix5", 6).alias("vix5"), F.round(c("r20") - c("b20"), 6).alias("relative20"))


@query("r7_curve_slope", "WITH s AS (SELECT a.date, n.close - a.close AS slope FROM flags a JOIN flags n ON a.date = n.date AND a.code = 'A' AND n.code = 'N') SELECT date, round(100 * slope, 2) + 0.0 AS slope_bp, round(100 * (slope - lag(slope, 5) OVER (ORDER BY date)), 2) + 0.0 AS change_bp FROM s", "flags")
def r7(spark, d):
    flags = P.flag_panel(spark, d)
    n = flags.filter("code = 'N'").select("date", c("close").alias("n"))
    s = flags.filter("code = 'A'").join(n, "date").select("date", "code", (c("n") - c("close")).alias("slope"))
    plain = lambda x: F.round(100 * x, 2) + F.lit(0.0)
    return s.select("date", plain(c("slope")).alias("slope_bp"), plain(c("slope") - F.lag("slope", 5).over(X.series())).alias("change_bp"))


@query("r9_tied_auc", f"WITH q AS (SELECT horizon, top_quartile, round(p, 3) AS p FROM scored) SELECT horizon, round(auc, 6) AS auc FROM ({_AUC.format(y='top_quartile', p='p', t='q')})", "scored")
def r9(spark, d):
    return E.auc(scored(spark, d).withColumn("p", F.round("p", 3)), ["horizon"], "p", "top_quartile").select("horizon", *r6("auc"))


@query("r12_multi_target_scores", "SELECT date, code, t AS target, round(CASE t WHEN 'up' THEN 0.1 + 0.3 * z_momentum5 ELSE -1.1 + 0.5 * z_momentum20 - 0.2 * z_volatility20 END, 6) AS score FROM zs, (VALUES ('up'), ('top')) v(t)", "zs")
def r12(spark, d):
    up, top = 0.1 + 0.3 * c("z_momentum5"), -1.1 + 0.5 * c("z_momentum20") - 0.2 * c("z_volatility20")
    both = F.explode(F.array(F.struct(F.lit("up").alias("target"), up.alias("score")), F.struct(F.lit("top").alias("target"), top.alias("score")))).alias("s")
    return z_scores(spark, d).select("date", "code", both).select("date", "code", "s.target", F.round("s.score", 6).alias("score"))


_PCT = "round(100 * (1 - (row_number() OVER (PARTITION BY date ORDER BY round(x, 10) DESC, code) - 1) / greatest(1, count(*) OVER (PARTITION BY date) - 1)), 1)"


@query("r13_observation", f"WITH w AS (SELECT date, code, close AS x FROM prio QUALIFY count(*) OVER (PARTITION BY date) = 5), l AS (SELECT * FROM w WHERE date = (SELECT max(date) FROM w)) SELECT date, code, {_PCT} AS score FROM l", "prio")
def r13(spark, d):
    whole = P.priority_panel(spark, d).withColumn("n", F.count("*").over(X.cross())).filter("n = 5")
    newest = F.broadcast(whole.agg(F.max("date").alias("date")))
    return whole.join(newest, "date").select("date", "code", L.percentile_score("close").alias("score"))


@query(
    "r14_common_session",
    f"WITH k AS (SELECT date FROM flags GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT code) FROM flags)), f AS (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS x FROM flags), l AS (SELECT * FROM f WHERE date = (SELECT max(date) FROM k)) SELECT date, code, round(x, 6) AS change, {_PCT} AS score FROM l",
    "flags",
)
def r14(spark, d):
    flags = P.flag_panel(spark, d).withColumn("x", X.change("close", 1))
    size = X.universe_size(flags)
    newest = F.broadcast(flags.groupBy("date").agg(F.count("*").alias("n")).filter(c("n") == size).agg(F.max("date").alias("date")))
    return flags.join(newest, "date").select("date", "code", F.round("x", 6).alias("change"), L.percentile_score("x").alias("score"))


@query(
    "r15_snapshot_coverage",
    "WITH f AS (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS x FROM panel), l AS (SELECT * FROM f WHERE date = (SELECT max(date) FROM panel)) SELECT code, round(x, 6) AS change, row_number() OVER (ORDER BY round(x, 9) DESC NULLS LAST, code) AS place, CASE WHEN count(*) OVER () = (SELECT count(DISTINCT code) FROM panel) THEN 'complete' ELSE 'partial' END AS coverage FROM l",
    "panel",
)
def r15(spark, d):
    panel = P.brand_panel(spark, d).withColumn("x", X.change("close", 1))
    size = X.universe_size(panel)
    last = panel.join(F.broadcast(panel.agg(F.max("date").alias("date"))), "date")  # one row per code
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("x", 9)), "code"))
    coverage = F.when(F.count("*").over(Window.partitionBy()) == size, "complete").otherwise("partial")
    return last.select("code", F.round("x", 6).alias("change"), place.alias("place"), coverage.alias("coverage"))


@query("r17_breadth_digest", "SELECT date, sha256(string_agg(code || ':' || CAST(up AS VARCHAR), ',' ORDER BY code)) AS digest, count(*) AS members FROM (SELECT date, code, CAST(ret > 0 AS INTEGER) AS up FROM raw WHERE ret IS NOT NULL) GROUP BY 1", "raw")
def r17(spark, d):
    rows = P.brand_panel(spark, d).select("date", "code", X.change("close", 1).alias("ret")).filter("ret is not null")
    parts = F.array_sort(F.collect_list(F.struct("code", (c("ret") > 0).cast("int").alias("up"))))  # one entry per code of the universe
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["code"], F.lit(":"), p["up"].cast("string"))), ",")
    return rows.groupBy("date").agg(F.sha2(text, 256).alias("digest"), F.count("*").alias("members"))


@query("r19_flattened_records", "SELECT prediction_id, 'published' AS branch, round(p, 6) AS p FROM pred WHERE status = 'published' UNION ALL SELECT prediction_id, 'abstained', NULL FROM pred WHERE status = 'abstained'", "pred")
def r19(spark, d):
    item = F.struct("prediction_id", "status", F.round("p", 6).alias("p"))
    nested = predictions(spark, d).groupBy("prediction_date", "horizon").agg(F.collect_list(item).alias("items"))  # the codes of one date
    items = nested.select(F.explode("items").alias("i")).select("i.*")
    published = items.filter("status = 'published'").select("prediction_id", F.lit("published").alias("branch"), "p")
    return published.unionByName(items.filter("status = 'abstained'").select("prediction_id", F.lit("abstained").alias("branch"), F.lit(None).cast("double").alias("p")))


@query("r23_legacy_contract", "SELECT prediction_id, CASE WHEN status = 'legacy' THEN 'absolute_up' ELSE 'top_quartile' END AS target, CASE WHEN status = 'legacy' THEN 'legacy_unknown' WHEN status = 'published' THEN 'raw_model' ELSE 'none' END AS source, CASE WHEN status <> 'abstained' THEN round(100 * p, 4) END AS probability FROM pred", "pred")
def r23(spark, d):
    status = c("status")
    return predictions(spark, d).select(
        "prediction_id", F.when(status == "legacy", "absolute_up").otherwise("top_quartile").alias("target"), F.when(status == "legacy", "legacy_unknown").when(status == "published", "raw_model").otherwise("none").alias("source"),
        F.when(status != "abstained", F.round(100 * c("p"), 4)).alias("probability"),
    )


@query("r25_public_states", "SELECT prediction_id AS id, code, round(p, 6) AS p, NULL AS reason FROM pred WHERE status = 'published' UNION ALL SELECT prediction_id, code, NULL, status FROM pred WHERE status <> 'published'", "pred")
def r25(spark, d):
    rows = predictions(spark, d).select(c("prediction_id").alias("id"), "code", F.round("p", 6).alias("p"), "status")
    states = rows.filter("status <> 'published'").select("id", "code", c("status").alias("reason"))
    return rows.filter("status = 'published'").drop("status").unionByName(states, allowMissingColumns=True)


@query(
    "r28_lineage",
    "SELECT model, count(*) AS n, CASE model WHEN 'm1' THEN 'contract' WHEN 'm2' THEN 'dataset' ELSE '' END AS faults FROM pred GROUP BY 1",
    "pred",
)
def r28(spark, d):
    """Each model's card against what is derived again: its dataset's digest, its contract's, and the card's own over both."""
    rows = predictions(spark, d).withColumn("p", F.round("p", 6))
    content = ["prediction_id", "model", "horizon", "p"]

    def cards(df):
        data = CH.level_digests(CH.with_digest(df, content), [["model", "horizon"], ["model"]])[1].withColumnRenamed("digest", "dataset")
        terms = df.groupBy("model").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(c("horizon").cast("string")))), 256).alias("contract"))  # horizons are few
        return data.join(terms, "model").withColumn("card", F.sha2(F.concat_ws("|", "model", "dataset", "contract"), 256))

    made = cards(rows.withColumn("p", c("p") + F.when((c("model") == "m2") & (c("code") == "Brand#11"), 0.1).otherwise(0.0)))
    made = made.withColumn("contract", F.when(c("model") == "m1", F.sha2(F.lit("other"), 256)).otherwise(c("contract"))).withColumn("card", F.sha2(F.concat_ws("|", "model", "dataset", "contract"), 256))
    both = cards(rows).join(made.select("model", *[c(x).alias(f"_{x}") for x in ("dataset", "contract", "card")]), "model", "left")
    whole = F.sha2(F.concat_ws("|", "model", "_dataset", "_contract"), 256)
    faults = S.violations((~c("dataset").eqNullSafe(c("_dataset")), "dataset"), (~c("contract").eqNullSafe(c("_contract")), "contract"), (~whole.eqNullSafe(c("_card")), "card"))
    return both.select("model", "n", F.array_join(faults, ",").alias("faults"))


@query("r29_coverage_contract", "SELECT code, list_filter([CASE WHEN v < 0.5 THEN 'below-frozen' END, CASE WHEN v > 0.7 THEN 'above-limit' END], lambda x: x IS NOT NULL) AS violations FROM (SELECT code, round(count(*) FILTER (volume > 400) / count(*), 9) AS v FROM panel GROUP BY 1)", "panel")
def r29(spark, d):
    v = P.brand_panel(spark, d).groupBy("code").agg(F.round(F.count_if(c("volume") > 400) / F.count("*"), 9).alias("v"))
    return v.select("code", S.violations((c("v") < 0.5, "below-frozen"), (c("v") > 0.7, "above-limit")).alias("violations"))


def candidate_metrics(spark, d):
    """Per horizon the metrics of the composite score for its own target and for the top quartile."""
    rows = scored(spark, d)
    own = E.brier(rows, ["horizon"]).select("horizon", "n", "brier", "brier_skill").join(E.auc(rows, ["horizon"]), "horizon")
    return own.join(E.calibration_error(rows, ["horizon"]), "horizon").join(E.auc(rows, ["horizon"], "p", "top_quartile").withColumnRenamed("auc", "top_auc"), "horizon")


_CANDIDATE = f"""a AS ({_AUC.format(y='y', p='p', t='scored')}), t AS ({_AUC.format(y='top_quartile', p='p', t='scored')}), e AS (SELECT horizon, sum(n * gap) / sum(n) AS ece FROM (SELECT horizon, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT horizon, count(*) AS n, avg((p - y) ** 2) AS brier, 1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))) AS brier_skill FROM scored GROUP BY 1), cand AS (SELECT b.*, a.auc, e.ece, t.auc AS top_auc FROM b JOIN a USING (horizon) JOIN e USING (horizon) JOIN t USING (horizon))"""


@query("r30_candidate_metrics", f"WITH {_CANDIDATE} SELECT horizon, n, round(brier, 6) AS brier, round(brier_skill, 6) AS brier_skill, round(auc, 6) AS auc, round(ece, 6) AS ece, round(top_auc, 6) AS top_auc FROM cand", "scored")
def r30(spark, d):
    return candidate_metrics(spark, d).select("horizon", "n", *r6("brier", "brier_skill", "auc", "ece", "top_auc"))


@query("r33_article_index", "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders")
def r33(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("edition"), F.when(c("o_orderpriority").startswith("1"), 0).otherwise(1).alias("kind"))
    return G.placed(rows, [F.desc("edition"), c("kind").asc(), c("o_orderkey").asc()], "place").select("o_orderkey", "place")


@query("r34_session_with_cutoff", "SELECT o_orderkey, (SELECT max(date) FROM bench WHERE date <= CAST(o_orderdate AS DATE) - CAST(o_orderkey % 2 AS INTEGER)) AS session FROM orders", "bench")
def r34(spark, d):
    early = (c("o_orderkey") % 2).cast("int")  # asked before the cut-off
    rows = table(spark, d, "orders").select("o_orderkey", F.date_sub(F.to_date("o_orderdate"), early).alias("limit"))
    return session_of(rows, "limit", P.benchmark(spark, d), 0, "session").select("o_orderkey", "session")


@query("r37_public_view", "SELECT code, string_agg(horizon || '=' || printf('%.3f', round(p, 3)), ' ' ORDER BY horizon) AS shown FROM scored WHERE date = (SELECT max(date) FROM scored WHERE horizon = 20) GROUP BY 1", "scored")
def r37(spark, d):
    rows = scored(spark, d)
    newest = F.broadcast(rows.filter("horizon = 20").agg(F.max("date").alias("date")))
    parts = F.array_sort(F.collect_list(F.struct("horizon", F.format_string("%.3f", F.round("p", 3)).alias("p"))))  # three horizons
    shown = F.array_join(F.transform(parts, lambda x: F.concat(x["horizon"].cast("string"), F.lit("="), x["p"])), " ")
    return rows.join(newest, "date").groupBy("code").agg(shown.alias("shown"))


@query("q9_due_date_again", "SELECT s.date, t.date AS due FROM sess s JOIN sess t ON t.session = s.session + 5", "sess")
def q9(spark, d):
    days = L.calendar(P.benchmark(spark, d))
    due = days.select((c("session") - 5).alias("session"), c("date").alias("due"))
    return days.join(due, "session").select("date", "due")


@query(
    "q16_claim_faults",
    "SELECT o_orderkey AS claim, CASE WHEN c_custkey IS NULL THEN ['unknown-fact'] ELSE list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'path' END, CASE WHEN o_orderkey % 6 = 0 THEN 'value' END, CASE WHEN c_acctbal < 0 AND o_orderkey % 2 = 0 THEN 'wording' END], lambda x: x IS NOT NULL) END AS faults FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) ON c_custkey = o_custkey",
)
def q16(spark, d):
    k = c("o_orderkey")
    facts = table(spark, d, "customer").filter("c_custkey % 9 <> 0").select(c("c_custkey").alias("fact"), c("c_nationkey").alias("value"), F.when(c("c_acctbal") < 0, "reported").otherwise("verified").alias("status"))
    nations = table(spark, d, "customer").select(c("c_custkey").alias("fact"), c("c_nationkey").alias("n"))
    claims = table(spark, d, "orders").select(k.alias("claim"), c("o_custkey").alias("fact"), F.when(k % 4 == 0, "title.0").otherwise("body.0").alias("path"), k).join(nations, "fact", "left")
    claims = claims.select("claim", "fact", "path", (c("n") + F.when(k % 6 == 0, 1).otherwise(0)).alias("value"), F.when(k % 2 == 0, "certain").otherwise("possible").alias("wording"))
    return N.claim_faults(claims, facts)


@query("q17_bound_observations", "SELECT c_custkey AS claim, count(s_suppkey) > 0 AND coalesce(bool_and(s_nationkey % 2 = c_custkey % 2), false) AS bound FROM customer LEFT JOIN supplier ON s_suppkey IN (c_custkey % 100 + 1, c_custkey % 7 + 1) GROUP BY 1")
def q17(spark, d):
    observations = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), (c("s_nationkey") % 2).alias("state"))
    known = observations.select("id")
    ids = F.array_distinct(F.array(c("c_custkey") % 100 + 1, c("c_custkey") % 7 + 1))
    asked = table(spark, d, "customer").select(c("c_custkey").alias("claim"), (c("c_custkey") % 2).alias("state"), F.explode(ids).alias("id")).join(known, "id", "left_semi")
    claims = asked.groupBy("claim", "state").agg(F.collect_list("id").alias("ids"))  # two at most
    every = table(spark, d, "customer").select(c("c_custkey").alias("claim"))
    found = N.bound_observations(claims, observations)
    return every.join(found, "claim", "left").select("claim", F.coalesce("bound", F.lit(False)).alias("bound"))


@query("q26_state_event_contract", "SELECT event_id, list_filter([CASE WHEN user_id % 10 = 0 THEN 'entity' END, CASE WHEN event_type = 'purchase' AND value < 2 THEN 'amount' END, CASE WHEN event_type = 'error' THEN 'kind' END], lambda x: x IS NOT NULL) AS violations FROM events")
def q26(spark, d):
    return table(spark, d, "events").select("event_id", S.violations((c("user_id") % 10 == 0, "entity"), ((c("event_type") == "purchase") & (c("value") < 2), "amount"), (c("event_type") == "error", "kind")).alias("violations"))


@query("q28_cross_date_contract", "SELECT code, list_filter([CASE WHEN max(date) <> (SELECT max(date) FROM bench) THEN 'stale' END, CASE WHEN count(*) < 300 THEN 'short' END, CASE WHEN count(*) <> count(DISTINCT date) THEN 'repeated' END], lambda x: x IS NOT NULL) AS violations FROM panel GROUP BY 1", "panel", "bench")
def q28(spark, d):
    newest = P.benchmark(spark, d).agg(F.max("date").alias("newest"), F.lit(1).alias("k"))
    each = P.brand_panel(spark, d).groupBy("code").agg(F.max("date").alias("last"), F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.lit(1).alias("k"))
    return each.join(F.broadcast(newest), "k").select("code", S.violations((c("last") != c("newest"), "stale"), (c("n") < 300, "short"), (c("n") != c("days"), "repeated")).alias("violations"))


@query(
    "m21_promotion",
    f"""WITH q AS (SELECT horizon, y, p, round(1 / (1 + exp(-momentum20)), 9) AS q FROM scored), a AS ({_AUC.format(y='y', p='p', t='q')}), b AS ({_AUC.format(y='y', p='q', t='q')}), m AS (SELECT horizon, avg((p - y) ** 2) AS pb, avg((q - y) ** 2) AS qb FROM q GROUP BY 1)
    SELECT horizon, list_filter([CASE WHEN qb > pb + 0.001 THEN 'inferior-brier' END, CASE WHEN b.auc < a.auc - 0.01 THEN 'inferior-auc' END, CASE WHEN NOT (b.auc > a.auc OR qb < pb) THEN 'no-positive-evidence' END], lambda x: x IS NOT NULL) AS reasons FROM m JOIN a USING (horizon) JOIN b USING (horizon)""",
    "scored",
)
def m21(spark, d):
    rows = scored(spark, d).withColumn("q", F.round(S.sigmoid(c("momentum20")), 9))

    def of(name: str, p: str):
        return E.brier(rows, ["horizon"], p).select("horizon", c("brier").alias(f"{name}_brier")).join(E.auc(rows, ["horizon"], p).select("horizon", c("auc").alias(f"{name}_auc"), c("auc").alias(f"{name}_ic")), "horizon")

    return of("a", "p").join(of("b", "q"), "horizon").select("horizon", N.promotion_reasons("a", "b").alias("reasons"))


def _check(h, r):
    return r[6] is None or r[6] == h


_FAILED = "CASE horizon " + " ".join(f"WHEN {h} THEN {_named([r for r in Q.PUBLICATION if _check(h, r)], lambda r: 'NOT ' + _holds(r))}" for h in ("1", "5", "20")) + " END"


_M23 = f"""WITH a AS ({_AUC.format(y='y', p='p', t='scored')}), b AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) // 13 AS b FROM (SELECT DISTINCT date FROM scored)),
    f AS (SELECT horizon, b, avg(y) * (1 - avg(y)) - avg((p - y) ** 2) AS gain FROM scored JOIN b USING (date) GROUP BY 1, 2), g AS (SELECT horizon, count(*) AS folds, round(avg(CAST(gain > 0 AS INTEGER)), 9) AS fold_share, round(max(gain) FILTER (gain > 0) / sum(gain) FILTER (gain > 0), 9) AS largest_share FROM f GROUP BY 1),
    n AS (SELECT CAST(min(n) >= 300 AS INTEGER) AS sources_ready FROM (SELECT code, count(*) AS n FROM panel GROUP BY 1)), l AS (SELECT horizon, CAST(bool_and(target_date > date) AS INTEGER) AS leakage_free FROM lab GROUP BY 1),
    m AS (SELECT horizon, count(*) AS samples, CAST(count(DISTINCT code) = (SELECT count(DISTINCT code) FROM panel) AS INTEGER) AS dataset_ready, 1 AS model_trained, round(1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))), 9) AS brier_skill,
      round(1 - avg(-(y * ln(greatest(p, 1e-12)) + (1 - y) * ln(greatest(1 - p, 1e-12)))) / ln(2), 9) AS log_loss_skill, round(regr_slope(y, p), 9) AS slope, round(regr_intercept(y, p), 9) AS intercept, round(stddev_pop(p), 9) AS dispersion, round(avg(CAST(abs(p - 0.5) >= 0.02 AS INTEGER)), 9) AS coverage FROM scored GROUP BY 1),
    z AS (SELECT * REPLACE (round(auc, 9) AS auc) FROM m JOIN a USING (horizon) JOIN g USING (horizon) JOIN l USING (horizon), n), r AS (SELECT horizon, {_FAILED} AS failed FROM z)
    SELECT horizon, CASE WHEN list_has_any(failed, ['model_availability_trained', 'valid_fold_count', 'oos_sample_count']) THEN 'insufficient_data' WHEN len(failed) > 0 THEN 'abstained' ELSE 'published' END AS status, failed, 15 - len(failed) AS passed FROM r"""


@query("m23_publication_gate", _M23, "scored")
def m23(spark, d):
    """Every horizon against the fifteen checks of the publication policy. Slope and intercept are those of the outcomes' line over the probabilities."""
    rows, panel = scored(spark, d), P.brand_panel(spark, d)
    block = X.blocks(rows.select("date").distinct(), 13)  # a row per date
    folds = E.brier(rows.join(F.broadcast(block), "date"), ["horizon", "block"]).withColumn("_gain", c("baseline_brier") - c("brier"))
    gain = F.when(c("_gain") > 0, c("_gain"))
    folded = folds.groupBy("horizon").agg(F.count("*").alias("folds"), F.avg((c("_gain") > 0).cast("int")).alias("fold_share"), F.try_divide(F.max(gain), F.sum(gain)).alias("largest_share"))
    size = panel.agg(F.countDistinct("code").alias("_size"), F.lit(1).alias("model_trained"))
    healthy = panel.groupBy("code").agg(F.count("*").alias("_n")).agg((F.min("_n") >= 300).cast("int").alias("sources_ready"), F.lit(1).alias("model_trained"))
    clean = labels(spark, d).groupBy("horizon").agg(F.bool_and(c("target_date") > c("date")).cast("int").alias("leakage_free"))
    line = rows.groupBy("horizon").agg(
        F.count("*").alias("samples"), F.countDistinct("code").alias("_codes"), F.regr_slope("y", "p").alias("slope"), F.regr_intercept("y", "p").alias("intercept"), F.stddev_pop("p").alias("dispersion"),
        F.avg((F.abs(c("p") - 0.5) >= 0.02).cast("int")).alias("coverage"), F.lit(1).alias("model_trained"),
    )
    skill = E.brier(rows, ["horizon"]).select("horizon", "brier_skill", (1 - c("log_loss") / F.ln(F.lit(2.0))).alias("log_loss_skill"))
    all_ = line.join(skill, "horizon").join(folded, "horizon").join(clean, "horizon").join(E.auc(rows, ["horizon"]), "horizon").join(F.broadcast(size), "model_trained").join(F.broadcast(healthy), "model_trained")
    real = ["slope", "intercept", "dispersion", "coverage", "brier_skill", "log_loss_skill", "fold_share", "largest_share", "auc"]
    metrics = all_.select("horizon", c("horizon").alias("_h"), "samples", "folds", "leakage_free", "model_trained", "sources_ready", (c("_codes") == c("_size")).cast("int").alias("dataset_ready"), *[F.round(x, 9).alias(x) for x in real])
    return Q.publication(metrics, Q.policy(spark, Q.PUBLICATION), "horizon", "_h").select("horizon", "status", "failed", F.size("passed").alias("passed"))


@query("r36_state_rows", f"SELECT horizon, status, CAST(len(failed) AS INTEGER) AS reasons, (SELECT max(date) FROM scored) AS as_of, 'state-' || horizon || '-' || status || '-' || (SELECT max(date) FROM scored) AS state_id FROM ({_M23}) WHERE status <> 'published'", "scored")
def r36(spark, d):
    """A state row for every horizon that the gate doesn't publish, with no probability and an id of its own."""
    newest = scored(spark, d).agg(F.max("date").alias("as_of"), F.lit(1).alias("_k"))
    states = m23(spark, d).filter("status <> 'published'").withColumn("_k", F.lit(1)).join(F.broadcast(newest), "_k")  # one row
    return states.select("horizon", "status", F.size("failed").alias("reasons"), "as_of", F.concat_ws("-", F.lit("state"), c("horizon").cast("string"), "status", c("as_of").cast("string")).alias("state_id"))


@query(
    "m34_curve_status",
    "WITH x AS (SELECT date, count(*) FILTER (code IN ('A', 'N')) AS n, row_number() OVER (ORDER BY date) AS k FROM flags GROUP BY 1) SELECT date, CASE WHEN k % 7 > 4 THEN 'stale' WHEN n = 2 AND k > 20 THEN 'ready' ELSE 'partial' END AS status FROM x",
    "flags",
)
def m34(spark, d):
    days = P.flag_panel(spark, d).groupBy("date").agg(F.count_if(c("code").isin("A", "N")).alias("n"))
    numbered = days.withColumn("k", F.row_number().over(Window.orderBy("date")))  # one row per date
    return numbered.select("date", S.curve_status(c("k") % 7, F.lit(4), (c("n") == 2) & (c("k") > 20)).alias("status"))


@query("p14_outcome_calendar", "SELECT date, code, horizon, list_filter([CASE WHEN code = 'Brand#11' THEN 'no-session' END, CASE WHEN code = 'Brand#12' THEN 'horizon' END], lambda x: x IS NOT NULL) AS violations FROM lab", "lab")
def p14(spark, d):
    bench = P.benchmark(spark, d)
    later = F.when(c("code") == "Brand#11", F.date_add("target_date", 1)).when(c("code") == "Brand#12", c("date")).otherwise(c("target_date"))
    return L.calendar_faults(labels(spark, d).withColumn("target_date", later), bench).select("date", "code", "horizon", "violations")


@query(
    "s16_feed_items",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place, o_orderkey % 3 = 0 AS atom FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 13 <> 0)
    SELECT l_orderkey, place, CASE WHEN atom THEN 'atom' ELSE 'rss' END AS format, l_partkey % 9 <> 0 AND l_partkey % 10 <> 1 AS kept, CASE WHEN l_partkey % 9 <> 0 THEN 'Part & ' || l_partkey END AS title,
      CASE WHEN l_partkey % 10 <> 1 THEN 'https://example.org/p/' || l_partkey END AS url, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_shipdate AS DATE) END AS published, 'about part ' || l_partkey AS summary, CASE WHEN l_returnflag < l_linestatus THEN l_returnflag || ',' || l_linestatus WHEN l_returnflag > l_linestatus THEN l_linestatus || ',' || l_returnflag ELSE l_returnflag END AS categories,
      CASE WHEN l_partkey % 9 = 0 THEN 'skip-missing-title' WHEN l_partkey % 10 = 1 THEN 'skip-missing-link' WHEN l_partkey % 4 = 0 THEN 'missing-published-date' ELSE '' END AS reasons FROM l
    UNION ALL SELECT o_orderkey, 0, NULL, false, NULL, NULL, NULL, '', NULL, 'xml-doctype-forbidden' FROM orders WHERE o_orderkey % 13 = 0""",
)
def s16(spark, d):
    """Every item of every feed, in both formats, with what was left out and why."""
    from tidepanel.sources.feeds import feed_entries

    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    whole = table(spark, d, "orders").join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def item(x, atom):
        n = x["l_partkey"]
        title = F.when(n % 9 == 0, "").otherwise(text("<title> Part &amp; ", n, " </title>"))
        address = text(F.when(n % 10 == 1, "http").otherwise("https"), "://EXAMPLE.org/p/", n, "#top")
        about = text("&lt;b&gt;about&lt;/b&gt; part ", n)
        if atom:
            day = F.when(n % 4 == 0, "").otherwise(text("<published>", F.date_format(x["l_shipdate"], "yyyy-MM-dd"), "T08:00:00Z</published>"))
            return text("<entry>", title, '<link rel="self" href="https://example.org/self"/><link href="', address, '"/><id>', n, "</id>", day, "<summary>", about, '</summary><category term="', x["l_returnflag"], '"/><category term="', x["l_linestatus"], '"/></entry>')
        day = F.when(n % 4 == 0, "").otherwise(text("<pubDate>", F.date_format(x["l_shipdate"], "EEE, dd MMM yyyy"), " 08:00:00 GMT</pubDate>"))
        return text("<item>", title, "<link>", address, '</link><guid isPermaLink="false">', n, "</guid>", day, "<description>", about, "</description><category>", x["l_linestatus"], '</category><category domain="d">', x["l_returnflag"], "</category></item>")

    rss = text("<rss version='2.0'><channel><title>t</title>", F.coalesce(F.array_join(F.transform("lines", lambda x: item(x, False)), ""), F.lit("")), "</channel></rss>")
    atom = text("<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'>", F.coalesce(F.array_join(F.transform("lines", lambda x: item(x, True)), ""), F.lit("")), "</feed>")
    body = F.when(c("o_orderkey") % 13 == 0, "<!DOCTYPE rss [<!ENTITY x 'y'>]><rss><channel/></rss>").when(c("o_orderkey") % 3 == 0, atom).otherwise(rss)
    found = feed_entries(whole.select(c("o_orderkey").alias("l_orderkey"), body.alias("xml")), "xml", ["l_orderkey"])
    return found.select("l_orderkey", "place", "format", "kept", "title", c("canonical_url").alias("url"), c("published_date").alias("published"), "summary", F.array_join("categories", ",").alias("categories"), F.array_join("reasons", ",").alias("reasons"))


@query("s20_ledger_scan", "SELECT n_nationkey AS id, n_nationkey % 6 <> 0 AS intact FROM nation")
def s20(spark, d):
    content = F.to_json(F.struct("n_nationkey", "n_name"))
    stored = table(spark, d, "nation").select("n_nationkey", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), c("n_nationkey").cast("int")), "yyyy-MM").alias("month"), F.when(c("n_nationkey") % 6 == 0, F.concat(content, F.lit(" "))).otherwise(content).alias("content"), F.sha2(content, 256).alias("digest"))
    folder = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    stored.write.partitionBy("month").json(folder)
    rows = spark.read.schema("n_nationkey long, content string, digest string").option("recursiveFileLookup", "true").json(folder)
    return rows.select(c("n_nationkey").alias("id"), (F.sha2("content", 256) == c("digest")).alias("intact"))
