"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators import aggregates as A
from tidepanel.operators import features as X
from tidepanel.operators import ledger as G
from tidepanel.queries.features import features, labels, r6, scored
from tidepanel.queries.registry import NEEDS, VIEWS, query
from tidepanel.session import table
from tidepanel.sources import panel as P

VIEWS["pred"] = """SELECT CAST(date AS VARCHAR) || '|' || code || '|' || horizon AS prediction_id, date AS prediction_date, code, horizon,
    CASE WHEN abs(p - 0.5) < 0.02 THEN 'abstained' WHEN year(date) < 1997 THEN 'legacy' ELSE 'published' END AS status, 'm' || (month(date) % 3) AS model, p, y, excess, score FROM scored"""
NEEDS["pred"] = ["scored"]
VIEWS["outc"] = """SELECT *, CASE WHEN status <> 'published' THEN status WHEN y IS NULL THEN 'pending' WHEN abs(p - 0.5) < 0.01 THEN 'near_neutral' WHEN (p - 0.5 > 0) = (y = 1) THEN 'correct' ELSE 'wrong' END AS outcome FROM pred"""
NEEDS["outc"] = ["pred"]


def predictions(spark, d):
    return G.predictions(scored(spark, d))


def outcomes(spark, d):
    return predictions(spark, d).withColumn("outcome", G.outcome(F.col("p"), F.col("y"), F.col("status")))


@query("a1_maturity", "SELECT horizon, count(DISTINCT date) AS dates, count(*) AS rows, min(target_date) AS first_target, max(target_date) AS last_target, round(avg(outperformed), 6) AS positive_rate FROM lab GROUP BY 1", "lab")
def a1(spark, d):
    return labels(spark, d).groupBy("horizon").agg(F.countDistinct("date").alias("dates"), F.count("*").alias("rows"), F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target"), F.round(F.avg("outperformed"), 6).alias("positive_rate"))


@query(
    "a2_label_diagnostics",
    "WITH x AS (SELECT date, horizon, count(*) AS n, sum(absolute_up) AS up, sum(top_quartile) AS top FROM lab GROUP BY 1, 2) SELECT horizon, min(n) AS least, max(n) AS most, round(sum(up) / sum(n), 6) AS up_rate, round(sum(top) / sum(n), 6) AS top_rate FROM x GROUP BY 1",
    "lab",
)
def a2(spark, d):
    each = labels(spark, d).groupBy("date", "horizon").agg(F.count("*").alias("n"), F.sum("absolute_up").alias("up"), F.sum("top_quartile").alias("top"))
    return each.groupBy("horizon").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.sum("up") / F.sum("n"), 6).alias("up_rate"), F.round(F.sum("top") / F.sum("n"), 6).alias("top_rate"))


_BREADTH = """fl AS (SELECT date, code, close > lag(close) OVER s AS advance, close > lag(close, 5) OVER s AS positive5, close > avg(close) OVER (s ROWS 19 PRECEDING) AS above20, count(*) OVER (s ROWS 19 PRECEDING) AS n FROM panel WINDOW s AS (PARTITION BY code ORDER BY date)),
br AS (SELECT date, avg(advance::INT) AS advance, avg(positive5::INT) AS positive5, avg(above20::INT) AS above20, count(*) AS covered, CASE WHEN count(*) = (SELECT count(DISTINCT code) FROM panel) THEN 'complete' ELSE 'partial' END AS status FROM fl WHERE n = 20 GROUP BY date)"""


def breadth(spark, d):
    panel = P.brand_panel(spark, d)
    flags = panel.select("date", "code", (F.col("close") > F.lag("close").over(X.series())).alias("advance"), (F.col("close") > F.lag("close", 5).over(X.series())).alias("positive5"), (F.col("close") > X.complete_mean("close", -19, 0)).alias("above20"))
    return A.breadth(flags.filter("above20 is not null"), ["date"], ["advance", "positive5", "above20"], X.universe_size(panel))


@query("a3_breadth", f"WITH {_BREADTH} SELECT date, round(advance, 6) AS advance, round(positive5, 6) AS positive5, round(above20, 6) AS above20, covered, status FROM br", "panel")
def a3(spark, d):
    return breadth(spark, d).select("date", *r6("advance", "positive5", "above20"), "covered", "status")


@query("a4_breadth_rollup", f"WITH {_BREADTH} SELECT round(avg(advance), 6) AS advance, count(*) AS dates, bool_and(status = 'complete') AS all_complete, bool_or(status = 'complete') AS any_complete FROM br", "panel")
def a4(spark, d):
    return breadth(spark, d).agg(F.round(F.avg("advance"), 6).alias("advance"), F.count("*").alias("dates"), F.bool_and(F.col("status") == "complete").alias("all_complete"), F.bool_or(F.col("status") == "complete").alias("any_complete"))


@query("a5_concentration", "SELECT date, round(sum(amount) FILTER (t <= 3) / sum(amount), 6) AS concentration, count(*) AS members FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS t FROM panel) GROUP BY date", "panel")
def a5(spark, d):
    return A.top_share(P.brand_panel(spark, d), ["date"], "amount", "code").select("date", *r6("concentration"), "members")


@query("a6_date_histogram", "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, date LIMIT 4")
def a6(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "date").limit(4)


@query("a7_panel_statistics", "SELECT code, count(*) AS rows, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY ROLLUP (code)", "panel")
def a7(spark, d):
    return P.brand_panel(spark, d).rollup("code").agg(F.count("*").alias("rows"), F.countDistinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("a8_ledger_index", "SELECT status, horizon, model, count(*) AS n FROM pred GROUP BY GROUPING SETS ((status), (horizon), (model))", "pred")
def a8(spark, d):
    p = predictions(spark, d).select("status", "horizon", "model")
    return p.groupingSets([["status"], ["horizon"], ["model"]], "status", "horizon", "model").agg(F.count("*").alias("n"))


@query("a9_shard_summary", "SELECT strftime(prediction_date, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (status = 'published') AS published, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM pred GROUP BY 1", "pred")
def a9(spark, d):
    return predictions(spark, d).groupBy(F.date_format("prediction_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "published").alias("published"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


@query("a10_weekly_review", "SELECT prediction_date AS week, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'near_neutral') AS neutral, count(*) FILTER (outcome = 'abstained') AS abstained, count(*) FILTER (outcome = 'legacy') AS legacy, count(*) AS n FROM outc GROUP BY 1", "outc")
def a10(spark, d):
    o = F.col("outcome")
    kinds = [("correct", "correct"), ("wrong", "wrong"), ("neutral", "near_neutral"), ("abstained", "abstained"), ("legacy", "legacy")]
    return outcomes(spark, d).groupBy(F.col("prediction_date").alias("week")).agg(*[F.count_if(o == v).alias(n) for n, v in kinds], F.count("*").alias("n"))


@query(
    "a11_slices_with_empty_groups",
    "WITH k AS (SELECT DISTINCT status, horizon, model, year(prediction_date) AS y4, code, outcome FROM outc), m AS (SELECT status, horizon, model, year(prediction_date) AS y4, code, outcome, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM outc WHERE status = 'published' GROUP BY ALL) SELECT k.*, coalesce(n, 0) AS n, round(brier, 6) AS brier FROM k LEFT JOIN m USING (status, horizon, model, y4, code, outcome)",
    "outc",
)
def a11(spark, d):
    keys = ["status", "horizon", "model", "y4", "code", "outcome"]
    rows = outcomes(spark, d).withColumn("y4", F.year("prediction_date"))
    measured = rows.filter("status = 'published'").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return rows.select(*keys).distinct().join(measured, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), *r6("brier"))


@query("a12_grouping_sets", "SELECT horizon, model, count(*) AS n, round(avg(y), 6) AS rate FROM pred GROUP BY GROUPING SETS ((horizon), (model))", "pred")
def a12(spark, d):
    return predictions(spark, d).groupingSets([["horizon"], ["model"]], "horizon", "model").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))


_REASONS = "list_filter([CASE WHEN abs(p - 0.5) < 0.02 THEN 'weak' END, CASE WHEN horizon = 20 THEN 'long' END, CASE WHEN abs(score) > 2 THEN 'extreme' END], lambda x: x IS NOT NULL)"


@query("a13_abstain_reasons", f"SELECT reason, count(*) AS n FROM (SELECT unnest({_REASONS}) AS reason FROM pred) GROUP BY 1", "pred")
def a13(spark, d):
    reasons = F.array_compact(F.array(F.when(F.abs(F.col("p") - 0.5) < 0.02, "weak"), F.when(F.col("horizon") == 20, "long"), F.when(F.abs("score") > 2, "extreme")))
    return predictions(spark, d).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_F = ["momentum5", "momentum20", "momentum60", "volatility20", "drawdown60", "amount_ratio"]


@query("a14_null_rates", "SELECT feature, count(*) AS rows, round(avg((value IS NULL)::INT), 6) AS null_rate, max(value) - min(value) <= 1e-15 AS constant FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM feat" for c in _F) + ") GROUP BY 1", "feat")
def a14(spark, d):
    return A.null_rates(features(spark, d), _F).select("feature", "rows", *r6("null_rate"), "constant")


@query("a15_completeness", "SELECT " + ", ".join(f"round(count({c}) / count(*), 6) AS {c}" for c in _F) + " FROM feat", "feat")
def a15(spark, d):
    return features(spark, d).agg(*[F.round(F.count(c) / F.count("*"), 6).alias(c) for c in _F])


@query("a16_duplicate_vectors", "SELECT o_orderdate AS date, o_orderstatus AS status, count(*) AS n, array_to_string(list_sort(list(o_orderkey)), ',') AS keys FROM orders GROUP BY 1, 2, o_orderpriority HAVING count(*) > 1")
def a16(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"), "o_orderpriority").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("keys")).filter("n > 1").drop("o_orderpriority")


_VECTOR = ["momentum5", "momentum20", "volatility20"]


@query(
    "a16_feature_vectors",
    "WITH u AS (SELECT date, code, momentum5, momentum20, volatility20 FROM rows_ UNION ALL SELECT date, code || 'x', momentum5, momentum20, volatility20 FROM rows_ WHERE code < 'Brand#2') SELECT date, count(*) AS n, min(code) AS first, max(code) AS last FROM u GROUP BY date, momentum5, momentum20, volatility20 HAVING count(*) > 1",
    "rows_",
)
def a16_vectors(spark, d):
    rows = X.feature_rows(P.brand_panel(spark, d)).select("date", "code", *_VECTOR)
    twins = rows.filter("code < 'Brand#2'").withColumn("code", F.concat("code", F.lit("x")))
    return A.duplicate_vectors(rows.unionByName(twins), ["date"], _VECTOR, "code")


@query("a16_constant_features", "SELECT unnest(['momentum5', 'flat', 'never']) AS feature, unnest([max(momentum5) - min(momentum5) <= 1e-15, true, true]) AS constant FROM rows_ HAVING count(*) > 0", "rows_")
def a16_constants(spark, d):
    rows = X.feature_rows(P.brand_panel(spark, d)).withColumn("flat", F.lit(0.5)).withColumn("never", F.lit(None).cast("double"))
    some = rows.agg(F.count("*").alias("n")).filter("n > 0")
    return A.constant_features(rows, ["momentum5", "flat", "never"]).withColumn("k", F.lit(1)).join(some.select(F.lit(1).alias("k")), "k").drop("k")


@query("a17_class_balance", "SELECT horizon, target, sum(v) AS positives, count(*) AS n FROM (SELECT horizon, unnest(['absolute_up', 'outperformed', 'top_quartile']) AS target, unnest([absolute_up, outperformed, top_quartile]) AS v FROM lab) GROUP BY 1, 2", "lab")
def a17(spark, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("v")) for c in ("absolute_up", "outperformed", "top_quartile")])).alias("s")
    return labels(spark, d).select("horizon", pairs).groupBy("horizon", "s.target").agg(F.sum("s.v").alias("positives"), F.count("*").alias("n"))


@query("a18_running_statistics", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1")
def a18(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))


@query("a19_cross_section_moments", "SELECT date, count(*) AS n, round(avg(momentum5), 6) AS mean, round(stddev_pop(momentum5), 6) AS deviation FROM rows_ GROUP BY 1", "rows_")
def a19(spark, d):
    return X.feature_rows(P.brand_panel(spark, d)).groupBy("date").agg(F.count("*").alias("n"), F.round(F.avg("momentum5"), 6).alias("mean"), F.round(F.stddev_pop("momentum5"), 6).alias("deviation"))


_GROUPS = [("trend", "momentum20", 0.3), ("long", "momentum60", 0.25), ("risk", "volatility20", 0.2), ("volume", "volume_ratio", 0.15), ("amount", "amount_ratio", 0.1)]


@query("a20_weighted_coverage", "SELECT code, round(" + " + ".join(f"{w} * count({c}) / count(*)" for _, c, w in _GROUPS) + ", 6) AS coverage FROM feat GROUP BY code", "feat")
def a20(spark, d):
    covered = features(spark, d).groupBy("code").agg(*[(F.count(c) / F.count("*")).alias(g) for g, c, _ in _GROUPS])
    weights = spark.createDataFrame([(g, w) for g, _, w in _GROUPS], "grp string, weight double")
    long = covered.select("code", F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("held")) for g, _, _ in _GROUPS])).alias("s")).select("code", "s.*")
    return long.join(F.broadcast(weights), "grp").groupBy("code").agg(F.round(F.sum(F.col("weight") * F.col("held")), 6).alias("coverage"))


@query(
    "a21_multi_valued_coverage",
    "SELECT topic, lang, count(*) AS documents, CASE WHEN count(*) >= 20 THEN 'covered' ELSE 'thin' END AS status FROM (SELECT lang, unnest(list_distinct([source, 'len' || length(CAST(n_chars AS VARCHAR))])) AS topic FROM documents) GROUP BY 1, 2",
)
def a21(spark, d):
    topics = F.explode(F.array_distinct(F.array("source", F.concat(F.lit("len"), F.length(F.col("n_chars").cast("string")).cast("string"))))).alias("topic")
    return table(spark, d, "documents").select("lang", topics).groupBy("topic", "lang").agg(F.count("*").alias("documents"), F.when(F.count("*") >= 20, "covered").otherwise("thin").alias("status"))


@query("a22_horizon_review", "SELECT horizon, count(*) AS n, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'abstained') AS abstained, round(avg((p - y) * (p - y)) FILTER (status = 'published'), 6) AS brier FROM pred GROUP BY 1", "pred")
def a22(spark, d):
    on = F.col("status") == "published"
    return predictions(spark, d).groupBy("horizon").agg(F.count("*").alias("n"), F.count_if(on).alias("published"), F.count_if(F.col("status") == "abstained").alias("abstained"), F.round(F.avg(F.when(on, F.pow(F.col("p") - F.col("y"), 2))), 6).alias("brier"))


@query("a23_last_sessions", "WITH l AS (SELECT DISTINCT date FROM hourly ORDER BY date DESC LIMIT 5) SELECT code, count(*) AS days, count(*) FILTER (volume >= 3) AS verified, array_to_string(list(strftime(date, '%d %H') ORDER BY date), ',') AS sessions FROM hourly SEMI JOIN l USING (date) GROUP BY 1", "hourly")
def a23(spark, d):
    panel = P.event_panel(spark, d)
    last = panel.select("date").distinct().orderBy(F.desc("date")).limit(5)
    return panel.join(F.broadcast(last), "date", "left_semi").groupBy("code").agg(F.count("*").alias("days"), F.count_if(F.col("volume") >= 3).alias("verified"), F.array_join(F.transform(F.array_sort(F.collect_list("date")), lambda t: F.date_format(t, "dd HH")), ",").alias("sessions"))


@query("a24_sector_concentration", "WITH t AS (SELECT code FROM scored WHERE horizon = 5 QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(score, 10) DESC, code) <= 3), c AS (SELECT code, count(*) AS n FROM t GROUP BY 1) SELECT round(max(n) / sum(n), 6) AS share FROM c", "scored")
def a24(spark, d):
    turn = F.row_number().over(X.cross().orderBy(F.desc(F.round("score", 10)), "code"))
    counts = scored(spark, d).filter("horizon = 5").withColumn("t", turn).filter("t <= 3").groupBy("code").agg(F.count("*").alias("n"))
    return counts.agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("a25_gate_summary", "SELECT horizon, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'legacy') AS legacy FROM pred GROUP BY 1", "pred")
def a25(spark, d):
    wide = predictions(spark, d).groupBy("horizon").pivot("status", ["published", "abstained", "legacy"]).count()
    return wide.na.fill(0)


@query("a26_field_coverage", "SELECT date, count(momentum60) || '/' || (SELECT count(DISTINCT code) FROM panel) AS momentum60, count(amount_ratio) || '/' || (SELECT count(DISTINCT code) FROM panel) AS amount_ratio FROM feat GROUP BY date", "feat", "panel")
def a26(spark, d):
    n = X.universe_size(P.brand_panel(spark, d))
    show = lambda c: F.concat_ws("/", F.count(c).cast("string"), F.lit(str(n))).alias(c)
    return features(spark, d).groupBy("date").agg(show("momentum60"), show("amount_ratio"))


@query("a27_weight_sums", "WITH w AS (SELECT date, code, 100 * amount / sum(amount) OVER (PARTITION BY date) AS weight FROM prio), s AS (SELECT date, sum(weight) AS total FROM w GROUP BY 1 HAVING sum(weight) BETWEEN 99 AND 101) SELECT date, code, round(weight, 6) AS weight, row_number() OVER (PARTITION BY date ORDER BY round(weight, 9) DESC, code) AS place FROM w SEMI JOIN s USING (date)", "prio")
def a27(spark, d):
    weights = P.priority_panel(spark, d).select("date", "code", (100 * F.col("amount") / F.sum("amount").over(X.cross())).alias("weight"))
    weights = weights.withColumn("total", F.sum("weight").over(X.cross())).filter(F.col("total").between(99, 101))
    return weights.select("date", "code", *r6("weight"), F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round("weight", 9)), "code")).alias("place"))
