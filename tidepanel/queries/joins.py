"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators import features as X
from tidepanel.queries.aggregates import predictions
from tidepanel.queries.features import r6
from tidepanel.queries.registry import query
from tidepanel.session import table
from tidepanel.sources import panel as P


@query("j3_exact_date_join", "SELECT p.date, p.code, p.close, m.close AS macro FROM prio p LEFT JOIN flags m ON m.date = p.date AND m.code = 'A'", "prio", "flags")
def j3(spark, d):
    macro = P.flag_panel(spark, d).filter("code = 'A'").select("date", F.col("close").alias("macro"))
    return P.priority_panel(spark, d).join(macro, "date", "left").select("date", "code", "close", "macro")


@query("j4_previous_value", "WITH m AS (SELECT date, lag(close) OVER (ORDER BY date) AS previous FROM flags WHERE code = 'A') SELECT p.date, p.code, previous FROM prio p LEFT JOIN m USING (date)", "prio", "flags")
def j4(spark, d):
    macro = P.flag_panel(spark, d).filter("code = 'A'").select("date", F.lag("close").over(X.series()).alias("previous"))
    return P.priority_panel(spark, d).join(macro, "date", "left").select("date", "code", "previous")


@query("j5_nth_earlier", "WITH m AS (SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS other20 FROM flags WHERE code = 'N') SELECT p.date, p.code, round(other20, 6) AS other20 FROM prio p LEFT JOIN m USING (date)", "prio", "flags")
def j5(spark, d):
    other = P.flag_panel(spark, d).filter("code = 'N'").select("date", X.change("close", 20).alias("other20"))
    return P.priority_panel(spark, d).join(other, "date", "left").select("date", "code", *r6("other20"))


@query("j6_common_session", "SELECT max(date) AS newest, count(*) AS common FROM (SELECT date FROM hourly GROUP BY date HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM hourly))", "hourly")
def j6(spark, d):
    panel = P.event_panel(spark, d)
    common = panel.groupBy("date").agg(F.countDistinct("code").alias("n")).filter(F.col("n") == X.universe_size(panel))
    return common.agg(F.max("date").alias("newest"), F.count("*").alias("common"))


@query("j7_common_dates", "SELECT date FROM panel GROUP BY date HAVING count(*) = (SELECT count(DISTINCT code) FROM panel) INTERSECT SELECT date FROM prio", "panel", "prio")
def j7(spark, d):
    panel = P.brand_panel(spark, d)
    whole = panel.groupBy("date").agg(F.count("*").alias("n")).filter(F.col("n") == X.universe_size(panel)).select("date")
    return whole.join(P.priority_panel(spark, d).select("date").distinct(), "date", "left_semi")


@query("j8_merge_newest_wins", "SELECT coalesce(n.date, o.date) AS date, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume FROM (SELECT * FROM flags WHERE code = 'A') o FULL JOIN (SELECT * FROM flags WHERE code = 'N') n ON n.date = o.date", "flags")
def j8(spark, d):
    flags = P.flag_panel(spark, d)
    old, new = flags.filter("code = 'A'").alias("o"), flags.filter("code = 'N'").alias("n")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return old.join(new, F.col("o.date") == F.col("n.date"), "full").select(pick("date"), pick("close"), pick("volume"))


@query(
    "j9_members_and_prices",
    "SELECT n_regionkey AS region, count(*) AS members, count(c_acctbal) FILTER (c_acctbal > 0) AS priced, round(avg((c_acctbal > 5000)::INT) FILTER (c_acctbal > 0), 6) AS above FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def j9(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    good = F.col("c_acctbal") > 0
    return rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("members"), F.count_if(good).alias("priced"), F.round(F.avg(F.when(good, (F.col("c_acctbal") > 5000).cast("int"))), 6).alias("above"))


@query(
    "j10_members_and_quotes",
    "WITH q AS (SELECT o_custkey, max(o_totalprice) AS quote FROM orders GROUP BY 1) SELECT c_mktsegment AS segment, count(*) AS members, count(quote) AS quoted, round(100.0 * count(quote) / count(*), 6) AS coverage, round(avg(quote), 4) AS mean FROM customer LEFT JOIN q ON c_custkey = o_custkey GROUP BY 1",
)
def j10(spark, d):
    quotes = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("quote"))
    rows = table(spark, d, "customer").join(quotes, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("members"), F.count("quote").alias("quoted"), F.round(100.0 * F.count("quote") / F.count("*"), 6).alias("coverage"), F.round(F.avg("quote"), 4).alias("mean"))


_EVAL = "ev AS (SELECT prediction_id, prediction_date + horizon AS evaluated, y, excess FROM pred WHERE status = 'published' AND horizon <> 20)"


def evaluations(spark, d):
    rows = predictions(spark, d).filter("status = 'published' and horizon <> 20")
    return rows.select("prediction_id", F.date_add("prediction_date", F.col("horizon")).alias("evaluated"), "y", "excess")


@query("j11_prediction_evaluation", f"WITH {_EVAL} SELECT prediction_id, status, evaluated, round(ev.excess, 6) AS realized FROM pred LEFT JOIN ev USING (prediction_id)", "pred")
def j11(spark, d):
    found = evaluations(spark, d).select("prediction_id", "evaluated", F.round("excess", 6).alias("realized"))
    return predictions(spark, d).select("prediction_id", "status").join(found, "prediction_id", "left")


@query("j12_unevaluated", f"WITH {_EVAL} SELECT prediction_id, status FROM pred ANTI JOIN ev USING (prediction_id)", "pred")
def j12(spark, d):
    return predictions(spark, d).select("prediction_id", "status").join(evaluations(spark, d).select("prediction_id"), "prediction_id", "left_anti")


@query(
    "j13_broken_references",
    "WITH e AS (SELECT event_id, user_id, ts, event_id - 7 AS supersedes FROM events WHERE event_id % 7 = 3), bad AS (SELECT e.event_id, CASE WHEN o.event_id IS NULL THEN 'missing' WHEN o.user_id <> e.user_id THEN 'other subject' WHEN o.ts >= e.ts THEN 'not earlier' END AS fault FROM e LEFT JOIN events o ON o.event_id = e.supersedes) SELECT * FROM bad WHERE fault IS NOT NULL",
)
def j13(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    own = events.filter("event_id % 7 = 3").withColumn("supersedes", F.col("event_id") - 7)
    old = events.select(F.col("event_id").alias("old_id"), F.col("user_id").alias("old_user"), F.col("ts").alias("old_ts"))
    fault = F.when(F.col("old_id").isNull(), "missing").when(F.col("old_user") != F.col("user_id"), "other subject").when(F.col("old_ts") >= F.col("ts"), "not earlier")
    return own.join(old, F.col("supersedes") == F.col("old_id"), "left").select("event_id", fault.alias("fault")).filter("fault is not null")


@query(
    "j14_pairwise_distance",
    "WITH v AS (SELECT code, list(close ORDER BY date) AS v FROM flags WHERE date IN (SELECT date FROM flags GROUP BY date HAVING count(*) = 3) GROUP BY code) SELECT a.code AS a, b.code AS b, round(list_distance(a.v, b.v), 4) AS distance, list_distance(a.v, b.v) <= 1e-12 AS duplicate FROM v a JOIN v b ON a.code < b.code",
    "flags",
)
def j14(spark, d):
    # Codes are a fixed small universe: pairs are of codes, not of rows.
    flags = P.flag_panel(spark, d).withColumn("n", F.count("*").over(X.cross())).filter("n = 3")
    v = flags.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("v"))
    square = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = v.select(F.col("code").alias("a"), "v").join(v.select(F.col("code").alias("b"), F.col("v").alias("w")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(F.sqrt(square), 4).alias("distance"), (F.sqrt(square) <= 1e-12).alias("duplicate"))


@query(
    "j15_panel_diff",
    """WITH l AS (SELECT * FROM flags WHERE code <> 'R'), r AS (SELECT date, code, CASE WHEN day(date) = 1 THEN close + 1 ELSE close END AS close, volume FROM flags WHERE code <> 'A'),
    j AS (SELECT l.close AS lc, r.close AS rc, l.code AS lk, r.code AS rk FROM l FULL JOIN r ON l.date = r.date AND l.code = r.code)
    SELECT CASE WHEN lk IS NULL THEN 'added' WHEN rk IS NULL THEN 'removed' WHEN lc <> rc THEN 'changed' ELSE 'same' END AS state, count(*) AS n, round(coalesce(max(abs(lc - rc)), 0), 6) AS most FROM j GROUP BY 1""",
    "flags",
)
def j15(spark, d):
    flags = P.flag_panel(spark, d).select("date", "code", "close")
    left = flags.filter("code <> 'R'").select("date", "code", F.col("close").alias("lc"), F.lit(True).alias("l"))
    right = flags.filter("code <> 'A'").select("date", "code", F.when(F.dayofmonth("date") == 1, F.col("close") + 1).otherwise(F.col("close")).alias("rc"), F.lit(True).alias("r"))
    state = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("lc") != F.col("rc"), "changed").otherwise("same")
    return left.join(right, ["date", "code"], "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.max(F.abs(F.col("lc") - F.col("rc"))), F.lit(0.0)), 6).alias("most"))


@query("j16_reconcile", "SELECT count(*) AS overlap, count(*) FILTER (abs(a.close - b.close) > 1e-7) AS mismatches, round(max(abs(a.close - b.close)), 6) AS most FROM flags a JOIN bench b USING (date) WHERE a.code = 'A'", "flags", "bench")
def j16(spark, d):
    other = P.benchmark(spark, d).select("date", F.col("close").alias("other"))
    gap = F.abs(F.col("close") - F.col("other"))
    return P.flag_panel(spark, d).filter("code = 'A'").join(other, "date").agg(F.count("*").alias("overlap"), F.count_if(gap > 1e-7).alias("mismatches"), F.round(F.max(gap), 6).alias("most"))


@query("j17_common_curves", "SELECT a.date, round(a.close - b.close, 6) AS spread FROM flags a JOIN flags b USING (date) WHERE a.code = 'A' AND b.code = 'N' QUALIFY date = max(date) OVER ()", "flags")
def j17(spark, d):
    flags = P.flag_panel(spark, d)
    real = flags.filter("code = 'N'").select("date", F.col("close").alias("real"))
    both = flags.filter("code = 'A'").join(real, "date")
    return both.orderBy(F.desc("date")).limit(1).select("date", F.round(F.col("close") - F.col("real"), 6).alias("spread"))


def shared_sources(rows):
    """Every pair of threads that share sources, with how many. The pairs grow with the square of a source's threads."""
    t = rows.distinct()
    other = t.select(F.col("thread").alias("b"), "source")
    return t.select(F.col("thread").alias("a"), "source").join(other, "source").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


_J18 = "WITH t AS (SELECT DISTINCT o_custkey AS thread, o_orderkey // 40 AS source FROM orders) SELECT a.thread AS a, b.thread AS b, count(*) AS shared FROM t a JOIN t b ON a.source = b.source AND a.thread < b.thread GROUP BY 1, 2"


@query("j18_shared_sources", _J18)
def j18(spark, d):
    # Sources of 40 orders: more orders make more sources, not larger ones.
    return shared_sources(table(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.expr("o_orderkey div 40").alias("source")))


@query("j19_scope_overlap", "WITH s AS (SELECT s_nationkey AS nation, list(DISTINCT s_suppkey % 5) AS scope FROM supplier GROUP BY 1) SELECT c_custkey AS target, nation FROM customer JOIN s ON nation = c_nationkey WHERE list_has_any(scope, [c_custkey % 5])")
def j19(spark, d):
    scopes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_set(F.col("s_suppkey") % 5).alias("scope"))
    rows = table(spark, d, "customer").join(scopes, F.col("c_nationkey") == F.col("nation"))
    return rows.filter(F.arrays_overlap("scope", F.array(F.col("c_custkey") % 5))).select(F.col("c_custkey").alias("target"), "nation")


@query(
    "j20_canonical_publisher",
    "WITH c AS (SELECT text, min(doc_id) AS canonical FROM documents GROUP BY text HAVING count(*) > 1) SELECT d.doc_id, coalesce(k.source, d.source) AS publisher FROM documents d LEFT JOIN c USING (text) LEFT JOIN documents k ON k.doc_id = c.canonical",
)
def j20(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    # Documents of a cluster meet under their hash, so a hot cluster never gathers texts.
    first = Window.partitionBy("hash").orderBy("doc_id")
    return docs.select("doc_id", F.first("source").over(first).alias("publisher"))
