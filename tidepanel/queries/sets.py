"""Set operation, sort and top-k queries (U1 to U10, T1 to T10), sources, sinks and retention (S, K)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.operators import features as X
from tidepanel.operators import ledger as G
from tidepanel.queries.aggregates import predictions
from tidepanel.queries.features import scored, z_scores
from tidepanel.queries.registry import query
from tidepanel.session import shared_dir, table
from tidepanel.sources import panel as P

c = F.col


def halves(spark, d):
    """Two overlapping snapshots of predictions; the second one disagrees on some."""
    p = predictions(spark, d).select("prediction_id", "code", "horizon", "status", F.round("p", 6).alias("p"))
    first = p.filter("horizon <> 20")
    second = p.filter("horizon <> 1").withColumn("p", F.when((c("horizon") == 5) & (c("code") == "Brand#11"), c("p") + 1).otherwise(c("p")))
    return first, second


_HALVES = "s1 AS (SELECT prediction_id, code, horizon, status, round(p, 6) AS p FROM pred WHERE horizon <> 20), s2 AS (SELECT prediction_id, code, horizon, status, CASE WHEN horizon = 5 AND code = 'Brand#11' THEN round(p, 6) + 1 ELSE round(p, 6) END AS p FROM pred WHERE horizon <> 1)"


@query("u1_union_without_conflicts", f"WITH {_HALVES}, u AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2) SELECT prediction_id, count(DISTINCT p) > 1 AS conflict FROM u GROUP BY 1", "pred")
def u1(spark, d):
    rows, conflicts = G.union_of_snapshots(list(halves(spark, d)), "prediction_id", ["code", "horizon", "status", "p"])
    return rows.select("prediction_id").join(conflicts, "prediction_id", "left").select("prediction_id", c("contents").isNotNull().alias("conflict"))


@query("u2_append_new", f"WITH {_HALVES} SELECT prediction_id, p FROM s1 UNION ALL SELECT prediction_id, p FROM s2 ANTI JOIN s1 USING (prediction_id)", "pred")
def u2(spark, d):
    first, second = halves(spark, d)
    return G.appended(first, second, "prediction_id").select("prediction_id", "p")


@query("u4_difference", f"WITH {_HALVES} SELECT prediction_id FROM s1 EXCEPT SELECT prediction_id FROM s2", "pred")
def u4(spark, d):
    first, second = halves(spark, d)
    return first.select("prediction_id").subtract(second.select("prediction_id"))


@query("u5_side_diff", f"WITH {_HALVES} SELECT CASE WHEN a.p IS NULL THEN 'right' WHEN b.p IS NULL THEN 'left' WHEN a.p <> b.p THEN 'different' ELSE 'same' END AS side, count(*) AS n FROM s1 a FULL JOIN s2 b USING (prediction_id) GROUP BY 1", "pred")
def u5(spark, d):
    first, second = halves(spark, d)
    both = first.select("prediction_id", c("p").alias("a")).join(second.select("prediction_id", c("p").alias("b")), "prediction_id", "full")
    return both.groupBy(F.when(c("a").isNull(), "right").when(c("b").isNull(), "left").when(c("a") != c("b"), "different").otherwise("same").alias("side")).agg(F.count("*").alias("n"))


@query("u6_intersection", "SELECT date FROM flags WHERE code = 'A' INTERSECT SELECT date FROM flags WHERE code = 'N' INTERSECT SELECT date FROM prio", "flags", "prio")
def u6(spark, d):
    flags = P.flag_panel(spark, d)
    dates = lambda k: flags.filter(c("code") == k).select("date")
    return dates("A").intersect(dates("N")).intersect(P.priority_panel(spark, d).select("date"))


@query("u7_upsert", "WITH u AS (SELECT user_id, ts, event_id, 0 AS new FROM events WHERE event_type <> 'purchase' UNION ALL SELECT user_id, ts, -event_id, 1 FROM events WHERE event_id % 2 = 0) SELECT user_id, event_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, new DESC, event_id) = 1")
def u7(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    old = G.latest_events(e.filter("event_type <> 'purchase'"), "user_id", "ts", "event_id").select("user_id", "ts", "event_id")
    new = G.latest_events(e.filter("event_id % 2 = 0"), "user_id", "ts", "event_id").select("user_id", "ts", (-c("event_id")).alias("event_id"))
    return G.upserted(old, new, "user_id", "ts").select("user_id", "event_id")


def new_and_reused(orders):
    """Per edition: how many of its customers the edition before it lacks, and how many it has. No set is gathered."""
    members = orders.select(c("o_orderpriority").alias("edition"), c("o_custkey").alias("k")).distinct()
    # One row per edition is left for the window.
    editions = members.select("edition").distinct().withColumn("before", F.lag("edition").over(Window.orderBy("edition")))
    earlier = members.select(c("edition").alias("before"), "k", F.lit(1).alias("old"))
    met = members.filter("k is not null").join(F.broadcast(editions), "edition").join(earlier, ["before", "k"], "left")
    counts = met.groupBy("edition").agg(F.count("*").alias("n"), F.count("old").alias("reused"))
    some = lambda x: F.when(c("before").isNotNull(), F.coalesce(x, F.lit(0)))
    return editions.join(counts, "edition", "left").select("edition", some(c("n") - c("reused")).alias("fresh"), some(c("reused")).alias("reused"))


_U8 = (
    "WITH e AS (SELECT DISTINCT o_orderpriority AS edition, o_custkey AS k FROM orders), p AS (SELECT edition, lag(edition) OVER (ORDER BY edition) AS b FROM (SELECT DISTINCT edition FROM e)) SELECT e.edition, CASE WHEN b IS NOT NULL THEN count(*) - count(f.k) END AS fresh, CASE WHEN b IS NOT NULL THEN count(f.k) END AS reused FROM e JOIN p USING (edition) LEFT JOIN e f ON f.edition = p.b AND f.k = e.k GROUP BY e.edition, b"
)


@query("u8_new_and_reused", _U8)
def u8(spark, d):
    return new_and_reused(table(spark, d, "orders"))


@query("u9_last_of_day", "SELECT CAST(ts AS DATE) AS date, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def u9(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("u10_flattened_sections", "SELECT conv_id, role AS section, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, role, text FROM conversations WHERE role = 'assistant'")
def u10(spark, d):
    rows = table(spark, d, "conversations")
    nested = rows.groupBy("conv_id").agg(*[F.collect_list(F.when(c("role") == r, c("text"))).alias(r) for r in ("user", "assistant")])
    part = lambda r: nested.select("conv_id", F.lit(r).alias("section"), F.explode(r).alias("text"))
    return part("user").unionByName(part("assistant"))


@query("t2_both_tails", "WITH t AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY close DESC, date) AS a, row_number() OVER (PARTITION BY code ORDER BY close, date DESC) AS b FROM panel) SELECT code, date, close FROM t WHERE a <= 3 OR b <= 3", "panel")
def t2(spark, d):
    w = Window.partitionBy("code")
    a, b = F.row_number().over(w.orderBy(F.desc("close"), "date")), F.row_number().over(w.orderBy("close", F.desc("date")))
    return P.brand_panel(spark, d).withColumn("a", a).withColumn("b", b).filter("a <= 3 or b <= 3").select("code", "date", "close")


@query(
    "t3_leaders",
    """WITH b AS (SELECT p.*, p.amount / b.amount AS share, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS turn FROM panel p JOIN bench b USING (date)),
    m AS (SELECT code, avg(amount) FILTER (turn <= 5) / avg(amount) FILTER (turn BETWEEN 6 AND 25) * avg(volume) FILTER (turn <= 5) / avg(volume) FILTER (turn BETWEEN 6 AND 25)
      * avg(share) FILTER (turn <= 5) / avg(share) FILTER (turn BETWEEN 6 AND 25) AS product FROM b WHERE turn <= 25 GROUP BY code)
    SELECT code, round(product, 6) AS product FROM m WHERE product IS NOT NULL ORDER BY round(product, 9) DESC, code LIMIT 8""",
    "panel", "bench",
)
def t3(spark, d):
    return X.leaders(X.history_metrics(P.brand_panel(spark, d), P.benchmark(spark, d)), 8).select("code", F.round("product", 6).alias("product"))


@query("t4_ranked_predictions", "SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY round(p, 9) DESC, round(momentum20, 9) DESC, code) AS place FROM scored WHERE horizon = 5", "scored")
def t4(spark, d):
    place = F.row_number().over(X.cross().orderBy(F.desc(F.round("p", 9)), F.desc(F.round("momentum20", 9)), "code"))
    return scored(spark, d).filter("horizon = 5").select("date", "code", place.alias("place"))


@query("t5_top_and_bottom", "WITH r AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY round(z_momentum20, 9) DESC, code) AS rank, count(*) OVER (PARTITION BY date) AS n FROM zs) SELECT date, code, rank FROM r WHERE rank <= 3 OR rank > n - 2", "zs")
def t5(spark, d):
    rank = F.row_number().over(X.cross().orderBy(F.desc(F.round("z_momentum20", 9)), "code"))
    return z_scores(spark, d).withColumn("rank", rank).withColumn("n", F.count("*").over(X.cross())).filter("rank <= 3 or rank > n - 2").select("date", "code", "rank")


@query("t6_history_page", "SELECT prediction_id, code, prediction_date FROM pred WHERE horizon = 5 ORDER BY prediction_date DESC, code LIMIT 60 OFFSET 60", "pred")
def t6(spark, d):
    return predictions(spark, d).filter("horizon = 5").orderBy(F.desc("prediction_date"), "code").offset(60).limit(60).select("prediction_id", "code", "prediction_date")


@query("t7_largest_errors", "SELECT prediction_id, round(excess, 6) AS excess FROM pred WHERE status = 'published' ORDER BY round(abs(excess), 9) DESC, prediction_id LIMIT 10", "pred")
def t7(spark, d):
    return predictions(spark, d).filter("status = 'published'").orderBy(F.desc(F.round(F.abs("excess"), 9)), "prediction_id").limit(10).select("prediction_id", F.round("excess", 6).alias("excess"))


@query("t9_document_order", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars % 97 END NULLS LAST, doc_id % 2 DESC, doc_id) AS place FROM documents")
def t9(spark, d):
    published = F.when(c("doc_id") % 5 != 0, c("n_chars") % 97)
    docs = table(spark, d, "documents").select("doc_id", published.alias("day"), (c("doc_id") % 2).alias("precise"))
    return G.placed(docs, [F.asc_nulls_last("day"), F.desc("precise"), c("doc_id").asc()], "place").select("doc_id", "place")


def _written(df, spark, *by: str, mode: str = "errorifexists"):
    folder = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).mode(mode).parquet(folder)
    return folder


@query("k1_sorted_sink", "SELECT date, code, close FROM panel", "panel")
def k1(spark, d):
    rows = P.brand_panel(spark, d).select("date", "code", "close")
    return spark.read.schema(rows.schema).parquet(_written(rows.orderBy("date", "code"), spark))


@query("k2_text_sink", "SELECT strftime(date, '%Y-%m-%d') AS date, code, CASE WHEN ret IS NULL THEN '' WHEN round(ret, 6) = 0 THEN '0' ELSE printf('%.12g', round(ret, 6)) END AS ret, printf('%.12g', amount * 1e6) AS amount FROM raw", "raw")
def k2(spark, d):
    """A sink of text columns; an empty field is a missing number."""
    rows = P.brand_panel(spark, d).select(c("date").cast("string").alias("date"), "code", S.general_text(F.round(X.change("close", 1), 6)).alias("ret"), S.general_text(c("amount") * 1e6).alias("amount"))
    folder = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    rows.write.option("header", "true").option("emptyValue", "").csv(folder)
    back = spark.read.schema(rows.schema).option("header", "true").csv(folder)
    return back.select("date", "code", F.coalesce("ret", F.lit("")).alias("ret"), "amount")


@query("k3_write_once", "SELECT r_regionkey, r_name FROM region")
def k3(spark, d):
    """A second write to the same folder is refused, and what the first one wrote stays."""
    from pyspark.errors import AnalysisException

    rows = table(spark, d, "region").select("r_regionkey", "r_name")
    folder = _written(rows, spark)
    try:
        rows.withColumn("r_name", F.lit("changed")).write.mode("errorifexists").parquet(folder)
    except AnalysisException:
        pass
    return spark.read.schema(rows.schema).parquet(folder)


@query(
    "k5_immutable_append",
    f"WITH {_HALVES} SELECT prediction_id, a.p, coalesce(a.p <> b.p, false) AS conflict FROM s1 a LEFT JOIN s2 b USING (prediction_id) UNION ALL SELECT prediction_id, p, false FROM s2 ANTI JOIN s1 USING (prediction_id)",
    "pred",
)
def k5(spark, d):
    first, second = (x.select("prediction_id", "p") for x in halves(spark, d))
    folder = _written(first, spark)
    fresh, conflicts = G.immutable_append(spark.read.schema(first.schema).parquet(folder), second, "prediction_id")
    fresh.write.mode("append").parquet(folder)
    stored = spark.read.schema(first.schema).parquet(folder)
    return stored.join(conflicts.withColumn("c", F.lit(True)), "prediction_id", "left").select("prediction_id", "p", F.coalesce("c", F.lit(False)).alias("conflict"))


@query("k6_monthly_shards", "SELECT strftime(prediction_date, '%Y-%m') AS month, count(*) AS n FROM pred GROUP BY 1", "pred")
def k6(spark, d):
    rows = predictions(spark, d).withColumn("month", F.date_format("prediction_date", "yyyy-MM"))
    return spark.read.schema(rows.schema).parquet(_written(rows.repartition("month"), spark, "month")).groupBy("month").agg(F.count("*").alias("n")).withColumn("month", c("month").cast("string"))


@query("k7_retention", "WITH r AS (SELECT doc_id, source, row_number() OVER w AS t, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC)) SELECT doc_id, source FROM r WHERE t <= 40 AND b <= 60000")
def k7(spark, d):
    return G.kept_by_bytes(table(spark, d, "documents"), [F.desc("doc_id")], "n_chars", 40, 60_000, within="source").select("doc_id", "source")


@query(
    "k8_oldest_tenth",
    "WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, bool_and(event_type <> 'error') AS done FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS t, count(*) OVER (PARTITION BY user_id) AS k FROM b) SELECT user_id, day, n FROM r WHERE NOT (done AND t <= ceil(k * 0.1))",
)
def k8(spark, d):
    batches = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.bool_and(c("event_type") != "error").alias("done"))
    return G.pruned(batches, "user_id", "day", c("done"), 0.1).select("user_id", "day", "n")


@query(
    "k9_bar_documents",
    """SELECT code, CAST(year(date) AS INTEGER) AS year, count(*) AS bars, min(date) AS first_date, max(date) AS last_date, '[' || string_agg('{"time":"' || date || '","close":' || CAST(close AS DECIMAL(18, 4)) || ',"volume":' || CAST(volume AS DECIMAL(18, 1)) || '}', ',' ORDER BY date) || ']' AS document
    FROM (SELECT code, date, round(close, 4) AS close, round(volume, 1) AS volume FROM flags) GROUP BY 1, 2""",
    "flags",
)
def k9(spark, d):
    """The documents of bars with their index: one for each code and year, so that none grows with a code's history."""
    shown = F.concat(F.lit('{"time":"'), c("date").cast("string"), F.lit('","close":'), F.round("close", 4).cast("decimal(18,4)").cast("string"), F.lit(',"volume":'), F.round("volume", 1).cast("decimal(18,1)").cast("string"), F.lit("}"))
    bars = F.array_sort(F.collect_list(F.struct("date", shown.alias("bar"))))
    each = P.flag_panel(spark, d).groupBy("code", F.year("date").alias("year")).agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), bars.alias("b"))
    return each.select("code", "year", "bars", "first_date", "last_date", F.concat(F.lit("["), F.array_join(F.transform("b", lambda x: x["bar"]), ","), F.lit("]")).alias("document"))


@query("s1_scan_positive", "SELECT date, code, close FROM hourly WHERE close > 0", "hourly")
def s1(spark, d):
    from tidepanel.sources import formats

    rows = P.event_panel(spark, d).select("date", "code", "close")
    folder = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    rows.write.option("compression", "gzip").csv(folder, header=True)
    return formats.read_bars(spark, folder, "date timestamp, code string, close double")


@query("s2_scan_until", "SELECT date, code, close FROM panel WHERE date <= DATE '1999-01-04'", "panel")
def s2(spark, d):
    return P.brand_panel(spark, d).filter(c("date") <= F.lit("1999-01-04").cast("date")).select("date", "code", "close")


@query("s3_outside_universe", "SELECT DISTINCT code FROM panel WHERE code NOT IN ('Brand#11', 'Brand#12', 'Brand#13')", "panel")
def s3(spark, d):
    return P.brand_panel(spark, d).filter(~c("code").isin("Brand#11", "Brand#12", "Brand#13")).select("code").distinct()


@query("s6_aliases", "SELECT event_id, value FROM events")
def s6(spark, d):
    from tidepanel.sources import formats

    e = table(spark, d, "events").select("event_id", F.when(c("event_id") % 2 == 0, c("value")).alias("Close"), F.when(c("event_id") % 2 == 1, c("value")).alias("settle"))
    return e.select("event_id", formats.first_alias(e, ["close", "last", "SETTLE"]).alias("value"))


@query("s7_wrapped_rows", "SELECT user_id, event_id, value FROM events")
def s7(spark, d):
    from tidepanel.sources import formats

    inner = F.to_json(F.create_map(F.when(c("user_id") % 2 == 0, "rows").otherwise("data"), F.collect_list(F.struct("event_id", "value"))))
    wrapped = table(spark, d, "events").groupBy("user_id").agg(inner.alias("payload"))
    return formats.wrapped_rows(wrapped, "payload", "event_id long, value double").select("user_id", "event_id", "value")


@query("s8_fallback_chain", "WITH s AS (SELECT date, 1 AS pri, close FROM flags WHERE code = 'A' UNION ALL SELECT date, 2, close FROM flags WHERE code = 'N' UNION ALL SELECT date, 3, close FROM flags WHERE code = 'R') SELECT date, pri, close FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY pri) = 1", "flags")
def s8(spark, d):
    pri = F.element_at(F.create_map(*[x for k, n in (("A", 1), ("N", 2), ("R", 3)) for x in (F.lit(k), F.lit(n))]), c("code"))
    rows = P.flag_panel(spark, d).select("date", pri.alias("pri"), "close")
    return rows.withColumn("t", F.row_number().over(Window.partitionBy("date").orderBy("pri"))).filter("t = 1").drop("t")


@query("s10_delimited_payload", "SELECT code, date, close FROM flags", "flags")
def s10(spark, d):
    from tidepanel.sources import formats

    line = F.concat_ws(",", c("date").cast("string"), c("close").cast("string"))
    packed = P.flag_panel(spark, d).groupBy("code").agg(F.concat_ws(";", F.collect_list(line)).alias("payload"))
    return formats.delimited_rows(packed, "payload", [("date", "date"), ("close", "double")]).select("code", "date", "close")


@query("s12_kline_arrays", "SELECT code, date, close FROM flags WHERE date <= DATE '1999-01-04' AND close > 0", "flags")
def s12(spark, d):
    from tidepanel.sources import formats

    rows = F.to_json(F.collect_list(F.array(c("date").cast("string"), c("close").cast("string"))))
    packed = P.flag_panel(spark, d).groupBy("code").agg(rows.alias("body"))
    return formats.kline_rows(packed, "body").filter((c("date") <= F.lit("1999-01-04").cast("date")) & (c("close") > 0)).select("code", "date", "close")


@query(
    "s14_xml_entries",
    """SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date, l_quantity AS QTY, CASE WHEN l_partkey % 8 <> 0 THEN l_tax END AS TAX FROM lineitem WHERE l_partkey % 6 <> 0""",
)
def s14(spark, d):
    """Every entry of every body; entries without a whole date are left out, values that are no numbers are null."""
    from tidepanel.sources.feeds import xml_entries

    text = lambda v: v.cast("string")
    day = F.when(c("l_partkey") % 6 == 0, "soon").otherwise(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00")))
    tax = F.when(c("l_partkey") % 8 == 0, "N/A").otherwise(text(c("l_tax")))
    entry = F.concat(F.lit("<entry><id>x</id><content type='application/xml'><m:properties><d:NEW_DATE m:type='Edm.DateTime'>"), day, F.lit("</d:NEW_DATE><d:QTY> "), text(c("l_quantity")), F.lit(" </d:QTY><d:TAX>"), tax, F.lit("</d:TAX></m:properties></content></entry>"))
    head = "<feed xmlns='http://www.w3.org/2005/Atom' xmlns:d='urn:d' xmlns:m='urn:m'><title>rates</title>"
    bodies = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit(head), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("body"))
    return xml_entries(bodies, "body", ["l_orderkey"], {"QTY": "double", "TAX": "double"}, "NEW_DATE")


@query("s19_jsonl", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s19(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    folder = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    rows.write.option("compression", "gzip").json(folder)
    return spark.read.schema("s_suppkey long, s_name string, s_acctbal double").json(folder)


@query("s21_store_guards", "SELECT count(*) AS events, sum(strlen(props)) AS bytes, count(*) <= 15000000 AND sum(strlen(props)) <= 134217728000 AS within FROM events")
def s21(spark, d):
    n, size = F.count("*"), F.sum(F.octet_length("props"))
    return table(spark, d, "events").agg(n.alias("events"), size.alias("bytes"), ((n <= 15_000_000) & (size <= 134_217_728_000)).alias("within"))
