"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions import documents as D
from tidepanel.functions import scalars as S
from tidepanel.operators import features as X
from tidepanel.queries.features import scored
from tidepanel.queries.registry import query
from tidepanel.session import table
from tidepanel.sources import panel as P

c = F.col


def orders(spark, d):
    return table(spark, d, "orders")


def docs(spark, d):
    return table(spark, d, "documents")


def session_of(rows, day, sessions, later, out):
    """`rows` with the last session at or before `day` (later 0) or the later-th after it. Days and sessions are a calendar; rows meet it by day."""
    dates = sessions.select("date").distinct()
    days = rows.select(c(day).alias("_day")).filter("_day is not null").withColumn("_s", F.lit(0)).unionByName(dates.select(c("date").alias("_day"), F.lit(1).alias("_s")))
    # One row per day is left for the windows.
    days = days.groupBy("_day").agg(F.max("_s").alias("_s")).withColumn("_n", F.sum("_s").over(Window.orderBy("_day")) + later)
    numbered = dates.select(F.row_number().over(Window.orderBy("date")).cast("long").alias("_n"), c("date").alias(out))
    calendar = days.join(F.broadcast(numbered), "_n").select("_day", out)
    return rows.join(F.broadcast(calendar), c(day) == c("_day"), "left").drop("_day")


@query("p1_finite", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def p1(spark, d):
    raw = F.when(c("event_id") % 5 == 0, "NaN").when(c("event_id") % 7 == 0, "n/a").otherwise(c("value").cast("string"))
    return table(spark, d, "events").select("event_id", S.finite(raw).alias("value"))


@query("p2_strict_number", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN -value WHEN 2 THEN value * 100 ELSE value END AS value FROM events")
def p2(spark, d):
    shown = c("value").cast("string")
    text = F.when(c("event_id") % 4 == 1, F.concat(F.lit("-"), shown)).when(c("event_id") % 4 == 2, F.concat(shown, F.lit("e2"))).when(c("event_id") % 4 == 3, F.concat(F.lit(" "), shown, F.lit(" ")))
    return table(spark, d, "events").select("event_id", F.round(S.strict_number(text), 6).alias("value"))


@query("p3_placeholders", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 1000.0 END AS value FROM events")
def p3(spark, d):
    raw = F.when(c("event_id") % 3 == 0, "--").otherwise(F.format_number(c("event_id") * 1000, 1))
    return table(spark, d, "events").select("event_id", S.number_or_null(raw).alias("value"))


_OHLC = "bars AS (SELECT CAST(ts AS DATE) AS date, event_type AS code, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2)"


def bars(spark, d):
    e = table(spark, d, "events")
    key = F.struct("ts", "event_id")
    return e.groupBy(F.to_date("ts").alias("date"), c("event_type").alias("code")).agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("n"))


@query("p4_ohlc_consistency", f"WITH {_OHLC} SELECT date, code, coalesce(least(open, high, low, close) > 0 AND high + 0.01 >= greatest(open, close, low) AND low - 0.01 <= least(open, close, high), false) AS valid FROM bars")
def p4(spark, d):
    return bars(spark, d).select("date", "code", S.valid_ohlc(c("open"), c("high"), c("low"), c("close"), 0.01).alias("valid"))


@query("c10_flow_from_assets", "SELECT date, code, round(amount - lag(amount) OVER s * (1 + ret), 2) + 0.0 AS flow FROM raw WINDOW s AS (PARTITION BY code ORDER BY date)", "raw")
def c10(spark, d):
    return P.brand_panel(spark, d).select("date", "code", (F.round(c("amount") - F.lag("amount").over(X.series()) * (1 + X.change("close", 1)), 2) + F.lit(0.0)).alias("flow"))


@query(
    "c17_volume_gate",
    """WITH b AS (SELECT p.*, p.amount / b.amount AS share, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS turn FROM panel p JOIN bench b USING (date)),
    m AS (SELECT code, round(avg(amount) FILTER (turn <= 5) / avg(amount) FILTER (turn BETWEEN 6 AND 25), 9) AS a, round(avg(volume) FILTER (turn <= 5) / avg(volume) FILTER (turn BETWEEN 6 AND 25), 9) AS v,
      round(avg(share) FILTER (turn <= 5) / avg(share) FILTER (turn BETWEEN 6 AND 25), 9) AS s FROM b WHERE turn <= 25 GROUP BY code)
    SELECT code, a >= 1.35 AND v >= 1.2 AND s >= 1.15 AS verified, list_filter([CASE WHEN a < 1.35 THEN 'amount' END, CASE WHEN v < 1.2 THEN 'volume' END, CASE WHEN s < 1.15 THEN 'share' END], lambda x: x IS NOT NULL) AS missed FROM m""",
    "panel", "bench",
)
def c17(spark, d):
    m = X.history_metrics(P.brand_panel(spark, d), P.benchmark(spark, d))
    gates = [(F.round(f"{x}_5_20", 9) < bound, x) for x, bound in (("amount", 1.35), ("volume", 1.2), ("share", 1.15))]  # fixed values
    missed = S.violations(*gates)
    return m.select("code", (F.size(missed) == 0).alias("verified"), missed.alias("missed"))


@query("c1_log_ratio", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal / 1000) END, 6) AS v FROM customer")
def c1(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.log_ratio(c("c_acctbal"), F.lit(1000.0)), 6).alias("v"))


@query("c2_ratio", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_linenumber - 1, 0), 6) AS v FROM lineitem")
def c2(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.ratio(c("l_extendedprice"), (c("l_linenumber") - 1).cast("double")), 6).alias("v"))


@query("c3_sigmoid_c4_logit_c5_clamp", "SELECT c_custkey, round(1 / (1 + exp(-least(60, greatest(-60, c_acctbal / 1000)))), 6) AS p, round(ln(least(0.999999, greatest(0.000001, c_acctbal / 10000)) / (1 - least(0.999999, greatest(0.000001, c_acctbal / 10000)))), 6) AS l, least(100, greatest(0, c_acctbal)) AS k FROM customer")
def c3(spark, d):
    b = c("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(S.sigmoid(b / 1000), 6).alias("p"), F.round(S.logit(b / 10000), 6).alias("l"), S.clamp(b, 0.0, 100.0).alias("k"))


_EXACT = "SELECT date, code, CASE WHEN {0} = 0 THEN '0' ELSE printf('%.17g', {0}) END AS close, printf('%.17g', {1}) AS part, coalesce(printf('%.17g', {2}), '') AS back FROM raw"


@query("c6_number_text", _EXACT.format("(close % 0.01)", "close / 3e9", "nullif(ret, 0)"), "raw")
def c6(spark, d):
    """Numbers as text with 17 digits, from which the same double is read."""
    rows = P.brand_panel(spark, d).withColumn("ret", X.change("close", 1))
    return rows.select(
        "date", "code", D.exact_text(c("close") % 0.01).alias("close"), D.exact_text(c("close") / 3e9).alias("part"), D.exact_text(F.nullif(c("ret"), F.lit(0.0))).alias("back")
    )


@query("c7_significant_digits", "SELECT date, code, round(CAST(printf('%.13e', momentum20) AS DOUBLE), 9) AS v, CAST(printf('%.2e', amount) AS DOUBLE) AS coarse FROM rows_ JOIN panel USING (date, code)", "rows_", "panel")
def c7(spark, d):
    panel = P.brand_panel(spark, d)
    rows = X.feature_rows(panel).select("date", "code", "momentum20").join(panel.select("date", "code", "amount"), ["date", "code"])
    return rows.select("date", "code", F.round(S.significant(c("momentum20"), 14), 9).alias("v"), S.significant(c("amount"), 3).alias("coarse"))


@query("c8_basis_points", "SELECT date, round((close - lag(close) OVER (ORDER BY date)) * 100, 2) AS bp FROM bench", "bench")
def c8(spark, d):
    return P.benchmark(spark, d).select("date", F.round((c("close") - F.lag("close").over(Window.orderBy("date"))) * 100, 2).alias("bp"))


@query("c9_flow_from_shares", "SELECT date, code, round(round((volume - lag(volume) OVER s) * close, 6), 1) + 0.0 AS by_shares, round(round(amount - lag(amount) OVER s * (1 + close / lag(close) OVER s - 1), 6), 1) + 0.0 AS by_assets FROM prio WINDOW s AS (PARTITION BY code ORDER BY date)", "prio")
def c9(spark, d):
    lag = lambda x: F.lag(x).over(X.series())
    return P.priority_panel(spark, d).select("date", "code", (F.round(F.round((c("volume") - lag("volume")) * c("close"), 6), 1) + F.lit(0.0)).alias("by_shares"), (F.round(F.round(c("amount") - lag("amount") * (1 + X.change("close", 1)), 6), 1) + F.lit(0.0)).alias("by_assets"))




@query(
    "c11_renormalized_weights",
    "WITH w(k, w) AS (VALUES ('A', 0.4), ('N', 0.3), ('R', 0.2)), x AS (SELECT date, code, w FROM flags JOIN w ON k = code) SELECT date, code, round(w / sum(w) OVER (PARTITION BY date), 6) AS weight FROM x",
    "flags",
)
def c11(spark, d):
    weights = F.create_map(*[F.lit(x) for kv in (("A", 0.4), ("N", 0.3), ("R", 0.2)) for x in kv])
    x = P.flag_panel(spark, d).withColumn("w", F.try_element_at(weights, c("code"))).filter("w > 0")
    return x.select("date", "code", F.round(c("w") / F.sum("w").over(X.cross()), 6).alias("weight"))


@query(
    "c12_score_with_enough_factors",
    "WITH w(code, w) AS (VALUES ('view', 0.4), ('click', 0.3), ('purchase', 0.2), ('signup', 0.1), ('error', 0.0)) SELECT date, count(*) AS factors, CASE WHEN count(*) >= 3 THEN round(round(sum(close * w) FILTER (w > 0) / sum(w) FILTER (w > 0), 9), 4) END AS score FROM hourly JOIN w USING (code) GROUP BY date",
    "hourly",
)
def c12(spark, d):
    weights = F.create_map(*[F.lit(x) for kv in (("view", 0.4), ("click", 0.3), ("purchase", 0.2), ("signup", 0.1), ("error", 0.0)) for x in kv])
    rows = P.event_panel(spark, d).withColumn("w", F.try_element_at(weights, c("code"))).filter("w is not null")
    return rows.groupBy("date").agg(F.count("*").alias("factors"), S.rounded(S.rounded(S.weighted_score(c("close"), c("w")), 9), 4).alias("score"))


_OBSERVED = "CASE WHEN s >= 80 THEN 'leading' WHEN s >= 60 THEN 'strengthening' WHEN s >= 40 THEN 'neutral' WHEN s >= 20 THEN 'weakening' ELSE 'lagging' END"
_FORECAST = "CASE WHEN s >= 85 THEN 'strong-up' WHEN s >= 60 THEN 'up' WHEN s >= 40 THEN 'range' WHEN s >= 15 THEN 'down' ELSE 'strong-down' END"


@query("c13_directions", f"SELECT o_orderkey, {_OBSERVED} AS observed, {_FORECAST} AS forecast FROM (SELECT o_orderkey, o_orderkey % 101 AS s FROM orders)")
def c13(spark, d):
    s = c("o_orderkey") % 101
    return orders(spark, d).select("o_orderkey", S.observed_direction(s).alias("observed"), S.forecast_direction(s).alias("forecast"))


@query("c14_forecast_direction", f"SELECT c_custkey, s, {_FORECAST} AS forecast FROM (SELECT c_custkey, round(c_acctbal / 100, 1) AS s FROM customer)")
def c14(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(c("c_acctbal") / 100, 1).alias("s")).withColumn("forecast", S.forecast_direction(c("s")))


@query(
    "c15_edge_direction",
    """WITH b AS (SELECT *, round(p - avg(y) OVER (PARTITION BY horizon), 9) AS e FROM scored) SELECT date, code, horizon,
    CASE WHEN e >= 0.08 THEN 'strong-up' WHEN e >= 0.03 THEN 'up' WHEN e <= -0.08 THEN 'strong-down' WHEN e <= -0.03 THEN 'down' ELSE 'range' END AS edge FROM b""",
    "scored",
)
def c15(spark, d):
    base = F.avg("y").over(Window.partitionBy("horizon"))
    return scored(spark, d).withColumn("e", F.round(c("p") - base, 9)).select("date", "code", "horizon", S.edge_direction(c("e"), F.lit(0.0)).alias("edge"))


_STAGES = """WITH x AS (SELECT date, code, momentum5 - avg(momentum5) OVER (PARTITION BY date) AS relative, exp(amount_ratio) AS amount, exp(volume_ratio) AS volume,
  100 * avg(CAST(momentum5 > 0 AS INTEGER)) OVER (PARTITION BY date) AS breadth FROM rows_)"""


def stage_inputs(spark, d):
    date = Window.partitionBy("date")
    rows = X.feature_rows(P.brand_panel(spark, d))
    return rows.select(
        "date", "code", (c("momentum5") - F.avg("momentum5").over(date)).alias("relative"), F.exp("amount_ratio").alias("amount"), F.exp("volume_ratio").alias("volume"),
        (100 * F.avg((c("momentum5") > 0).cast("int")).over(date)).alias("breadth"),
    )


@query(
    "c16_lifecycle_stage",
    f"{_STAGES} SELECT date, code, CASE WHEN round(relative, 9) > 0 AND breadth >= 50 THEN 'acceleration' WHEN round(relative, 9) > 0 THEN 'divergence' WHEN round(amount, 9) >= 1.6 AND breadth < 50 THEN 'distribution' ELSE 'early' END AS stage FROM x",
    "rows_",
)
def c16(spark, d):
    return stage_inputs(spark, d).select("date", "code", S.lifecycle_stage(F.round("relative", 9), F.round("amount", 9), c("breadth")).alias("stage"))


@query("c18_market_direction", "SELECT date, code, CASE WHEN ret > 0 THEN 'up' WHEN ret < 0 THEN 'down' WHEN ret = 0 THEN 'flat' END AS direction FROM raw", "raw")
def c18(spark, d):
    return P.brand_panel(spark, d).select("date", "code", S.market_direction(X.change("close", 1)).alias("direction"))


@query(
    "c19_confidence",
    """WITH g AS (SELECT horizon, code, count(DISTINCT date) AS dates, round(avg(CAST((p > 0.5) = (y = 1) AS INTEGER)), 9) AS consistency, round(avg(excess), 9) AS ic, round(avg(CAST(excess > 0 AS INTEGER)), 9) AS share, round(100 * avg(p), 6) AS s FROM scored GROUP BY 1, 2)
    SELECT horizon, code, greatest(10, least(49, round_even(18 + 8 * least(1, dates / 100.0) + 8 * greatest(0, least(1, (consistency - 0.5) / 0.15)) + 7 * greatest(0, least(1, ic / 0.12))
      + 4 * greatest(0, least(1, (share - 0.5) / 0.2)) + 4 * least(1, abs(s - 50) / 50), 0))) AS confidence FROM g""",
    "scored",
)
def c19(spark, d):
    share = lambda x: F.round(F.avg(x.cast("int")), 9)
    g = scored(spark, d).groupBy("horizon", "code").agg(
        F.countDistinct("date").alias("dates"), share((c("p") > 0.5) == (c("y") == 1)).alias("consistency"), F.round(F.avg("excess"), 9).alias("ic"),
        share(c("excess") > 0).alias("share"), F.round(100 * F.avg("p"), 6).alias("s"),
    )
    return g.select("horizon", "code", S.evidence_score(c("dates"), c("consistency"), c("ic"), c("share"), c("s")).alias("confidence"))


@query("c20_status_precedence", "SELECT date, CASE WHEN count(*) < 3 THEN 'incomplete' WHEN min(volume) < 3 THEN 'delayed' ELSE 'verified' END AS status FROM hourly GROUP BY 1", "hourly")
def c20(spark, d):
    return P.event_panel(spark, d).groupBy("date").agg(F.when(F.count("*") < 3, "incomplete").when(F.min("volume") < 3, "delayed").otherwise("verified").alias("status"))


@query("c21_percent_or_fraction", "SELECT o_orderkey, CASE WHEN v > 1 THEN v / 100 ELSE v END AS p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100) * 1.0 ELSE (o_orderkey % 100) / 100.0 END AS v FROM orders)")
def c21(spark, d):
    k = c("o_orderkey") % 100
    v = F.when(c("o_orderkey") % 2 == 0, k * F.lit(1.0)).otherwise(k / 100.0)
    return orders(spark, d).select("o_orderkey", F.when(v > 1, v / 100).otherwise(v).alias("p"))


@query("c22_due_date", "SELECT s.date, t.date AS due FROM sess s LEFT JOIN sess t ON t.session = s.session + 20", "sess")
def c22(spark, d):
    return P.benchmark(spark, d).select("date", F.lead("date", 20).over(Window.orderBy("date")).alias("due"))


@query("c23_due_of_list", "WITH l AS (SELECT list(DISTINCT date ORDER BY date) AS days FROM bench) SELECT o_orderkey, list_filter(days, lambda x: x > CAST(o_orderdate AS DATE))[3] AS due FROM orders, l", "bench")
def c23(spark, d):
    asked = orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return session_of(asked, "day", P.benchmark(spark, d), 3, "due").select("o_orderkey", "due")


@query("c24_latest_complete_session", "SELECT event_id, (SELECT max(date) FROM bench WHERE date <= CAST('1996-06-03' AS DATE) + CAST(event_id % 300 AS INTEGER) - CASE WHEN hour(ts) < 17 THEN 1 ELSE 0 END) AS session FROM events", "bench")
def c24(spark, d):
    limit = F.date_sub(F.date_add(F.lit("1996-06-03").cast("date"), (c("event_id") % 300).cast("int")), F.when(F.hour("ts") < 17, 1).otherwise(0))
    asked = table(spark, d, "events").select("event_id", limit.alias("limit"))
    return session_of(asked, "limit", P.benchmark(spark, d), 0, "session").select("event_id", "session")


@query("c25_trading_lag", "SELECT s.date, s.session - coalesce((SELECT max(session) FROM sess t WHERE t.date <= s.date - 30), 0) AS lag FROM sess s", "sess")
def c25(spark, d):
    from tidepanel.operators.labels import calendar

    bench = P.benchmark(spark, d)
    days = calendar(bench)
    old = days.select(c("date").alias("old_date"), c("session").alias("old"))
    found = session_of(days.withColumn("limit", F.date_sub("date", 30)), "limit", bench, 0, "old_date")
    return found.join(old, "old_date", "left").select("date", (c("session") - F.coalesce("old", F.lit(0))).cast("long").alias("lag"))


@query("c26_local_date", "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_date FROM events")
def c26(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date(c("ts") + F.expr("INTERVAL 8 HOURS")).alias("local_date"))


@query("c27_monday_and_week", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, week(o_orderdate) AS week FROM orders")
def c27(spark, d):
    return orders(spark, d).select("o_orderkey", F.date_trunc("week", "o_orderdate").cast("date").alias("monday"), F.weekofyear("o_orderdate").cast("long").alias("week"))


@query("c28_age", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS age, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 365 AS fresh FROM orders")
def c28(spark, d):
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    return orders(spark, d).select("o_orderkey", age.cast("long").alias("age"), (age <= 365).alias("fresh"))


@query(
    "c29_canonical_url",
    r"""WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), h AS (SELECT page_id, u, lower(regexp_extract(u, '^https://([^/?]*)', 1)) AS host, regexp_extract(u, '^https://[^/?]*(.*)$', 1) AS rest FROM b)
    SELECT page_id, CASE WHEN lower(u) LIKE 'https://%' AND host NOT LIKE '%@%' AND host <> '' THEN 'https://' || regexp_replace(host, ':443$', '') || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url FROM h""",
)
def c29(spark, d):
    return table(spark, d, "pages").select("page_id", S.canonical_url(c("url")).alias("url"))


@query("c30_plain_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(substr(regexp_replace(html, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), 1, 10000), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages")
def c30(spark, d):
    return table(spark, d, "pages").select("page_id", S.plain_text(c("html")).alias("text"))


@query("c31_phrase_count", "SELECT doc_id, len(string_split(text, 'the ')) - 1 AS n FROM documents")
def c31(spark, d):
    return docs(spark, d).select("doc_id", F.regexp_count("text", F.lit("the ")).cast("long").alias("n"))


@query("c32_sentences", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?;。！？；]'), lambda s: regexp_matches(s, '[^ \t\n\r]'))) AS n FROM documents")
def c32(spark, d):
    return docs(spark, d).select("doc_id", F.size(S.sentences(c("text"))).cast("long").alias("n"))


@query("c33_numeric_tokens", r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)', 1), lambda t: NOT regexp_matches(t, '^(19|20)[0-9]{2}$')))) AS tokens FROM documents")
def c33(spark, d):
    return docs(spark, d).select("doc_id", F.array_sort(S.numeric_tokens(c("text"))).alias("tokens"))


@query("c34_accented_letters", "SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS n FROM documents")
def c34(spark, d):
    return docs(spark, d).select("doc_id", F.length(F.regexp_replace("text", "[\\x00-\\x7F]", "")).cast("long").alias("n"))


@query("c35_letters_without_space", r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS n FROM documents")
def c35(spark, d):
    return docs(spark, d).select("doc_id", S.letters_without_space(c("text")).cast("long").alias("n"))


_MAIL, _IP, _HOME = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", r"/(home|Users)/[A-Za-z0-9_.-]+"
_MAC = r"(?i)\b[0-9A-F]{2}(:[0-9A-F]{2}){5}\b"
_SECRET = r"""(?i)bearer\s+\S{8,}|(authorization|password|passwd|cookie|api[_-]?key|access[_-]?token|refresh[_-]?token|machine[_-]?id|machineguid|private[_-]?key|secret)\s*[:=]\s*["'']?[^\s"'']{8,}"""
_PAYLOAD = r"""(?i)["'']?(rawPayload|raw_provider_payload|providerPayload)["'']?\s*[:=]\s*(\{|\[|true|["''])"""


@query(
    "c36_redacted",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_MAIL}', '[mail]', 'g'), '{_IP}', '[ip]', 'g'), '{_HOME}', '[path]', 'g')) AS redacted,
    list_filter([CASE WHEN regexp_matches(text, '{_IP}') THEN 'ip' END, CASE WHEN regexp_matches(text, '{_MAC}') THEN 'mac' END, CASE WHEN regexp_matches(text, '{_SECRET}') THEN 'credential-value' END,
    CASE WHEN regexp_matches(text, '{_PAYLOAD}') THEN 'raw-provider-payload' END], lambda x: x IS NOT NULL) AS violations FROM documents""",
)
def c36(spark, d):
    return docs(spark, d).select("doc_id", F.md5(S.redacted(c("text"))).alias("redacted"), S.sensitive(c("text")).alias("violations"))


_TERMS = ["the", "and", "que"]


def sensational(docs):
    """Per document the terms that it holds anywhere."""
    return docs.select("doc_id", S.terms_in(c("text"), _TERMS).alias("terms"))


@query("c37_sensational_terms", "SELECT doc_id, list_filter(['the', 'and', 'que'], lambda t: contains(lower(text), t)) AS terms FROM documents")
def c37(spark, d):
    return sensational(docs(spark, d))


@query(
    "c37_calibrated_headline",
    """WITH t AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 41 - 20) / 10.0 END AS change, contains(lower(text), 'the') OR contains(lower(text), 'and') OR contains(lower(text), 'que') AS hit FROM documents)
    SELECT doc_id, CASE WHEN NOT coalesce(hit, false) THEN 'not-triggered' WHEN change IS NULL THEN 'needs-evidence' ELSE 'calibrated' END AS status,
    CASE WHEN coalesce(hit, false) AND change IS NOT NULL THEN lang || ' ' || source || ' ' || CASE WHEN change > 0 THEN '+' ELSE '' END || printf('%.2f', change) || '%' END AS headline FROM t""",
)
def c37_headline(spark, d):
    change = F.when(c("doc_id") % 3 > 0, (c("doc_id") % 41 - 20) / 10.0)
    status, headline = S.calibrated_headline(S.terms_in(c("text"), _TERMS), c("lang"), c("source"), change)
    return docs(spark, d).select("doc_id", status.alias("status"), headline.alias("headline"))


@query(
    "c38_fact_extraction",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 50) / 10.0 END AS percent, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS level FROM orders""",
)
def c38(spark, d):
    """Percent and level that the first matching fact of a list tells, thousands' commas and all."""
    k = c("o_orderkey")
    told = F.concat(F.lit("the index "), F.when(k % 2 == 0, "fell").otherwise("rose"), F.lit(" "), ((k % 50) / 10.0).cast("string"), F.lit("% to "), F.format_number("o_totalprice", 2))
    other = F.lit("volume rose 3% on the day")
    facts = F.when(k % 7 == 0, F.array(other)).when(k % 3 == 0, F.array(other, told, F.lit("the index rose 99% to 1"))).otherwise(F.array(told))
    percent, level = S.index_fact(c("facts"), r"index (rose|fell) ([0-9.]+)% to ([0-9,.]+)", "fell")
    return orders(spark, d).select("o_orderkey", facts.alias("facts")).select("o_orderkey", (percent + F.lit(0.0)).alias("percent"), level.alias("level"))


_CLAIM = "list_extract(['index rose ', 'Fell ', 'gained ', 'declined', 'stays at '], CAST(o_orderkey % 5 AS INTEGER) + 1) || CAST((o_orderkey % 50) / 10.0 AS VARCHAR) || '%'"


@query(
    "c39_percent_change",
    f"""WITH t AS (SELECT o_orderkey, {_CLAIM} AS t FROM orders), n AS (SELECT o_orderkey, t, try_cast(nullif(regexp_extract(t, '(?i)(rose|fell|gained|declined|上涨|下跌|升|跌)\\s*([0-9.]+)%', 2), '') AS DOUBLE) AS n FROM t)
    SELECT o_orderkey, round(CASE WHEN regexp_matches(t, '(?i)rose|gained|上涨|升') THEN n ELSE -n END, 2) + 0.0 AS change FROM n""",
)
def c39(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("index rose ", "Fell ", "gained ", "declined", "stays at "))), (c("o_orderkey") % 5 + 1).cast("int"))
    return orders(spark, d).select("o_orderkey", S.percent_change(F.concat(word, ((c("o_orderkey") % 50) / 10.0).cast("string"), F.lit("%"))).alias("change"))


@query(
    "c40_canonical_json",
    """WITH l AS (SELECT l_orderkey AS k, '[' || string_agg('{"flags":{"r":"' || l_returnflag || '","s":"' || l_linestatus || '"},"part":' || l_partkey || ',"qty":' || CAST(l_quantity AS BIGINT) || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) || ']' AS lines FROM lineitem GROUP BY 1)
    SELECT o_orderkey, sha256('{"lines":' || coalesce(lines, '[]') || ',"order":{"key":' || o_orderkey || ',"rank":[' || o_custkey % 3 || ',' || o_custkey % 5 || '],"status":"' || o_orderstatus || '"}}') AS digest, true AS same FROM orders LEFT JOIN l ON k = o_orderkey""",
)
def c40(spark, d):
    """Digests of order documents, from a struct with sorted fields and from JSON text with other key orders, spaces and decimals."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    whole = orders(spark, d).join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    part = lambda x: F.struct(x["l_quantity"].cast("long").alias("qty"), x["l_partkey"].alias("part"), F.struct(x["l_linestatus"].alias("s"), x["l_returnflag"].alias("r")).alias("flags"))
    rank = F.array(c("o_custkey") % 3, c("o_custkey") % 5)
    document = F.struct(F.struct(c("o_orderstatus").alias("status"), c("o_orderkey").alias("key"), rank.alias("rank")).alias("order"), F.transform(F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)), part).alias("lines"))
    rows = whole.select("o_orderkey", document.alias("v"))
    text = lambda x: F.concat(F.lit('{ "part" : '), x["part"].cast("string"), F.lit('.0, "flags": '), F.to_json(x["flags"]), F.lit(', "qty":'), x["qty"].cast("string"), F.lit(".00 }"))
    loose = F.concat(F.lit('{"order":'), F.to_json("v.order"), F.lit(' , "lines": ['), F.array_join(F.transform("v.lines", text), " , "), F.lit("]}"))
    digest = F.sha2(F.to_json(D.canonical_value(c("v"), rows.schema["v"].dataType)), 256)
    return rows.select("o_orderkey", digest.alias("digest"), (D.digest(loose) == digest).alias("same"))


@query("c41_digest_id", "SELECT o_orderkey, 'forecast-' || substr(sha256(o_orderkey || chr(31) || o_orderstatus), 1, 12) AS id FROM orders")
def c41(spark, d):
    return orders(spark, d).select("o_orderkey", S.digest_id("forecast", c("o_orderkey"), c("o_orderstatus")).alias("id"))


@query("c42_event_hash", "SELECT event_id, sha256(event_id || chr(31) || user_id || chr(31) || event_type || chr(31) || props) AS digest FROM events")
def c42(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(S.joined(c("event_id"), c("user_id"), c("event_type"), c("props")), 256).alias("digest"))


@query("c43_nested_content", """SELECT c_custkey, '{"title":"' || c_name || '","parts":[{"n":' || c_nationkey || '},{"n":' || c_custkey || '}]}' AS content FROM customer""")
def c43_nested(spark, d):
    part = lambda n: F.struct(F.lit("r1").alias("runId"), n.alias("n"))
    raw = F.to_json(F.struct(F.lit("2024").alias("generatedAt"), c("c_name").alias("title"), F.array(part(c("c_nationkey")), part(c("c_custkey"))).alias("parts")))
    kind = T.StructType.fromDDL("generatedAt string, title string, parts array<struct<runId: string, n: long>>")
    return table(spark, d, "customer").select("c_custkey", S.normalized_json(raw, kind).alias("content"))


@query(
    "c44_json_path",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'missing' WHEN 2 THEN 'non-primitive' WHEN 3 THEN 'path' WHEN 5 THEN 'missing' END AS fault, CASE o_orderkey % 6 WHEN 0 THEN o_orderstatus WHEN 4 THEN CAST(o_custkey AS VARCHAR) END AS value,
    CASE WHEN o_orderkey % 6 IN (0, 2, 4) THEN '{"order":{"ranks":' || CASE WHEN o_orderkey % 6 = 2 THEN '{"new":[1]}' ELSE '[' || o_custkey % 3 || ',' || CASE WHEN o_orderkey % 6 = 4 THEN '{"new":[1]}' ELSE CAST(o_custkey AS VARCHAR) END || ']' END || ',"status":'
      || CASE WHEN o_orderkey % 6 = 0 THEN '{"new":[1]}' ELSE '"' || o_orderstatus || '"' END || '}}' END AS changed FROM orders""",
)
def c44(spark, d):
    """The value at a path, or why there is none; and the document with another value there."""
    document = F.to_json(F.struct(F.struct(c("o_orderstatus").alias("status"), F.array(c("o_custkey") % 3, c("o_custkey")).alias("ranks")).alias("order")))
    paths = ["$.order.status", "$.order.ranks[7]", "$.order.ranks", "$.order.__proto__", "$.order.ranks[1]", "$.order.ranks[1].x"]
    path = F.element_at(F.array(*map(F.lit, paths)), (c("o_orderkey") % 6 + 1).cast("int"))
    rows = orders(spark, d).select("o_orderkey", document.alias("doc"), path.alias("path"))
    fault, value = D.value_at(c("doc"), c("path"))
    return rows.select("o_orderkey", fault.alias("fault"), value.alias("value"), D.with_value(c("doc"), c("path"), F.lit('{"new": [1.0]}')).alias("changed"))


@query("c46_sorted_unique", "SELECT c_nationkey AS nation, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY 1")
def c46(spark, d):
    return table(spark, d, "customer").groupBy(c("c_nationkey").alias("nation")).agg(F.array_sort(F.array_distinct(F.collect_list("c_mktsegment"))).alias("segments"))


@query("c47_common_as_of", "SELECT min(newest) AS through, count(DISTINCT newest) > 1 AS mismatch FROM (SELECT code, max(date) AS newest FROM hourly GROUP BY 1)", "hourly")
def c47(spark, d):
    newest = P.event_panel(spark, d).groupBy("code").agg(F.max("date").alias("newest"))
    return newest.agg(F.min("newest").alias("through"), (F.countDistinct("newest") > 1).alias("mismatch"))


@query("c43_normalized_content", "SELECT event_id, event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS kept FROM events")
def c43(spark, d):
    # Runtime keys are dropped by taking the typed map without them.
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~k.isin("runId", "generatedAt"))
    first = F.get(F.json_object_keys("props"), 0)
    return table(spark, d, "events").select("event_id", "event_type", F.try_element_at(kept, first).alias("kept"))
