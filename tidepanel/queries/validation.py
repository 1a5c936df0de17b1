"""Cleaning, contracts, text style and reports (P5 to P22, Q1 to Q32, R1 to R39, M31 to M33, S, T, U3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.documents import leaf_changes
from tidepanel.functions.style import Style, style_report
from tidepanel.functions import editorial as D
from tidepanel.functions import scalars as S
from tidepanel.operators import chained as CH
from tidepanel.operators import cleaning as B
from tidepanel.operators import contracts as K
from tidepanel.operators import features as X
from tidepanel.operators import labels as L
from tidepanel.operators import ledger as G
from tidepanel.operators import trigrams as TG
from tidepanel.queries.aggregates import outcomes, predictions
from tidepanel.queries.features import labels, scored, z_scores
from tidepanel.queries.registry import VIEWS, query
from tidepanel.session import cut, table
from tidepanel.sources import panel as P

c = F.col


def docs(spark, d):
    return table(spark, d, "documents")


#: Raw bars made of the events: some dates are malformed, some highs are below the close, and dates repeat.
VIEWS["rawbars"] = """SELECT event_id AS sequence, event_type AS code, CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS date, value AS open, CASE WHEN event_id % 19 = 0 THEN NULL ELSE value + event_id % 7 - 1 END AS high,
    value - 1 AS low, value AS close FROM events"""


def raw_bars(spark, d):
    e, k = table(spark, d, "events"), c("event_id")
    return e.select(
        k.alias("sequence"), c("event_type").alias("code"), F.when(k % 17 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), c("value").alias("open"),
        F.when(k % 19 != 0, c("value") + k % 7 - 1).alias("high"), (c("value") - 1).alias("low"), c("value").alias("close"),
    )


_GOOD = "date <> 'n/a' AND high IS NOT NULL AND high >= greatest(open, close, low) AND low <= least(open, close, high)"


@query("p5_clean_bars", f"SELECT code, date, arg_max(sequence, sequence) AS sequence, arg_max(close, sequence) AS close FROM rawbars WHERE {_GOOD} GROUP BY 1, 2", "rawbars")
def p5(spark, d):
    rows = raw_bars(spark, d)
    return B.clean_bars(rows.withColumn("kept", c("sequence")), ["code"], "sequence").select("code", "date", c("kept").alias("sequence"), "close")


_WHY = f"CASE WHEN date = 'n/a' THEN 'invalidDate' WHEN date < '2024-01-05' THEN 'preLaunch' WHEN date > '2024-01-25' THEN 'future' WHEN NOT coalesce({_GOOD}, false) THEN 'invalidOhlc' END"


@query(
    "p6_reject_counts",
    f"""WITH w AS (SELECT *, {_WHY} AS why FROM rawbars) SELECT code, count(*) AS input, count(*) FILTER (why = 'invalidDate') AS "invalidDate", count(*) FILTER (why = 'preLaunch') AS "preLaunch", count(*) FILTER (why = 'future') AS future,
    count(*) FILTER (why = 'invalidOhlc') AS "invalidOhlc", count(*) FILTER (why IS NULL) - count(DISTINCT date) FILTER (why IS NULL) AS duplicates, count(DISTINCT date) FILTER (why IS NULL) AS rows FROM w GROUP BY 1""",
    "rawbars",
)
def p6(spark, d):
    return B.reject_counts(raw_bars(spark, d), ["code"], "sequence", "2024-01-05", "2024-01-25")


@query("p7_ready_series", f"SELECT code, CASE WHEN count(DISTINCT date) >= 20 THEN 'ready' ELSE 'partial' END AS status FROM rawbars WHERE {_GOOD} AND date >= '2024-01-05' GROUP BY 1", "rawbars")
def p7(spark, d):
    bars = B.clean_bars(raw_bars(spark, d), ["code"], "sequence", launch="2024-01-05")
    return bars.groupBy("code").agg(B.source_status(F.count("*"), 20).alias("status"))


@query("p8_complete_close", "SELECT event_id, event_id % 5 <> 0 AND strftime(ts, '%H%M%S') >= '145700' AS complete FROM events")
def p8(spark, d):
    stamp = F.when(c("event_id") % 5 == 0, F.date_format("ts", "yyyyMMddHHmm")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    return table(spark, d, "events").select("event_id", B.is_complete_close(F.to_date("ts"), stamp, F.to_date("ts")).alias("complete"))


@query(
    "p9_without_echo",
    """WITH f AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY code ORDER BY date) = 1), u AS (SELECT date, code, close, volume, amount FROM panel UNION ALL SELECT date - 7, code, close, volume, CASE WHEN code < 'Brand#2' THEN amount ELSE amount + 1 END FROM f),
    t AS (SELECT *, row_number() OVER s AS turn, close = lead(close) OVER s AND volume = lead(volume) OVER s AND amount = lead(amount) OVER s AS same FROM u WINDOW s AS (PARTITION BY code ORDER BY date))
    SELECT code, min(date) AS first, count(*) AS rows FROM t WHERE NOT (turn = 1 AND coalesce(same, false)) GROUP BY 1""",
    "panel",
)
def p9(spark, d):
    panel = P.brand_panel(spark, d)
    first = panel.groupBy("code").agg(F.min_by(F.struct("date", "close", "volume", "amount"), "date").alias("f"))
    echo = first.select(F.date_sub("f.date", 7).alias("date"), "code", "f.close", "f.volume", F.when(c("code") < "Brand#2", c("f.amount")).otherwise(c("f.amount") + 1).alias("amount"))
    return B.without_echo(panel.unionByName(echo)).groupBy("code").agg(F.min("date").alias("first"), F.count("*").alias("rows"))


_WIDE = ", ".join(f"max({x}) FILTER (horizon = {h}) AS {x}{h}" for h in (1, 5, 20) for x in ("target_date", "rank", "top_quartile"))


@query("p10_wide_labels", f"SELECT date, code, {_WIDE} FROM lab GROUP BY 1, 2", "lab")
def p10(spark, d):
    wide = L.wide_labels(labels(spark, d), [1, 5, 20])
    return wide.select("date", "code", *[f"{x}{h}" for h in (1, 5, 20) for x in ("target_date", "rank", "top_quartile")])


#: Records made of the orders; statuses, targets and lineages mix, so that most rules are broken somewhere.
_RECORD = """rec AS (SELECT o_orderkey, 'pred-' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS due, [1, 5, 20, 2][CAST(o_orderkey % 4 AS INTEGER) + 1] AS horizon,
  CASE WHEN o_orderkey % 5 = 0 THEN 'not_trained' ELSE 'trained' END AS model, ['published', 'abstained', 'not_applicable', 'unavailable', 'other'][CAST(o_orderkey % 7 % 5 AS INTEGER) + 1] AS status,
  ['probability', 'evidence_observation', 'none'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS mode, ['raw_model', 'none', 'legacy_unknown'][CAST(o_orderkey % 11 % 3 AS INTEGER) + 1] AS source,
  ['absolute_up', 'none', 'top_quartile'][CAST(o_orderkey % 13 % 3 AS INTEGER) + 1] AS target, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 110 AS DOUBLE) END AS p, o_orderkey % 6 AS reasons, o_orderkey % 9 = 0 AS legacy FROM orders)"""


def records(spark, d):
    k = c("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("pred-"), k.cast("string")).alias("prediction_id"), F.concat(F.lit("pred-"), k.cast("string")).alias("state_id"), day.alias("prediction_date"), F.date_add(day, (k % 4).cast("int")).alias("due_date"), pick(k % 4, 1, 5, 20, 2).alias("horizon"),
        F.when(k % 5 == 0, "not_trained").otherwise("trained").alias("model"), pick(k % 7 % 5, "published", "abstained", "not_applicable", "unavailable", "other").alias("status"),
        pick(k % 3, "probability", "evidence_observation", "none").alias("mode"), pick(k % 11 % 3, "raw_model", "none", "legacy_unknown").alias("source"), pick(k % 13 % 3, "absolute_up", "none", "top_quartile").alias("target"),
        F.when(k % 2 == 0, (k % 110).cast("double")).alias("probability"), (k % 6).alias("reasons"), (k % 9 == 0).alias("legacy"),
    )


@query(
    "p11_prediction_contract",
    f"""WITH {_RECORD} SELECT o_orderkey, list_filter([CASE WHEN length(id) < 8 THEN 'id' END, CASE WHEN due <= day THEN 'due-date' END, CASE WHEN horizon NOT IN (1, 5, 20) THEN 'horizon' END, CASE WHEN status = 'other' THEN 'status' END, CASE WHEN p > 100 THEN 'probability-range' END,
    CASE WHEN status = 'published' AND (model <> 'trained' OR mode <> 'probability') THEN 'published-model' END, CASE WHEN status = 'published' AND (p IS NULL OR target = 'none') THEN 'published-probability' END,
    CASE WHEN status = 'published' AND source = 'none' THEN 'published-lineage' END, CASE WHEN status = 'abstained' AND (model <> 'trained' OR mode <> 'evidence_observation') THEN 'abstained-model' END,
    CASE WHEN status <> 'published' AND p IS NOT NULL THEN 'hidden-probability' END, CASE WHEN status = 'abstained' AND reasons = 0 THEN 'abstained-reasons' END,
    CASE WHEN status IN ('not_applicable', 'unavailable') AND model = 'trained' THEN 'trained-without-output' END, CASE WHEN status IN ('not_applicable', 'unavailable') AND (source <> 'none' OR target <> 'none') THEN 'lineage-without-output' END,
    CASE WHEN legacy AND (target <> 'absolute_up' OR source <> 'legacy_unknown') THEN 'legacy' END], lambda x: x IS NOT NULL) AS violations FROM rec""",
)
def p11(spark, d):
    return records(spark, d).select("o_orderkey", K.prediction_violations().alias("violations"))


@query(
    "p12_state_contract",
    f"""WITH {_RECORD} SELECT o_orderkey, list_filter([CASE WHEN length(id) < 8 THEN 'id' END, CASE WHEN horizon NOT IN (1, 5, 20) THEN 'horizon' END, CASE WHEN status IN ('other', 'published') THEN 'status' END, CASE WHEN p IS NOT NULL THEN 'probability' END,
    CASE WHEN source <> 'none' OR target <> 'none' THEN 'lineage' END, CASE WHEN mode <> 'none' THEN 'mode' END, CASE WHEN model = 'trained' AND status IN ('unavailable', 'not_applicable') THEN 'trained-without-output' END,
    CASE WHEN status = 'abstained' AND (model <> 'trained' OR reasons = 0) THEN 'abstained' END, CASE WHEN legacy THEN 'legacy' END], lambda x: x IS NOT NULL) AS violations FROM rec""",
)
def p12(spark, d):
    return records(spark, d).select("o_orderkey", K.state_violations().alias("violations"))


@query(
    "p13_recomputed_returns",
    "SELECT date, code, abs(round(100 * ret, 2) + CASE WHEN code = 'Brand#11' THEN 0.02 ELSE 0 END - 100 * ret) <= 0.011 AS agrees FROM raw WHERE ret IS NOT NULL",
    "raw",
)
def p13(spark, d):
    rows = P.brand_panel(spark, d).select("date", "code", X.change("close", 1).alias("ret")).filter("ret is not null")
    said = F.round(100 * c("ret"), 2) + F.when(c("code") == "Brand#11", 0.02).otherwise(0.0)
    return rows.select("date", "code", (F.abs(said - 100 * c("ret")) <= 0.011).alias("agrees"))


@query("p15_panel_verification", "SELECT date, code, horizon FROM lab WHERE code = 'Brand#12'", "lab")
def p15(spark, d):
    wrong = labels(spark, d).withColumn("forward", F.when(c("code") == "Brand#12", c("forward") + 1e-6).otherwise(c("forward")))
    return L.breaks_in_labels(wrong, P.brand_panel(spark, d)).select("date", "code", "horizon")


@query("p16_cross_section_faults", "SELECT date, count(*) AS rows, 5 - count(DISTINCT code) AS missing FROM hourly GROUP BY 1 HAVING count(*) <> 5", "hourly")
def p16(spark, d):
    return B.cross_section_faults(P.event_panel(spark, d), ["view", "error", "purchase", "signup", "click"]).select("date", "rows", "missing")


@query("p17_history_filter", "SELECT prediction_id FROM outc WHERE model = 'm1' AND horizon = 5 AND outcome IN ('correct', 'wrong') AND contains(lower(code), 'brand#1')", "outc")
def p17(spark, d):
    return outcomes(spark, d).filter((c("model") == "m1") & (c("horizon") == 5) & c("outcome").isin("correct", "wrong") & F.lower("code").contains("brand#1")).select("prediction_id")


_TERMS = ["the", "ciónn", "worthless", "Benchmark", "zz", "ß", "no such words", ". "]


@query("p18_archive_search", f"SELECT t.term, doc_id FROM documents, (VALUES {', '.join(f"('{t}')" for t in _TERMS)}) t(term) WHERE contains(lower(concat_ws(' ', source, lang, text)), lower(t.term))")
def p18(spark, d):
    """Documents that hold a term anywhere, for many terms over one index."""
    archive = docs(spark, d).select("doc_id", F.concat_ws(" ", "source", "lang", "text").alias("body"))
    return TG.search(archive, TG.build(archive, "doc_id", "body"), _TERMS, "doc_id", "body").select("term", "doc_id")


@query(
    "p19_record_search",
    """SELECT term, c_custkey FROM (SELECT term, c_custkey, row_number() OVER (PARTITION BY term ORDER BY c_custkey) AS t FROM customer, (VALUES ('auto'), ('#000000'), ('"c_name":"customer#0000000'), ('q'), ('household"}')) t(term)
    WHERE contains(lower('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}'), term)) WHERE t <= 50""",
)
def p19(spark, d):
    """The first 50 records (the feature's own limit) whose serialized form holds a term."""
    records = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("record"))
    found = TG.search(records, TG.build(records, "c_custkey", "record"), ["auto", "#000000", '"c_name":"customer#0000000', "q", 'household"}'], "c_custkey", "record")
    turn = F.row_number().over(Window.partitionBy("term").orderBy("c_custkey"))
    return found.withColumn("_t", turn).filter("_t <= 50").select("term", "c_custkey")


@query("p20_public_columns", "SELECT prediction_id, code, horizon, status FROM pred", "pred")
def p20(spark, d):
    public = ["prediction_id", "code", "horizon", "status"]
    rows = predictions(spark, d).select(*public)
    leaked = set(rows.columns) - set(public)
    if leaked:
        raise ValueError(f"private columns: {sorted(leaked)}")
    return rows


@query("p21_usable_features", "SELECT f AS feature, n AS present, n >= greatest(20, floor((SELECT count(*) FROM feat) * 0.02)) AND (SELECT count(*) FROM feat) > 0 AS usable FROM (SELECT unnest(['momentum5', 'momentum60', 'never']) AS f, unnest([count(momentum5), count(momentum60), 0]) AS n FROM feat)", "feat")
def p21(spark, d):
    rows = X.trailing_features(P.brand_panel(spark, d)).withColumn("never", F.lit(None).cast("double"))
    return B.usable_features(rows, ["momentum5", "momentum60", "never"])


@query("p22_document_window", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END, CAST(ts + INTERVAL 8 HOUR AS DATE)) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def p22(spark, d):
    day = F.coalesce(F.when(c("event_id") % 3 == 0, F.to_date("ts")), F.to_date(F.from_utc_timestamp("ts", "Asia/Shanghai")))
    return table(spark, d, "events").filter(day.between("2024-01-10", "2024-01-12")).select("event_id")


# Text style


_PARTS = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?;。！？；\\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 0)"
_NORMAL = f"list_filter(list_transform({_PARTS}, lambda s: regexp_replace(s, '[ \\t\\r\\n\\f\\v\"''“”「」]+', '', 'g')), lambda s: length(s) >= 16)"
_RUN = f"list_max(list_transform(string_split(list_aggregate(list_transform({_PARTS}, lambda s: CASE WHEN regexp_matches(s, 'the|que|und') THEN 'x' ELSE '-' END), 'string_agg', ''), '-'), lambda s: length(s)))"


@query("q2_duplicate_sentences", f"SELECT doc_id, len(n) - len(list_distinct(n)) AS n FROM (SELECT doc_id, {_NORMAL} AS n FROM documents)")
def q2(spark, d):
    return docs(spark, d).select("doc_id", D.duplicate_sentences(c("text")).alias("n"))


@query(
    "q3_repetition_ratio",
    f"""WITH s AS (SELECT doc_id, unnest({_NORMAL}) AS s FROM documents), t AS (SELECT doc_id, sum(length(s)) AS n FROM (SELECT doc_id, s FROM s GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
    SELECT doc_id, round(coalesce(n / nullif(length(regexp_replace(text, '\\s+', '', 'g')), 0), 0), 4) AS ratio FROM documents LEFT JOIN t USING (doc_id)""",
)
def q3(spark, d):
    return docs(spark, d).select("doc_id", D.repeated_share(c("text")).alias("ratio"))


@query("q4_limitation_ratio", "SELECT doc_id, round(coalesce(list_sum(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, 'the|que|und')), lambda s: length(s))), 0) / greatest(length(coalesce(text, '')), 1), 4) AS ratio FROM documents")
def q4(spark, d):
    return docs(spark, d).select("doc_id", D.flagged_share(c("text"), "the|que|und").alias("ratio"))


@query("q5_longest_hedge_run", f"SELECT doc_id, coalesce({_RUN}, 0) AS run FROM documents")
def q5(spark, d):
    return docs(spark, d).select("doc_id", D.longest_run(c("text"), "the|que|und").alias("run"))


@query("q6_sentence_length", f"SELECT doc_id, round(coalesce(list_sum(list_transform(s, lambda x: length(x))) / nullif(len(s), 0), 0), 6) AS mean, len(list_filter(s, lambda x: length(x) > 90)) AS long FROM (SELECT doc_id, {_PARTS} AS s FROM documents)")
def q6(spark, d):
    return docs(spark, d).select("doc_id", F.round(D.mean_sentence(c("text")), 6).alias("mean"), D.long_sentences(c("text")).alias("long"))


_STYLE = Style(
    defensive=(" may be ", " nicht ", " pero ", " mais "), empty_watch=("to be watched", " auch das", " todo "), hedges=("the", "que", "und"), technical=("Token", "http", "lorem"), strong_claims=("always", "immer ", "siempre"),
    governance=("secret", "password"), limitations=("not ", "ohne", "sin ", "sans "), generic_titles=("report web",), forbidden_titles=("forum",), instructions=(r"\b(buy|sell) now\b", r"[A-Z]{12,}"), limits={"en": (1, 80), "de": (3, 60)}, other=(2, 70), sentence=90,
)


def _style_sql(s):
    count = lambda t, p: f"(length({t}) - length(replace({t}, '{p}', ''))) // {len(p)}"
    every = lambda t, ps: " + ".join(count(t, p) for p in ps)
    some = lambda t, ps: "(" + " OR ".join(f"contains({t}, '{p}')" for p in ps) + ")"
    run = lambda marks: f"coalesce(list_max(list_transform(string_split(array_to_string(list_transform({marks}, lambda m: CASE WHEN m THEN 'x' ELSE '-' END), ''), '-'), lambda x: length(x))), 0)"
    limit = lambda k: "CASE lang " + " ".join(f"WHEN '{n}' THEN {v[k]}" for n, v in s.limits.items()) + f" ELSE {s.other[k]} END"
    return f"""WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS t, trim('report ' || source) AS title, {_PARTS} AS s, {_NORMAL} AS n, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
    l AS (SELECT *, list_transform(p, lambda x: {some('x', s.limitations)}) AS lim FROM b),
    m AS (SELECT doc_id, lang, {every('t', s.defensive)} AS defensive, {' + '.join(f"greatest(0, {count('t', p)} - 1)" for p in s.defensive)} AS disclaimers, {every('t', s.empty_watch)} AS empty_watch, {every('lower(t)', [p.lower() for p in s.technical])} AS technical,
      {every('t', s.strong_claims)} AS strong_claims, {every('t', s.governance)} AS governance, {' + '.join(f"len(regexp_extract_all(t, '{p}'))" for p in s.instructions)} AS instructions, {run(f"list_transform(s, lambda x: regexp_matches(x, '{'|'.join(s.hedges)}'))")} AS hedge_run,
      len(list_filter(s, lambda x: length(x) > {s.sentence})) AS long_sentences, len(n) - len(list_distinct(n)) AS duplicates, {some("coalesce(title, '')", s.generic_titles)} AS generic_title, {some("coalesce(title, '')", s.forbidden_titles)} AS forbidden_title, {some("coalesce(s[-1], '')", s.empty_watch)} AS generic_ending,
      {run('lim')} AS limitation_run, round(list_sum(list_transform(p, lambda x, i: CASE WHEN lim[i] THEN length(x) ELSE 0 END)) / greatest(length(t), 1), 4) AS limitation_share FROM l),
    k AS (SELECT *, CAST(greatest(0, 100 - (least(20, 8 * greatest(0, defensive - {limit(0)})) + 10 * disclaimers + 8 * empty_watch + 5 * greatest(0, hedge_run - {s.hedge_run}) + least(15, 2 * long_sentences) + 5 * duplicates + CASE WHEN generic_title THEN 12 ELSE 0 END
      + CASE WHEN generic_ending THEN 10 ELSE 0 END + 15 * strong_claims + 20 * instructions + 12 * governance + CASE WHEN technical > {s.technical_most} THEN 10 ELSE 0 END + CASE WHEN forbidden_title THEN 10 ELSE 0 END + CASE WHEN limitation_run > {s.limitation_run} THEN 8 ELSE 0 END
      + CASE WHEN limitation_share > {s.limitation_share} THEN 10 ELSE 0 END)) AS BIGINT) AS score FROM m)
    SELECT * EXCLUDE (lang), defensive <= {limit(0)} AND disclaimers = 0 AND empty_watch = 0 AND hedge_run <= {s.hedge_run} AND NOT generic_title AND NOT generic_ending AND strong_claims = 0 AND instructions = 0 AND governance = 0 AND technical <= {s.technical_most}
      AND NOT forbidden_title AND limitation_run <= {s.limitation_run} AND limitation_share <= {s.limitation_share} AND score >= {limit(1)} AS passed FROM k"""


@query("q1_directness", _style_sql(_STYLE))
def q1(spark, d):
    """All measures of an editorial style whose tables are for several languages, its score and whether each document passes; editions are the languages here."""
    titled = docs(spark, d).select("doc_id", "text", "lang", F.concat(F.lit("report "), "source").alias("title"))
    return style_report(titled, _STYLE, "doc_id", "text", "title", "lang")



@query(
    "q7_ranking_check",
    """WITH r AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY round(z_momentum20, 9) DESC, code) AS r, count(*) OVER (PARTITION BY date) AS n FROM zs),
    f AS (SELECT date, CASE WHEN code = 'Brand#14' AND month(date) % 2 = 0 THEN 'Brand#15' ELSE code END AS code, r + CASE WHEN code = 'Brand#13' AND day(date) > 20 THEN 1 ELSE 0 END AS rank,
      round(100 * (1 - (r - 1) / greatest(1, n - 1)), 6) + CASE WHEN code = 'Brand#12' AND day(date) < 8 THEN 200 ELSE 0 END AS score FROM r),
    g AS (SELECT *, score > lag(score) OVER (PARTITION BY date ORDER BY rank, code) AS rise FROM f)
    SELECT date, list_filter([CASE WHEN NOT (count(DISTINCT rank) = count(*) AND min(rank) = 1 AND max(rank) = count(*)) THEN 'ranks' END, CASE WHEN NOT bool_and(score BETWEEN 0 AND 100) THEN 'range' END, CASE WHEN coalesce(bool_or(rise), false) THEN 'order' END,
      CASE WHEN count(DISTINCT code) < count(*) THEN 'code' END], lambda x: x IS NOT NULL) AS faults FROM g GROUP BY 1""",
    "zs",
)
def q7(spark, d):
    """What is wrong with each date's ranking: ranks, range and order of scores, repeated codes. Some of each are wrong on purpose."""
    rows = z_scores(spark, d).withColumn("r", F.row_number().over(X.cross().orderBy(F.desc(F.round("z_momentum20", 9)), "code"))).withColumn("n", F.count("*").over(X.cross()))
    score = F.round(100 * (1 - (c("r") - 1) / F.greatest(F.lit(1), c("n") - 1)), 6) + F.when((c("code") == "Brand#12") & (F.day("date") < 8), 200).otherwise(0)
    rank = c("r") + F.when((c("code") == "Brand#13") & (F.day("date") > 20), 1).otherwise(0)
    code = F.when((c("code") == "Brand#14") & (F.month("date") % 2 == 0), "Brand#15").otherwise(c("code"))
    return K.ranking_faults(rows.select("date", rank.alias("rank"), score.alias("score"), code.alias("code")), "date", "rank", "score", ["code"])


@query(
    "q8_chart_dates",
    """WITH n AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM panel), p AS (SELECT code, date, 2 * k + CASE WHEN k % 40 = 0 AND code < 'Brand#3' THEN 3 ELSE 0 END AS place FROM n WHERE code <> 'Brand#35' OR date < (SELECT max(date) FROM panel)),
    l AS (SELECT *, date <= lag(date) OVER (PARTITION BY code ORDER BY place) AS bad FROM p)
    SELECT code, list_filter([CASE WHEN coalesce(bool_or(bad), false) THEN 'ascending' END, CASE WHEN arg_max(date, place) IS DISTINCT FROM (SELECT max(date) FROM panel) THEN 'as-of' END], lambda x: x IS NOT NULL) AS faults FROM l GROUP BY 1""",
    "panel",
)
def q8(spark, d):
    """Charts whose points aren't in the order of their dates, or don't reach the newest date. Some are wrong on purpose."""
    panel = P.brand_panel(spark, d)
    newest = panel.agg(F.max("date").alias("newest"))
    rows = panel.withColumn("k", F.row_number().over(X.series())).join(F.broadcast(newest), F.lit(True)).filter((c("code") != "Brand#35") | (c("date") < c("newest")))  # one row
    place = 2 * c("k") + F.when((c("k") % 40 == 0) & (c("code") < "Brand#3"), 3).otherwise(0)
    return K.chart_faults(rows.select("code", "date", place.alias("place")), "code", "place", "date", newest)


@query("q10_distribution", "SELECT count(*) AS n, min(len(role)) AS least, max(len(role)) AS most, round(avg(len(role)), 6) AS mean FROM conversations")
def q10(spark, d):
    n = F.length("role")
    return table(spark, d, "conversations").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


@query("q11_unique_entries", "SELECT model, horizon, count(*) AS n, count(*) > 1 AS repeated, min(p) < 0.2 OR max(p) > 0.8 AS out_of_range FROM (SELECT model, horizon, round(p, 9) AS p FROM pred) GROUP BY 1, 2", "pred")
def q11(spark, d):
    rows = predictions(spark, d).select("model", "horizon", F.round("p", 9).alias("p"))
    return rows.groupBy("model", "horizon").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("repeated"), ((F.min("p") < 0.2) | (F.max("p") > 0.8)).alias("out_of_range"))


@query(
    "q12_fact_direction",
    "SELECT date, code, (ret > 0 AND code < 'Brand#2') OR (ret < 0 AND code >= 'Brand#2') OR ret = 0 AS agrees, round(100 * ret, 2) + 0.0 AS change FROM raw WHERE ret IS NOT NULL",
    "raw",
)
def q12(spark, d):
    rows = P.brand_panel(spark, d).select("date", "code", X.change("close", 1).alias("ret")).filter("ret is not null")
    text = F.when(c("code") < "Brand#2", "the price rose").otherwise("the price fell")
    agrees = (c("ret") == 0) | (text.rlike("rose|gained") & (c("ret") > 0)) | (text.rlike("fell|declined") & (c("ret") < 0))
    return rows.select("date", "code", agrees.alias("agrees"), (F.round(100 * c("ret"), 2) + F.lit(0.0)).alias("change"))


@query("q13_fact_sentence", "SELECT c_custkey, c_name || CASE WHEN c_acctbal > 0 THEN ' is owed ' WHEN c_acctbal < 0 THEN ' owes ' ELSE ' has ' END || printf('%.1f', abs(round(c_acctbal, 1))) || '.' AS sentence FROM customer")
def q13(spark, d):
    verb = F.when(c("c_acctbal") > 0, " is owed ").when(c("c_acctbal") < 0, " owes ").otherwise(" has ")
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", verb, F.format_string("%.1f", F.abs(F.round("c_acctbal", 1))), F.lit(".")).alias("sentence"))


@query("q14_known_sources", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN 'verified' ELSE 'unverified' END AS status FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def q14(spark, d):
    known = table(spark, d, "nation").filter("n_regionkey < 3")
    rows = table(spark, d, "supplier").join(known, c("s_nationkey") == c("n_nationkey"), "left_semi")
    return rows.select("s_suppkey", F.when(c("s_acctbal") >= 0, "verified").otherwise("unverified").alias("status"))


@query("q15_kebab_names", "SELECT DISTINCT p_type, lower(regexp_replace(replace(p_type, ' ', ''), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS id FROM part")
def q15(spark, d):
    name = F.lower(F.regexp_replace(F.replace("p_type", F.lit(" "), F.lit("")), "([a-z0-9])([A-Z])", "$1-$2"))
    return table(spark, d, "part").select("p_type", name.alias("id")).distinct()


@query(
    "q18_relevance",
    """WITH w AS (SELECT doc_id, contains(lower(text), 'worthless') OR contains(lower(text), 'secret') AS direct, regexp_matches(lower(text), 'token|http|license') AS topic, lang IN ('en', 'de') AND regexp_matches(lower(text), 'und|the') AS market, source IS NOT NULL AND n_chars > 3000 AS high FROM documents)
    SELECT doc_id, 8 * CAST(coalesce(direct, false) AS INTEGER) + 3 * CAST(coalesce(topic, false) AS INTEGER) + CAST(coalesce(market, false) AS INTEGER) + CASE WHEN high THEN 0.25 ELSE 0 END AS score FROM w
    WHERE coalesce(direct, false) OR coalesce(topic, false) OR coalesce(market, false) ORDER BY score DESC, doc_id LIMIT 8""",
)
def q18(spark, d):
    """The eight most relevant documents (the feature's own limit): 8 for a word of their own, 3 for the topic, 1 for the market, a quarter for priority; what matches nothing isn't there."""
    text, no = F.lower("text"), F.lit(False)
    direct, topic = F.coalesce(text.contains("worthless") | text.contains("secret"), no), F.coalesce(text.rlike("token|http|license"), no)
    market = F.coalesce(c("lang").isin("en", "de") & text.rlike("und|the"), no)
    score = 8 * direct.cast("int") + 3 * topic.cast("int") + market.cast("int") + F.when(c("source").isNotNull() & (c("n_chars") > 3000), 0.25).otherwise(0.0)
    return docs(spark, d).filter(direct | topic | market).select("doc_id", score.cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(8)



@query("q19_index_reconciliation", "SELECT c_custkey AS id, 'without-rows' AS fault FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'not-in-index' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def q19(spark, d):
    index, rows = table(spark, d, "customer").select(c("c_custkey").alias("id")), table(spark, d, "orders").select(c("o_custkey").alias("id")).distinct()
    known = index.filter(c("id") % 10 != 0)
    return index.join(rows, "id", "left_anti").withColumn("fault", F.lit("without-rows")).unionByName(rows.join(known, "id", "left_anti").withColumn("fault", F.lit("not-in-index")))


@query("q20_merged_rows", "SELECT l_orderkey AS id, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY 1")
def q20(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("id")).agg((F.countDistinct("l_returnflag") > 1).alias("conflict"))


@query("q21_target_catalog", "SELECT n_name AS target, 'derived' AS kind FROM nation UNION ALL SELECT r_name, 'fixed' FROM region")
def q21(spark, d):
    derived = table(spark, d, "nation").select(c("n_name").alias("target"), F.lit("derived").alias("kind"))
    return derived.unionByName(table(spark, d, "region").select(c("r_name").alias("target"), F.lit("fixed").alias("kind")))


@query("q22_new_contents", "WITH o AS (SELECT text FROM documents WHERE doc_id % 2 = 0) SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM o WHERE text IS NOT NULL) GROUP BY text")
def q22(spark, d):
    rows = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))
    fresh = rows.filter("doc_id % 2 = 1").join(rows.filter("doc_id % 2 = 0").select("hash"), "hash", "left_anti")
    return fresh.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("q23_links", "SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[A-Za-z0-9./_-]+'))) AS n FROM pages")
def q23(spark, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit("https?://[A-Za-z0-9./_-]+"), F.lit(0)))
    return table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n"))


@query("q24_panel_descriptor", "SELECT count(*) AS rows, count(DISTINCT date) AS sessions, count(DISTINCT code) AS objects, count(*) = count(DISTINCT (date, code)) AS unique_keys, min(date) AS first, max(date) AS last FROM panel", "panel")
def q24(spark, d):
    return P.brand_panel(spark, d).agg(F.count("*").alias("rows"), F.countDistinct("date").alias("sessions"), F.countDistinct("code").alias("objects"), (F.count("*") == F.countDistinct("date", "code")).alias("unique_keys"), F.min("date").alias("first"), F.max("date").alias("last"))


_EVENT = "list_filter([CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'authority' END, CASE WHEN value < 1 THEN 'value' END, CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'statement-in-force' END], lambda x: x IS NOT NULL)"


_FACTS = """SELECT event_id AS row_id, CASE WHEN event_id % 31 <> 0 THEN 'e' || event_id END AS event_id, CASE WHEN event_id % 29 <> 0 THEN 'i' || user_id % 12 END AS issuer, CASE event_type WHEN 'view' THEN 'central' WHEN 'click' THEN 'ministry' WHEN 'purchase' THEN 'exchange' WHEN 'signup' THEN 'unofficial' ELSE 'registry' END AS authority,
    CASE event_type WHEN 'click' THEN 'meeting_statement' WHEN 'signup' THEN NULL ELSE 'notice' END AS document_type, CASE WHEN event_id % 23 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS published, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '2024/01/01' ELSE strftime(ts, '%Y-%m-%d') END AS effective,
    list_extract(['not_applicable', 'meeting_statement', 'draft', 'published', 'effective', 'implemented', 'under_implementation', 'suspended', 'unknown', 'done'], CAST(event_id % 10 AS INTEGER) + 1) AS stage, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'ftp://x' ELSE 'https://x' END AS url,
    event_id % 13 <> 0 AS threads, CASE WHEN event_id % 3 = 0 THEN 'bootstrap' ELSE 'live' END AS status, event_type FROM events"""


def _records(spark, d):
    """Contract records made of the events, with faults of every kind."""
    k = c("event_id")
    names = ["not_applicable", "meeting_statement", "draft", "published", "effective", "implemented", "under_implementation", "suspended", "unknown", "done"]
    of_type = lambda **to: F.coalesce(*[F.when(c("event_type") == t, v) for t, v in to.items()])
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, d, "events").select(
        k.alias("row_id"), F.when(k % 31 != 0, F.concat(F.lit("e"), k.cast("string"))).alias("event_id"), F.when(k % 29 != 0, F.concat(F.lit("i"), (c("user_id") % 12).cast("string"))).alias("issuer"),
        F.coalesce(of_type(view="central", click="ministry", purchase="exchange", signup="unofficial"), F.lit("registry")).alias("authority"), F.when(c("event_type") == "click", "meeting_statement").when(c("event_type") != "signup", "notice").alias("document_type"),
        F.when(k % 23 == 0, "soon").otherwise(day).alias("published"), F.when(k % 5 == 0, F.lit(None)).when(k % 19 == 0, "2024/01/01").otherwise(day).alias("effective"), F.element_at(F.array(*map(F.lit, names)), (k % 10 + 1).cast("int")).alias("stage"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 17 == 0, "ftp://x").otherwise("https://x").alias("url"), F.when(k % 13 != 0, F.array(F.lit("t"))).alias("threads"), F.when(k % 3 == 0, "bootstrap").otherwise("live").alias("status"), "event_type",
    )


@query(
    "q25_event_contract",
    f"""WITH r AS ({_FACTS}), k AS (SELECT DISTINCT 'i' || user_id % 12 AS issuer, true AS known FROM events WHERE user_id % 12 < 9)
    SELECT row_id, list_filter([CASE WHEN event_id IS NULL THEN 'event-id' END, CASE WHEN issuer IS NULL THEN 'issuer' END, CASE WHEN authority = 'unofficial' THEN 'authority' END, CASE WHEN document_type IS NULL THEN 'document-type' END, CASE WHEN published = 'soon' THEN 'published' END,
      CASE WHEN effective LIKE '%/%' THEN 'effective' END, CASE WHEN stage = 'done' THEN 'stage' END, CASE WHEN url LIKE 'ftp%' THEN 'url' END, CASE WHEN NOT threads THEN 'threads' END, CASE WHEN document_type = 'meeting_statement' AND stage IN ('effective', 'implemented') THEN 'statement-in-force' END,
      CASE WHEN status <> 'bootstrap' AND known IS NULL THEN 'unregistered' END], lambda x: x IS NOT NULL) AS faults FROM r LEFT JOIN k USING (issuer)""",
)
def q25(spark, d):
    """Policy events against the rules of their contract and the registry of issuers."""
    registry = table(spark, d, "events").filter(c("user_id") % 12 < 9).select(F.concat(F.lit("i"), (c("user_id") % 12).cast("string")).alias("issuer"))
    return K.policy_event_faults(_records(spark, d), registry).select("row_id", "faults")


@query(
    "q26_capital_contract",
    f"""WITH r AS ({_FACTS}) SELECT row_id, list_filter([CASE WHEN event_id IS NULL THEN 'event-id' END, CASE WHEN row_id % 11 = 0 AND row_id % 4 <> 0 THEN 'subjects' END, CASE WHEN event_type = 'error' THEN 'evidence' END, CASE WHEN NOT threads THEN 'threads' END,
      CASE WHEN row_id % 6 = 0 AND row_id % 9 = 0 THEN 'payment-as-capital' END, CASE WHEN event_type = 'view' AND url IS NULL THEN 'official-without-url' END], lambda x: x IS NOT NULL) AS faults FROM r""",
)
def q26_capital(spark, d):
    """State-capital events against the rules of their contract."""
    k = c("row_id")
    evidence = F.when(c("event_type") == "view", "official_confirmed").when(c("event_type") == "click", "reliable_report").when(c("event_type") == "purchase", "market_inference").when(c("event_type") == "signup", "no_event_claimed").otherwise("rumour")
    note = F.concat_ws(" ", F.when(k % 6 == 0, "medical payment system"), F.when(k % 9 == 0, "state-capital funds"))
    events = _records(spark, d).select("row_id", "event_id", F.when(k % 11 != 0, F.array(F.lit("s"))).alias("subjects"), F.when(k % 4 == 0, F.array(F.lit("x"))).alias("scope"), evidence.alias("evidence"), "threads", "url", note.alias("note"))
    return K.capital_event_faults(events, "(?i)medical|payment system", "(?i)state.?capital").select("row_id", "faults")



@query(
    "q27_packet_status",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'invalid' WHEN day > '2024-01-15' THEN 'future' WHEN day <> '2024-01-15' THEN 'stale' WHEN event_type = 'error' THEN 'partial' WHEN event_type = 'signup' THEN 'unavailable' ELSE 'valid' END AS status
    FROM (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events)""",
)
def q27(spark, d):
    k = c("event_id")
    date = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 7 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    raw = F.when(k % 11 == 0, F.lit(None).cast("string")).when(c("event_type") == "error", "partial").when(c("event_type") == "signup", "unavailable").otherwise("ok")
    return table(spark, d, "events").select("event_id", K.packet_status(date, F.lit("2024-01-15"), raw).alias("status"))


@query("q29_common_session", "WITH m AS (SELECT code, max(date) AS newest FROM flags GROUP BY 1) SELECT min(newest) AS common, max(newest) AS newest FROM m", "flags")
def q29(spark, d):
    return P.flag_panel(spark, d).groupBy("code").agg(F.max("date").alias("newest")).agg(F.min("newest").alias("common"), F.max("newest").alias("newest"))


@query("q30_tier_counts", "SELECT o_orderpriority AS tier, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1")
def q30(spark, d):
    return table(spark, d, "orders").groupBy(c("o_orderpriority").alias("tier")).agg(F.count_if(c("o_orderstatus") == "F").alias("closed"), F.count_if(c("o_orderstatus") != "F").alias("open"))


@query(
    "q31_previous_curve",
    "WITH n AS (SELECT max(date) AS d FROM flags), p AS (SELECT max(date) AS d FROM flags, n WHERE date <> n.d) SELECT code, max(close) FILTER (date = n.d) AS current, max(close) FILTER (date = p.d) AS previous FROM flags, n, p WHERE date IN (n.d, p.d) GROUP BY 1",
    "flags",
)
def q31(spark, d):
    flags = P.flag_panel(spark, d)
    turn = F.dense_rank().over(Window.orderBy(F.desc("date")))
    newest = F.broadcast(flags.select("date").distinct().withColumn("turn", turn).filter("turn <= 2"))  # one row per session before the filter
    at = lambda n: F.max(F.when(c("turn") == n, c("close")))
    return flags.join(newest, "date").groupBy("code").agg(at(1).alias("current"), at(2).alias("previous"))


@query("q32_breakeven", "SELECT a.date, round(a.close - n.close, 2) + 0.0 AS breakeven FROM flags a JOIN flags n ON a.date = n.date WHERE a.code = 'A' AND n.code = 'N'", "flags")
def q32(spark, d):
    flags = P.flag_panel(spark, d)
    real = flags.filter("code = 'N'").select("date", c("close").alias("real"))
    return flags.filter("code = 'A'").join(real, "date").select("date", (F.round(c("close") - c("real"), 2) + F.lit(0.0)).alias("breakeven"))


@query("r2_source_status", "SELECT n_nationkey, CASE WHEN n >= 60 THEN 'ready' WHEN n > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def r2(spark, d):
    counts = table(spark, d, "customer").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", B.source_status(F.coalesce("n", F.lit(0)), 60).alias("status"))


@query(
    "r3_source_validation",
    "WITH b AS (SELECT *, lag(date) OVER (PARTITION BY code ORDER BY sequence) AS before FROM rawbars) SELECT code, count(*) FILTER (date = 'n/a') AS invalid, count(*) - count(DISTINCT date) AS duplicate, count(*) FILTER (date < before) AS unordered FROM b GROUP BY 1",
    "rawbars",
)
def r3(spark, d):
    marked = raw_bars(spark, d).withColumn("before", F.lag("date").over(Window.partitionBy("code").orderBy("sequence")))
    return marked.groupBy("code").agg(F.count_if(c("date") == "n/a").alias("invalid"), (F.count("*") - F.countDistinct("date")).alias("duplicate"), F.count_if(c("date") < c("before")).alias("unordered"))


@query("r4_date_range", "SELECT code, min(date) AS first, max(date) AS last FROM prio GROUP BY 1", "prio")
def r4(spark, d):
    return P.priority_panel(spark, d).groupBy("code").agg(F.min("date").alias("first"), F.max("date").alias("last"))


@query("r8_model_status", "SELECT code, CASE WHEN count(DISTINCT year(date)) >= 3 AND count(*) >= 100 THEN 'trained' WHEN count(*) > 0 THEN 'insufficient_data' END AS availability FROM panel GROUP BY 1", "panel")
def r8(spark, d):
    each = P.brand_panel(spark, d).groupBy("code").agg(F.countDistinct(F.year("date")).alias("windows"), F.count("*").alias("n"))
    return each.select("code", F.when((c("windows") >= 3) & (c("n") >= 100), "trained").when(c("n") > 0, "insufficient_data").otherwise("not_trained").alias("availability"))


@query(
    "r10_blended_probability",
    "WITH b AS (SELECT *, avg(y) OVER (PARTITION BY horizon) AS base FROM scored) SELECT date, code, horizon, round(least(0.98, greatest(0.02, base + CASE horizon WHEN 1 THEN 1.0 WHEN 5 THEN 0.35 ELSE 0.0 END * (p - base))), 6) AS p FROM b",
    "scored",
)
def r10(spark, d):
    weight = F.when(c("horizon") == 1, 1.0).when(c("horizon") == 5, 0.35).otherwise(0.0)  # fixed weights of the three tiers
    rates = F.broadcast(scored(spark, d).groupBy("horizon").agg(F.avg("y").alias("base")))  # three rows
    return scored(spark, d).join(rates, "horizon").select("date", "code", "horizon", F.round(S.clamp(c("base") + weight * (c("p") - c("base")), 0.02, 0.98), 6).alias("p"))


_BINS = "bins AS (SELECT horizon, least(floor(p * 10), 9) AS bin, round(avg(p), 9) AS mean, avg(y) AS rate, count(*) AS n FROM scored GROUP BY 1, 2), wil AS (SELECT *, (rate + 1.6449 ** 2 / (2 * n)) / (1 + 1.6449 ** 2 / n) AS mid, 1.6449 * sqrt(rate * (1 - rate) / n + 1.6449 ** 2 / (4 * n * n)) / (1 + 1.6449 ** 2 / n) AS half FROM bins)"


@query(
    "r11_calibration_range",
    f"WITH {_BINS}, q AS (SELECT x / 20.0 AS p FROM range(21) t(x)) SELECT p, horizon, round(greatest(0, least(p, arg_min(mid - half, (round(abs(mean - p), 9), bin)))), 6) AS low, round(least(1, greatest(p, arg_min(mid + half, (round(abs(mean - p), 9), bin)))), 6) AS high FROM q, wil GROUP BY 1, 2",
    "scored",
)
def r11(spark, d):
    z = 1.6449
    rows = scored(spark, d).withColumn("bin", F.least(F.floor(c("p") * 10), F.lit(9)))
    bins = rows.groupBy("horizon", "bin").agg(F.round(F.avg("p"), 9).alias("mean"), F.avg("y").alias("rate"), F.count("*").alias("n"))
    mid = (c("rate") + z * z / (2 * c("n"))) / (1 + z * z / c("n"))
    half = z * F.sqrt(c("rate") * (1 - c("rate")) / c("n") + z * z / (4 * c("n") * c("n"))) / (1 + z * z / c("n"))
    asked = F.explode(F.array(*[F.lit(i / 20) for i in range(21)])).alias("q")
    each = bins.select("horizon", "bin", "mean", (mid - half).alias("low"), (mid + half).alias("high"), asked)  # ten bins a horizon
    near = each.groupBy("horizon", "q").agg(F.min_by(F.struct("low", "high"), F.struct(F.round(F.abs(c("mean") - c("q")), 9), "bin")).alias("b"))
    return near.select(c("q").alias("p"), "horizon", F.round(F.greatest(F.lit(0.0), F.least("q", "b.low")), 6).alias("low"), F.round(F.least(F.lit(1.0), F.greatest("q", "b.high")), 6).alias("high"))


@query("r16_close_tolerance", "SELECT a.date, abs(a.close / b.close - 1) <= 0.001 AS within FROM flags a JOIN bench b USING (date) WHERE a.code = 'N'", "flags", "bench")
def r16(spark, d):
    official = P.benchmark(spark, d).select("date", c("close").alias("official"))
    return P.flag_panel(spark, d).filter("code = 'N'").join(official, "date").select("date", (F.abs(c("close") / c("official") - 1) <= 0.001).alias("within"))


@query("r18_history_health", "SELECT code, max(date) AS last, count(*) AS rows, round(count(*) / (SELECT count(*) FROM bench), 6) AS coverage FROM panel GROUP BY 1", "panel", "bench")
def r18(spark, d):
    sessions = P.benchmark(spark, d).agg(F.count("*").alias("all"), F.lit(1).alias("k"))
    each = P.brand_panel(spark, d).groupBy("code").agg(F.max("date").alias("last"), F.count("*").alias("rows"), F.lit(1).alias("k"))
    return each.join(F.broadcast(sessions), "k").select("code", "last", "rows", F.round(c("rows") / c("all"), 6).alias("coverage"))


@query("r20_realized_returns", "SELECT a.code, round(b.close / a.close - 1, 6) AS ret, round(q.close / p.close - 1, 6) AS bench FROM flags a JOIN flags b ON a.code = b.code JOIN bench p ON p.date = a.date JOIN bench q ON q.date = b.date WHERE a.date = DATE '1996-01-01' AND b.date = DATE '1998-01-05'", "flags", "bench")
def r20(spark, d):
    at = lambda rows, day, name: rows.filter(c("date") == F.lit(day).cast("date")).select(*[x for x in ("code",) if x in rows.columns], c("close").alias(name), F.lit(1).alias("k"))
    flags, bench = P.flag_panel(spark, d), P.benchmark(spark, d)
    real = at(bench, "1996-01-01", "p").join(at(bench, "1998-01-05", "q"), "k")
    return at(flags, "1996-01-01", "a").join(at(flags, "1998-01-05", "b").drop("k"), "code").join(real, "k").select("code", F.round(c("b") / c("a") - 1, 6).alias("ret"), F.round(c("q") / c("p") - 1, 6).alias("bench"))


@query("r21_legacy_evaluation", "SELECT prediction_id, CASE WHEN abs(100 * round(p, 9) - 50) <= 1 THEN 'near_neutral' WHEN (p > 0.5) = (y = 1) THEN 'correct' ELSE 'wrong' END AS result FROM pred WHERE status = 'legacy'", "pred")
def r21(spark, d):
    result = F.when(F.abs(100 * F.round("p", 9) - 50) <= 1, "near_neutral").when((c("p") > 0.5) == (c("y") == 1), "correct").otherwise("wrong")
    return predictions(spark, d).filter("status = 'legacy'").select("prediction_id", result.alias("result"))


@query("r22_public_summary", "SELECT status = 'legacy' AS legacy, count(*) AS n, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong FROM outc GROUP BY 1", "outc")
def r22(spark, d):
    return outcomes(spark, d).groupBy((c("status") == "legacy").alias("legacy")).agg(F.count("*").alias("n"), F.count_if(c("outcome") == "correct").alias("correct"), F.count_if(c("outcome") == "wrong").alias("wrong"))


@query("r24_event_ids", "SELECT prediction_id, 'evaluation-' || substr(sha256(prediction_id || chr(31) || outcome), 1, 12) AS id FROM outc", "outc")
def r24(spark, d):
    return outcomes(spark, d).select("prediction_id", S.digest_id("evaluation", c("prediction_id"), c("outcome")).alias("id"))


@query(
    "r26_ledger_verification",
    """WITH p AS (SELECT *, strftime(prediction_date, '%Y-%m') AS month FROM pred), lost AS (SELECT DISTINCT month, code FROM p WHERE code = 'Brand#15' AND month LIKE '%-05'), kept AS (SELECT p.* FROM p ANTI JOIN lost USING (month, code))
    SELECT 'row' AS kind, month, code, prediction_id AS id, 'altered' AS fault FROM kept WHERE code = 'Brand#14' AND horizon = 1 AND month LIKE '%-02'
    UNION ALL SELECT 'row', month, code, prediction_id, 'missing' FROM kept WHERE code = 'Brand#13' AND horizon = 20 AND month LIKE '%-03'
    UNION ALL SELECT 'row', month, code, prediction_id || '|x', 'unknown' FROM kept WHERE code = 'Brand#21' AND horizon = 5 AND month LIKE '%-04'
    UNION ALL SELECT 'row', month, code, NULL, 'lost-shard' FROM lost
    UNION ALL SELECT DISTINCT 'manifest 1', month, NULL, NULL, 'false-count' FROM p WHERE month LIKE '%-07'
    UNION ALL SELECT DISTINCT 'manifest 0', month, code, NULL, 'unlisted' FROM p WHERE month LIKE '%-08' AND code = 'Brand#22'""",
    "pred",
)
def r26(spark, d):
    """What is wrong in a ledger and its manifest, against rows that are derived again: found by chained digests of rows, shards, months and the whole."""
    levels = [["month", "code"], ["month"], []]
    rows = predictions(spark, d).withColumn("month", F.date_format("prediction_date", "yyyy-MM")).withColumn("p", F.round("p", 6))
    content = ["prediction_id", "prediction_date", "code", "horizon", "status", "model", "p"]
    again = cut(CH.with_digest(rows, content).select("month", *content, "row_digest"))
    of = lambda code, month, horizon: (c("code") == code) & c("month").endswith(month) & (c("horizon") == horizon)
    kept = again.filter(~((c("code") == "Brand#15") & c("month").endswith("-05")) & ~of("Brand#13", "-03", 20))
    changed = kept.withColumn("p", F.when(of("Brand#14", "-02", 1), c("p") + 0.5).otherwise(c("p")))
    stored = changed.unionByName(kept.filter(of("Brand#21", "-04", 5)).withColumn("prediction_id", F.concat("prediction_id", F.lit("|x"))))
    stored = cut(CH.with_digest(stored, content))
    derived = CH.level_digests(again, levels)
    claimed = [derived[0].filter(~(c("month").endswith("-08") & (c("code") == "Brand#22"))), derived[1].withColumn("n", c("n") + F.when(c("month").endswith("-07"), 1).otherwise(0)), derived[2]]
    found = CH.row_faults(stored, again, "prediction_id", levels).select(F.lit("row").alias("kind"), "month", "code", c("prediction_id").alias("id"), "fault")
    false = CH.manifest_faults(claimed, derived, levels).select(F.concat(F.lit("manifest "), c("level").cast("string")).alias("kind"), "month", "code", F.lit(None).cast("string").alias("id"), "fault")
    return found.unionByName(false)


@query("r27_unique_states", "SELECT DISTINCT code, horizon, status FROM pred WHERE status <> 'published'", "pred")
def r27(spark, d):
    return predictions(spark, d).filter("status <> 'published'").select("code", "horizon", "status").distinct()


@query("r31_candidate_summary", "SELECT model, round(avg(brier), 6) AS brier, count(*) AS horizons FROM (SELECT model, horizon, avg((p - y) ** 2) AS brier FROM pred GROUP BY 1, 2) GROUP BY 1", "pred")
def r31(spark, d):
    from tidepanel.operators import metrics as E

    return E.brier(predictions(spark, d), ["model", "horizon"]).groupBy("model").agg(F.round(F.avg("brier"), 6).alias("brier"), F.count("*").alias("horizons"))


@query("r32_context_window", "SELECT o_orderpriority AS kind, o_orderkey, CASE WHEN t <= 3 THEN 'full' ELSE 'summary' END AS form FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS t FROM orders) WHERE t <= 7")
def r32(spark, d):
    turn = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("t", turn).filter("t <= 7").select(c("o_orderpriority").alias("kind"), "o_orderkey", F.when(c("t") <= 3, "full").otherwise("summary").alias("form"))


@query("r35_week_inclusion", "SELECT o_orderkey, isodow(o_orderdate) <> 6 AS included FROM orders")
def r35(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.dayofweek("o_orderdate") != 7).alias("included"))


@query("r38_sector_history", "SELECT horizon, arg_max(prediction_id, prediction_date) AS prediction_id FROM pred WHERE code = 'Brand#11' GROUP BY 1", "pred")
def r38(spark, d):
    return predictions(spark, d).filter("code = 'Brand#11'").groupBy("horizon").agg(F.max_by("prediction_id", "prediction_date").alias("prediction_id"))


@query("r39_bar_faults", "WITH b AS (SELECT sequence, code, date, open, high, low, close, lag(date) OVER (PARTITION BY code ORDER BY sequence) AS before FROM rawbars) SELECT sequence, CASE WHEN NOT coalesce(least(open, high, low, close) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high) AND high IS NOT NULL, false) THEN 'ohlc' ELSE 'order' END AS fault FROM b WHERE NOT coalesce(least(open, high, low, close) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high) AND high IS NOT NULL, false) OR date <= before", "rawbars")
def r39(spark, d):
    return B.bar_faults(raw_bars(spark, d), ["code"]).select("sequence", "fault")


@query(
    "m31_evidence_state",
    """WITH b AS (SELECT o_custkey AS obs, CASE WHEN o_orderkey % 9 = 0 THEN 'contradicts' ELSE 'supports' END AS rel, ['signal', 'press', 'signal', 'official'][CAST(o_orderkey % 31 % 4 AS INTEGER) + 1] AS cls, o_orderpriority AS pub FROM orders)
    SELECT obs AS observation, CASE WHEN count(*) FILTER (rel = 'contradicts' AND cls IN ('official', 'press')) > 0 THEN 'conflicting' WHEN count(*) FILTER (rel = 'supports' AND cls = 'official') > 0 THEN 'confirmed' WHEN count(DISTINCT pub) FILTER (rel = 'supports' AND cls <> 'signal') >= 2 THEN 'corroborated'
    WHEN count(*) FILTER (rel = 'supports') > 0 AND count(*) FILTER (rel = 'supports') = count(*) FILTER (rel = 'supports' AND cls = 'signal') THEN 'unverified' ELSE 'single-source' END AS state FROM b GROUP BY 1""",
)
def m31(spark, d):
    k = c("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("signal", "press", "signal", "official"))), (k % 31 % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select(c("o_custkey").alias("observation"), F.when(k % 9 == 0, "contradicts").otherwise("supports").alias("relation"), kind.alias("source_class"), c("o_orderpriority").alias("publisher"), F.lit(None).cast("string").alias("cluster"))
    return K.evidence_state(rows)


@query(
    "m32_duplicate_clusters",
    """WITH x AS (SELECT doc_id, source || (n_chars % 50) AS url, text FROM documents), u AS (SELECT url, min(doc_id) AS canonical FROM x GROUP BY 1 HAVING count(*) > 1), r AS (SELECT * FROM x WHERE url NOT IN (SELECT url FROM u)),
    h AS (SELECT text, min(doc_id) AS canonical FROM r GROUP BY 1 HAVING count(*) > 1) SELECT 'exact-url' AS method, canonical, doc_id AS member FROM x JOIN u USING (url) UNION ALL SELECT 'content-hash', canonical, doc_id FROM r JOIN h ON h.text IS NOT DISTINCT FROM r.text""",
)
def m32(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat("source", (c("n_chars") % 50).cast("string")).alias("url"), "text")
    return K.duplicate_clusters(rows, "doc_id", "url", "text", ["doc_id"])


@query(
    "m33_report_availability",
    "SELECT o_orderkey, CASE WHEN isodow(o_orderdate) = 7 THEN 'no_report' WHEN o_orderkey % 10 = 0 THEN 'fallback' WHEN o_orderstatus = 'O' THEN 'degraded' WHEN o_orderkey % 3 = 0 THEN 'writer_only' ELSE 'normal' END AS quality FROM orders",
)
def m33(spark, d):
    k = c("o_orderkey")
    daily, review = F.when(c("o_orderstatus") == "O", "stale").otherwise("valid"), F.when(k % 3 == 0, "missing").otherwise("partial")
    quality = K.publication_quality(daily, review, F.when(k % 10 == 0, "failed").otherwise("succeeded"), F.dayofweek("o_orderdate") == 1)
    return table(spark, d, "orders").select("o_orderkey", quality.alias("quality"))


# Sources, order and merging


@query("s4_finite_rows", "SELECT count(*) AS n, round(sum(amount_ratio), 4) AS total FROM feat WHERE amount_ratio IS NOT NULL AND session >= 60", "feat")
def s4(spark, d):
    rows = X.trailing_features(P.brand_panel(spark, d)).filter("session >= 60").withColumn("v", S.finite(c("amount_ratio")))
    return rows.filter("v is not null").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("s5_price_maps", "SELECT f.date, f.code, f.close, b.close AS bench FROM flags f LEFT JOIN bench b ON b.date = f.date", "flags", "bench")
def s5(spark, d):
    return P.flag_panel(spark, d).select("date", "code", "close").join(P.benchmark(spark, d).select("date", c("close").alias("bench")), "date", "left")


@query("s11_quote_lines", "SELECT p_partkey, p_brand AS symbol, CAST(p_retailprice AS DOUBLE) AS price FROM part")
def s11(spark, d):
    line = F.concat(F.lit('v_x="'), "p_brand", F.lit("~"), c("p_retailprice").cast("string"), F.lit('";'))
    fields = F.split(F.regexp_extract("line", '="([^"]*)"', 1), "~")
    return table(spark, d, "part").select("p_partkey", line.alias("line")).select("p_partkey", F.get(fields, 0).alias("symbol"), F.get(fields, 1).try_cast("double").alias("price"))


@query("s17_result_documents", "SELECT c_nationkey AS nation, c_custkey AS id, c_name AS title FROM customer")
def s17(spark, d):
    item = F.to_json(F.struct(F.array(F.struct(c("c_custkey").alias("id"), c("c_name").alias("title"))).alias("results")))
    found = F.explode(F.from_json("raw", "results array<struct<id: long, title: string>>")["results"]).alias("r")
    return table(spark, d, "customer").select(c("c_nationkey").alias("nation"), item.alias("raw")).select("nation", found).select("nation", "r.id", "r.title")


@query("t1_stable_order", "SELECT date, code, row_number() OVER (ORDER BY date, code) AS place FROM panel", "panel")
def t1(spark, d):
    return G.placed(P.brand_panel(spark, d).select("date", "code"), [c("date").asc(), c("code").asc()], "place")


@query("t8_ranking_preview", "SELECT code, round(score, 6) AS score FROM scored WHERE horizon = 1 AND date = (SELECT max(date) FROM scored WHERE horizon = 1) ORDER BY round(score, 9) DESC, code LIMIT 3", "scored")
def t8(spark, d):
    rows = scored(spark, d).filter("horizon = 1")
    newest = F.broadcast(rows.agg(F.max("date").alias("date")))
    return rows.join(newest, "date").orderBy(F.desc(F.round("score", 9)), "code").limit(3).select("code", F.round("score", 6).alias("score"))


@query("t10_latest_records", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' ORDER BY CAST(ts AS DATE) DESC, event_id LIMIT 25")
def t10(spark, d):
    return table(spark, d, "events").filter(c("ts") <= F.lit("2024-01-20").cast("timestamp")).orderBy(F.desc(F.to_date("ts")), "event_id").limit(25).select("event_id")


@query("u3_merged_ledgers", "SELECT prediction_id, count(DISTINCT p) > 1 AS conflict FROM (SELECT prediction_id, round(p, 6) AS p FROM pred WHERE horizon <> 20 UNION ALL SELECT prediction_id, round(p, 6) + CASE WHEN code = 'Brand#11' THEN 1 ELSE 0 END FROM pred WHERE horizon <> 1) GROUP BY 1", "pred")
def u3(spark, d):
    p = predictions(spark, d).select("prediction_id", "code", "horizon", F.round("p", 6).alias("p"))
    left, right = p.filter("horizon <> 20"), p.filter("horizon <> 1").withColumn("p", c("p") + F.when(c("code") == "Brand#11", 1).otherwise(0))
    rows, conflicts = G.union_of_snapshots([left, right], "prediction_id", ["prediction_id", "p"])
    marked = conflicts.select("prediction_id", F.lit(True).alias("conflict"))
    return rows.select("prediction_id").join(marked, "prediction_id", "left").select("prediction_id", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query(
    "c45_changed_fields",
    """WITH l AS (SELECT *, '$.lines[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) || ']' AS spot FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o_orderkey, '$.order.total' AS path FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, '$.tags' FROM orders WHERE o_orderkey % 13 = 0
    UNION ALL SELECT o_orderkey, spot || '.flags.' || k FROM l, (VALUES ('r'), ('s')) v(k) WHERE l_partkey % 5 = 0
    UNION ALL SELECT o_orderkey, spot || '.note' FROM l WHERE l_partkey % 7 = 0
    UNION ALL SELECT o_orderkey, spot || '.qty' FROM l WHERE l_partkey % 11 = 0
    UNION ALL SELECT o_orderkey, '$.lines[' || n || '].' || k FROM n, (VALUES ('n'), ('more[0]'), ('more[1].x')) v(k) WHERE o_orderkey % 4 = 0""",
)
def c45(spark, d):
    """Where two versions of an order's document differ: changed, added and lost leaves at any depth, and values that became objects."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    whole = table(spark, d, "orders").join(lines, c("o_orderkey") == c("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    before = lambda x: F.to_json(F.struct(x["l_quantity"].alias("qty"), F.struct(x["l_returnflag"].alias("r"), x["l_linestatus"].alias("s")).alias("flags"), x["l_partkey"].alias("part")))

    def after(x):
        flags = F.when(x["l_partkey"] % 5 != 0, F.struct(x["l_returnflag"].alias("r"), x["l_linestatus"].alias("s")))
        note = F.when(x["l_partkey"] % 7 == 0, "new")
        qty = F.when(x["l_partkey"] % 11 == 0, F.to_json(F.struct(x["l_quantity"].alias("v")))).otherwise(x["l_quantity"].cast("string"))
        return F.concat(F.regexp_replace(F.to_json(F.struct(note.alias("note"), x["l_partkey"].alias("part"), flags.alias("flags"))), r"\}$", ""), F.lit(',"qty":'), qty, F.lit("}"))

    document = lambda order, items, more: F.concat(F.lit('{"order":'), F.to_json(order), F.lit(',"lines":['), F.array_join(items, ","), F.lit("]"), more, F.lit("}"))
    order = lambda total: F.struct(c("o_orderstatus").alias("status"), total.alias("total"))
    extra = F.transform("lines", after)
    grown = F.when(c("o_orderkey") % 4 == 0, F.array_append(extra, F.lit('{"n":99,"more":[1,{"x":null}]}'))).otherwise(extra)
    tags = F.when(c("o_orderkey") % 13 == 0, F.lit(',"tags":[]')).otherwise("")
    total = F.when(c("o_orderkey") % 3 == 0, c("o_totalprice") + 1).otherwise(c("o_totalprice"))
    old = whole.select("o_orderkey", document(order(c("o_totalprice")), F.transform("lines", before), F.lit("")).alias("doc"))
    new = whole.select("o_orderkey", document(order(total), grown, tags).alias("doc"))
    return leaf_changes(old, new, "o_orderkey", "doc").select("o_orderkey", "path")


@query("c45_changed_columns", "SELECT a.c_custkey, f.f AS path FROM customer a, (VALUES ('c_acctbal'), ('c_mktsegment')) f(f) WHERE (f = 'c_acctbal' AND a.c_custkey % 3 = 0) OR (f = 'c_mktsegment' AND a.c_custkey % 5 = 0)")
def c45_columns(spark, d):
    before = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    after = before.withColumn("c_acctbal", F.when(c("c_custkey") % 3 == 0, c("c_acctbal") + 1).otherwise(c("c_acctbal"))).withColumn("c_mktsegment", F.when(c("c_custkey") % 5 == 0, F.lit("NEW")).otherwise(c("c_mktsegment")))
    return G.changed_fields(before, after, "c_custkey")
