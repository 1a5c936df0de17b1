"""Trailing-window, cross-section and label queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators import features as X
from tidepanel.operators import labels as L
from tidepanel.operators import recurrence as R
from tidepanel.queries.registry import query
from tidepanel.session import cut
from tidepanel.sources import panel as P

HORIZONS = [1, 5, 20]


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def features(spark, d):
    return X.trailing_features(P.brand_panel(spark, d))


def stored_panel(spark, d):
    """The weekly bars of each brand, aggregated once: what follows reads them several times, and they are codes times weeks."""
    return cut(P.brand_panel(spark, d))


def z_scores(spark, d, panel=None):
    panel = stored_panel(spark, d) if panel is None else panel
    return X.cross_section(X.feature_rows(panel), X.universe_size(panel))


def labels(spark, d, horizons=HORIZONS, panel=None):
    panel = stored_panel(spark, d) if panel is None else panel
    return L.forward_labels(panel, cut(P.benchmark(spark, d)), X.universe_size(panel), horizons)


def composite():
    c = F.col
    return 0.32 * c("z_momentum5") + 0.26 * c("z_momentum20") + 0.18 * c("z_amount_ratio") + 0.12 * c("z_volume_ratio") - 0.12 * c("z_volatility20")


def scored(spark, d):
    """(date, code, horizon, score, p, y, excess, top_quartile, momentum20): a composite score against what came."""
    panel = stored_panel(spark, d)
    z = z_scores(spark, d, panel).select("date", "code", "momentum20", composite().alias("score"))
    z = z.withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    return z.join(labels(spark, d, panel=panel), ["date", "code"]).select("date", "code", "horizon", "score", "p", F.col("outperformed").alias("y"), "excess", "top_quartile", "momentum20")


def _feature(name: str, *columns: str, where: str = "session >= 60"):
    shown = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"SELECT date, code, {shown} FROM feat WHERE {where}", "feat")
    def run(spark, d):
        return features(spark, d).filter(where).select("date", "code", *r6(*columns))


_feature("f1_momentum", "momentum5", "momentum20", "momentum60")
_feature("f2_reversal", "reversal1", where="session >= 0")
_feature("f3_volatility20", "volatility20", where="session >= 0")
_feature("f4_drawdown60", "drawdown60", where="session >= 0")
_feature("f5_ratios", "amount_ratio", "volume_ratio", where="session >= 0")
_feature("f6_acceleration", "acceleration", where="session >= 0")


@query("f7_feature_rows", "SELECT date, code, " + ", ".join(f"round({c}, 6) AS {c}" for c in X.FEATURES) + " FROM rows_", "rows_")
def f7(spark, d):
    return X.feature_rows(P.brand_panel(spark, d)).select("date", "code", *r6(*X.FEATURES))


@query("f8_cross_section", "SELECT date, code, " + ", ".join(f"round(z_{c}, 6) AS z_{c}" for c in X.FEATURES) + " FROM zs", "zs")
def f8(spark, d):
    return z_scores(spark, d).select("date", "code", *r6(*[f"z_{c}" for c in X.FEATURES]))


@query(
    "f9_nonlinear",
    """SELECT date, code, round(z_momentum5 - z_momentum20, 6) AS momentum_acceleration, round(z_momentum20 - z_momentum60, 6) AS trend_acceleration, round(z_momentum5 * z_amount_ratio, 6) AS momentum5_amount,
    round(z_momentum20 * z_volume_ratio, 6) AS momentum20_volume, round(z_momentum20 * z_drawdown60, 6) AS trend_drawdown, round(z_reversal1 * z_volatility20, 6) AS reversal_volatility,
    round(z_momentum5 * z_momentum5, 6) AS momentum5_square, round(z_drawdown60 * z_drawdown60, 6) AS drawdown_square FROM zs""",
    "zs",
)
def f9(spark, d):
    return z_scores(spark, d).select("date", "code", *[F.round(term, 6).alias(name) for name, term in X.nonlinear_terms().items()])


@query("f10_complete_mean", "SELECT date, code, round(CASE WHEN count(*) OVER s = 5 THEN avg(close) OVER s END, 6) AS mean5 FROM hourly WINDOW s AS (PARTITION BY code ORDER BY date ROWS 4 PRECEDING)", "hourly")
def f10(spark, d):
    return P.event_panel(spark, d).select("date", "code", F.round(X.complete_mean("close", -4, 0), 6).alias("mean5"))


_PRICE = ["return1", "return5", "return20", "next1", "volatility20", "distance20", "distance60", "drawdown60"]
_PRICE_VIEW = """base AS (SELECT *, close / lag(close) OVER s - 1 AS return1 FROM {panel} WINDOW s AS (PARTITION BY code ORDER BY date)),
price AS (SELECT date, code, return1, close / lag(close, 5) OVER s - 1 AS return5, close / lag(close, 20) OVER s - 1 AS return20, lead(close) OVER s / close - 1 AS next1,
  CASE WHEN count(return1) OVER (s ROWS 19 PRECEDING) = 20 THEN stddev_pop(return1) OVER (s ROWS 19 PRECEDING) END AS volatility20,
  CASE WHEN count(*) OVER (s ROWS 19 PRECEDING) = 20 THEN close / avg(close) OVER (s ROWS 19 PRECEDING) - 1 END AS distance20,
  CASE WHEN count(*) OVER (s ROWS 59 PRECEDING) = 60 THEN close / avg(close) OVER (s ROWS 59 PRECEDING) - 1 END AS distance60,
  close / max(close) OVER (s ROWS 59 PRECEDING) - 1 AS drawdown60 FROM base WINDOW s AS (PARTITION BY code ORDER BY date))"""


@query("f11_price_rows", "WITH " + _PRICE_VIEW.format(panel="panel") + " SELECT date, code, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PRICE) + " FROM price", "panel")
def f11(spark, d):
    return X.price_rows(P.brand_panel(spark, d)).select("date", "code", *r6(*_PRICE))


@query(
    "f12_relative_rows",
    "WITH " + _PRICE_VIEW.format(panel="(SELECT date, code, close FROM flags UNION ALL SELECT date, '=', close FROM bench)")
    + " SELECT p.date, p.code, round(p.return1 - b.return1, 6) AS relative1, round(p.return5 - b.return5, 6) AS relative5, round(p.return20 - b.return20, 6) AS relative20 FROM price p JOIN price b ON b.code = '=' AND b.date = p.date WHERE p.code <> '='",
    "flags", "bench",
)
def f12(spark, d):
    own = X.price_rows(P.flag_panel(spark, d))
    bench = X.price_rows(P.benchmark(spark, d).withColumn("code", F.lit("="))).select("date", *[F.col(f"return{n}").alias(f"b{n}") for n in (1, 5, 20)])
    return own.join(bench, "date").select("date", "code", *[F.round(F.col(f"return{n}") - F.col(f"b{n}"), 6).alias(f"relative{n}") for n in (1, 5, 20)])


@query(
    "f12_session_faults",
    "WITH s AS (SELECT DISTINCT date, code FROM panel), k AS (SELECT DISTINCT code FROM panel), e AS (SELECT code, date FROM k, bench) SELECT e.code, count(*) AS missing FROM e ANTI JOIN s ON s.date = e.date AND s.code = e.code GROUP BY 1",
    "panel", "bench",
)
def f12_faults(spark, d):
    return X.session_faults(P.brand_panel(spark, d), P.benchmark(spark, d))


@query("f13_change_1d", "SELECT date, code, round(close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1, 6) AS change1 FROM hourly", "hourly")
def f13(spark, d):
    return P.event_panel(spark, d).select("date", "code", F.round(X.change("close", 1), 6).alias("change1"))


@query(
    "f14_curve_changes",
    "SELECT date, " + ", ".join(f"round((close - lag(close, {k}) OVER (ORDER BY date)) * 100, 2) AS change{k}" for k in (1, 5, 20)) + " FROM bench",
    "bench",
)
def f14(spark, d):
    bench = P.benchmark(spark, d).withColumn("code", F.lit("curve"))
    return bench.select("date", *[F.round((F.col("close") - F.lag("close", k).over(X.series())) * 100, 2).alias(f"change{k}") for k in (1, 5, 20)])


@query(
    "f15_history_metrics",
    """WITH b AS (SELECT p.*, b.close AS bench_close, p.amount / b.amount AS share, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS turn FROM panel p JOIN bench b USING (date))
    SELECT code, round(avg(amount) FILTER (turn <= 5) / avg(amount) FILTER (turn BETWEEN 6 AND 25), 6) AS amount_5_20, round(avg(volume) FILTER (turn <= 5) / avg(volume) FILTER (turn BETWEEN 6 AND 25), 6) AS volume_5_20,
    round(avg(share) FILTER (turn <= 5) / avg(share) FILTER (turn BETWEEN 6 AND 25), 6) AS share_5_20,
    round(max(close) FILTER (turn = 1) / max(close) FILTER (turn = 6) - max(bench_close) FILTER (turn = 1) / max(bench_close) FILTER (turn = 6), 6) AS relative5, count(*) AS rows FROM b WHERE turn <= 25 GROUP BY code""",
    "panel", "bench",
)
def f15(spark, d):
    return X.history_metrics(P.brand_panel(spark, d), P.benchmark(spark, d)).select("code", *r6("amount_5_20", "volume_5_20", "share_5_20", "relative5"), "rows")


@query(
    "f16_member_flags",
    """SELECT code, up1, up5, above20 FROM (SELECT date, code, close > lag(close) OVER s AS up1, close > lag(close, 5) OVER s AS up5,
    CASE WHEN count(*) OVER (s ROWS 19 PRECEDING) = 20 THEN close > avg(close) OVER (s ROWS 19 PRECEDING) END AS above20 FROM panel WINDOW s AS (PARTITION BY code ORDER BY date))
    WHERE above20 IS NOT NULL QUALIFY date = max(date) OVER ()""",
    "panel",
)
def f16(spark, d):
    rows = P.brand_panel(spark, d).select(
        "date", "code", (F.col("close") > F.lag("close", 1).over(X.series())).alias("up1"), (F.col("close") > F.lag("close", 5).over(X.series())).alias("up5"), (F.col("close") > X.complete_mean("close", -19, 0)).alias("above20")
    )
    rows = rows.filter("above20 is not null")
    newest = rows.agg(F.max("date").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("date") == F.col("newest")).select("code", "up1", "up5", "above20")


@query("f17_moving_average", "SELECT date, code, round(CASE WHEN count(*) OVER s = 20 THEN avg(close) OVER s END, 3) AS average FROM panel WINDOW s AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)", "panel")
def f17(spark, d):
    return X.moving_average(P.brand_panel(spark, d), 20).select("date", "code", F.round("average", 3).alias("average"))


_EMA = """RECURSIVE nb AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM {panel}),
ema{n} AS (SELECT code, CAST({n} AS BIGINT) AS i, avg(close) AS v FROM nb WHERE i <= {n} GROUP BY code HAVING count(*) = {n}
  UNION ALL SELECT e.code, e.i + 1, e.v * (1 - 2.0::DOUBLE / ({n} + 1)) + nb.close * (2.0::DOUBLE / ({n} + 1)) FROM ema{n} e JOIN nb ON nb.code = e.code AND nb.i = e.i + 1)"""
_BARS_SQL = "(SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_returnflag AS code, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS close FROM lineitem GROUP BY 1, 2)"


@query("f18_exponential_average", "WITH " + _EMA.format(panel=_BARS_SQL, n=12) + " SELECT nb.date, nb.code, round(v, 6) AS ema12 FROM nb LEFT JOIN ema12 USING (code, i)")
def f18(spark, d):
    return R.exponential_averages(P.flag_panel(spark, d), [12]).select("date", "code", *r6("ema12"))


_MACD = (
    "WITH " + _EMA.format(panel=_BARS_SQL, n=12) + ", " + _EMA.format(panel="", n=26).split(",\n", 1)[1]
    + """, line AS (SELECT nb.code, nb.date, a.v - b.v AS macd, row_number() OVER (PARTITION BY nb.code ORDER BY nb.date) AS i FROM nb JOIN ema12 a USING (code, i) JOIN ema26 b USING (code, i)),
sig AS (SELECT code, CAST(9 AS BIGINT) AS i, avg(macd) AS v FROM line WHERE i <= 9 GROUP BY code HAVING count(*) = 9 UNION ALL SELECT s.code, s.i + 1, s.v * 0.8 + l.macd * 0.2 FROM sig s JOIN line l ON l.code = s.code AND l.i = s.i + 1)
SELECT date, code, round(macd, 6) AS macd, round(v, 6) AS signal, round(macd - v, 6) AS histogram FROM line LEFT JOIN sig USING (code, i)"""
)


@query("f19_macd", _MACD)
def f19(spark, d):
    line = R.exponential_averages(P.flag_panel(spark, d), [12, 26]).select("date", "code", (F.col("ema12") - F.col("ema26")).alias("close")).filter("close is not null")
    signal = R.exponential_averages(line, [9])
    return signal.select("date", "code", F.round("close", 6).alias("macd"), F.round("ema9", 6).alias("signal"), F.round(F.col("close") - F.col("ema9"), 6).alias("histogram"))


@query(
    "f20_normalized_performance",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS turn FROM panel), p AS (SELECT *, close / first_value(close) OVER (PARTITION BY code ORDER BY date) - 1 AS performance FROM t WHERE turn <= 60),
    e AS (SELECT code, row_number() OVER (ORDER BY round(performance, 9) DESC, code) AS best, row_number() OVER (ORDER BY round(performance, 9), code) AS worst FROM p WHERE turn = 1)
    SELECT date, code, round(performance, 6) AS performance FROM p JOIN e USING (code) WHERE best <= 2 OR worst <= 2""",
    "panel",
)
def f20(spark, d):
    turn = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    tail = P.brand_panel(spark, d).withColumn("turn", turn).filter("turn <= 60")
    tail = tail.withColumn("performance", F.col("close") / F.first("close").over(X.series()) - 1)
    last = tail.filter("turn = 1").select("code", F.round("performance", 9).alias("end"))
    best, worst = last.orderBy(F.desc("end"), "code").limit(2), last.orderBy("end", "code").limit(2)
    shown = best.unionByName(worst).select("code").distinct()
    return tail.join(F.broadcast(shown), "code").select("date", "code", *r6("performance"))


@query("f21_forward_return", "SELECT date, code, horizon, target_date, round(forward, 6) AS forward, round(bench_forward, 6) AS bench_forward FROM lab", "lab")
def f21(spark, d):
    return labels(spark, d).select("date", "code", "horizon", "target_date", *r6("forward", "bench_forward"))


@query("f22_excess_flags", "SELECT date, code, horizon, round(excess, 6) AS excess, absolute_up, outperformed FROM lab", "lab")
def f22(spark, d):
    return labels(spark, d).select("date", "code", "horizon", *r6("excess"), "absolute_up", "outperformed")


@query("f23_realized_rank", "SELECT date, code, horizon, rank, top_quartile, round(percentile, 6) AS percentile FROM lab", "lab")
def f23(spark, d):
    return labels(spark, d).select("date", "code", "horizon", F.col("rank").cast("long").alias("rank"), "top_quartile", *r6("percentile"))


_PCT = "round(100 * (1 - (row_number() OVER (PARTITION BY date ORDER BY round({c}, 10) DESC, code) - 1) / greatest(1, count(*) OVER (PARTITION BY date) - 1)), 1)"


@query("f24_percentile_score", f"SELECT date, code, {_PCT.format(c='momentum20')} AS score FROM whole", "whole")
def f24(spark, d):
    return z_scores(spark, d).select("date", "code", L.percentile_score("momentum20").alias("score"))


@query("f25_population_z", "SELECT date, code, round((close - avg(close) OVER w) / coalesce(nullif(stddev_pop(close) OVER w, 0), 1), 6) AS z FROM hourly WINDOW w AS (PARTITION BY date)", "hourly")
def f25(spark, d):
    return P.event_panel(spark, d).select("date", "code", F.round(X.z_score("close"), 6).alias("z"))


_COMPOSITE = "(0.32 * z_momentum5 + 0.26 * z_momentum20 + 0.18 * z_amount_ratio + 0.12 * z_volume_ratio - 0.12 * z_volatility20)"


@query("f26_composite_score", f"WITH c AS (SELECT *, {_COMPOSITE} AS composite FROM zs) SELECT date, code, round(composite, 6) AS composite, {_PCT.format(c='composite')} AS score FROM c", "zs")
def f26(spark, d):
    return z_scores(spark, d).withColumn("composite", composite()).select("date", "code", *r6("composite"), L.percentile_score("composite").alias("score"))


@query("f27_average_ranks", "SELECT date, code, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2 AS rank FROM hourly", "hourly")
def f27(spark, d):
    return P.event_panel(spark, d).select("date", "code", X.average_ranks("volume", X.cross()).alias("rank"))


_IC = """ranked AS (SELECT date, horizon, rank() OVER (PARTITION BY date, horizon ORDER BY score) + (count(*) OVER (PARTITION BY date, horizon, score) - 1) / 2 AS a,
  rank() OVER (PARTITION BY date, horizon ORDER BY excess) + (count(*) OVER (PARTITION BY date, horizon, excess) - 1) / 2 AS b FROM scored),
ic AS (SELECT date, horizon, count(*) AS n, (avg(a * b) - avg(a) * avg(b)) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM ranked GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("f28_rank_ic", f"WITH {_IC} SELECT date, n, round(ic, 6) AS ic FROM ic WHERE horizon = 5", "scored")
def f28(spark, d):
    return X.rank_correlation(scored(spark, d).filter("horizon = 5"), "score", "excess").select("date", "n", *r6("ic"))


@query("f29_latest_row", "SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1", "hourly")
def f29(spark, d):
    return X.latest(P.event_panel(spark, d))


@query("f30_latest_of_two_keys", "SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def f30(spark, d):
    from tidepanel.session import table

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("turn", turn).filter("turn = 1").select("user_id", "event_id", "ts", "value")


@query(
    "f31_blocks",
    f"WITH {_IC}, b AS (SELECT *, (row_number() OVER (ORDER BY date) - 1) // 63 AS block FROM ic WHERE horizon = 5), m AS (SELECT block, avg(ic) AS mean FROM b GROUP BY 1) SELECT block, round(mean, 6) AS mean_ic, round(avg(CAST(mean > 0 AS INTEGER)) OVER (), 6) AS positive_share FROM m",
    "scored",
)
def f31(spark, d):
    ic = X.rank_correlation(scored(spark, d).filter("horizon = 5"), "score", "excess")
    means = ic.join(X.blocks(ic), "date").groupBy("block").agg(F.avg("ic").alias("mean"))
    share = means.agg(F.avg((F.col("mean") > 0).cast("int")).alias("positive_share"))
    return means.crossJoin(F.broadcast(share)).select("block", F.round("mean", 6).alias("mean_ic"), *r6("positive_share"))


_SPREAD = """n AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 10) DESC, code) AS r, count(*) OVER (PARTITION BY date) AS n FROM scored WHERE horizon = 5),
spread AS (SELECT date, avg(excess) FILTER (r <= 3) - avg(excess) FILTER (r > n - 3) AS spread FROM n GROUP BY date)"""


def spreads(spark, d):
    rows = scored(spark, d).filter("horizon = 5")
    turn = F.row_number().over(X.cross().orderBy(F.desc(F.round("score", 10)), "code"))
    rows = rows.withColumn("r", turn).withColumn("n", F.count("*").over(X.cross()))
    return rows.groupBy("date").agg((F.avg(F.when(F.col("r") <= 3, F.col("excess"))) - F.avg(F.when(F.col("r") > F.col("n") - 3, F.col("excess")))).alias("spread"))


@query("f32_drawdown_of_spread", f"WITH {_SPREAD}, c AS (SELECT date, sum(spread) OVER (ORDER BY date) AS cum FROM spread), p AS (SELECT *, greatest(0, max(cum) OVER (ORDER BY date)) AS peak FROM c) SELECT round(min(cum - peak), 6) AS max_drawdown, round(arg_max(cum, date), 6) AS total FROM p", "scored")
def f32(spark, d):
    every = Window.orderBy("date")  # one row per date
    cum = spreads(spark, d).withColumn("cum", F.sum("spread").over(every))
    cum = cum.withColumn("peak", F.greatest(F.lit(0.0), F.max("cum").over(every)))
    return cum.agg(F.round(F.min(F.col("cum") - F.col("peak")), 6).alias("max_drawdown"), F.round(F.max_by("cum", "date"), 6).alias("total"))


@query("f33_turnover", f"WITH {_SPREAD}, t AS (SELECT date, list(code) AS top FROM n WHERE r <= 3 GROUP BY date) SELECT date, CASE WHEN lag(date) OVER (ORDER BY date) IS NOT NULL THEN round(1 - len(list_intersect(top, lag(top) OVER (ORDER BY date))) / 3, 6) END AS turnover FROM t", "scored")
def f33(spark, d):
    rows = scored(spark, d).filter("horizon = 5")
    turn = F.row_number().over(X.cross().orderBy(F.desc(F.round("score", 10)), "code"))
    top = rows.withColumn("r", turn).filter("r <= 3").groupBy("date").agg(F.collect_set("code").alias("top"))
    return top.select("date", F.round(1 - F.size(F.array_intersect("top", F.lag("top").over(Window.orderBy("date")))) / 3, 6).alias("turnover"))


@query("f34_regime", "SELECT date, CASE WHEN avg(momentum20) >= 0 THEN 'risk-on' ELSE 'risk-off' END AS regime, round(avg(momentum20), 6) AS mean FROM whole GROUP BY date", "whole")
def f34(spark, d):
    mean = F.avg("momentum20")
    return z_scores(spark, d).groupBy("date").agg(F.when(mean >= 0, "risk-on").otherwise("risk-off").alias("regime"), F.round(mean, 6).alias("mean"))


@query(
    "f35_longest_run",
    """WITH m AS (SELECT *, coalesce(ret > 0, false) AS up FROM raw), g AS (SELECT code, up, row_number() OVER (PARTITION BY code ORDER BY date) - row_number() OVER (PARTITION BY code, up ORDER BY date) AS run FROM m)
    SELECT code, coalesce(max(n) FILTER (up), 0) AS longest FROM (SELECT code, up, run, count(*) AS n FROM g GROUP BY ALL) GROUP BY code""",
    "raw",
)
def f35(spark, d):
    rows = P.brand_panel(spark, d).withColumn("ret", X.change("close", 1))
    return X.longest_run(rows, F.coalesce(F.col("ret") > 0, F.lit(False)))


@query("f36_range_tail", "SELECT r.name AS span, p.date, p.close FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS turn FROM bench) p JOIN (VALUES ('1M', 21), ('3M', 63), ('6M', 126), ('1Y', 252)) r(name, n) ON turn <= r.n", "bench")
def f36(spark, d):
    tail = P.benchmark(spark, d).withColumn("turn", F.row_number().over(Window.orderBy(F.desc("date"))))
    spans = F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("span"), F.lit(n).alias("n")) for s, n in (("1M", 21), ("3M", 63), ("6M", 126), ("1Y", 252))]), lambda s: F.col("turn") <= s["n"]))
    return tail.withColumn("s", spans).select(F.col("s.span").alias("span"), "date", "close")


@query(
    "f37_index_snapshot",
    """WITH p AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS previous, lag(date) OVER (PARTITION BY code ORDER BY date) AS previous_date FROM panel), b AS (SELECT date, close AS official FROM bench)
    SELECT code, p.date, previous_date, round(p.close, 6) AS latest, round(p.close - previous, 6) AS points, round((p.close / previous - 1) * 100, 6) AS percent, abs(p.close - official) > 0.01 AS conflict
    FROM p JOIN b USING (date) QUALIFY row_number() OVER (PARTITION BY code ORDER BY p.date DESC) = 1""",
    "panel", "bench",
)
def f37(spark, d):
    rows = P.brand_panel(spark, d).withColumn("previous", F.lag("close").over(X.series())).withColumn("previous_date", F.lag("date").over(X.series()))
    rows = X.latest(rows.join(P.benchmark(spark, d).select("date", F.col("close").alias("official")), "date"))
    return rows.select("code", "date", "previous_date", F.round("close", 6).alias("latest"), F.round(F.col("close") - F.col("previous"), 6).alias("points"), F.round((F.col("close") / F.col("previous") - 1) * 100, 6).alias("percent"), (F.abs(F.col("close") - F.col("official")) > 0.01).alias("conflict"))


@query("f38_cross_section_spread", "SELECT round(avg(sd), 6) AS spread, count(*) AS dates FROM (SELECT stddev_pop(close) AS sd FROM hourly GROUP BY date HAVING count(*) >= 3)", "hourly")
def f38(spark, d):
    each = P.event_panel(spark, d).groupBy("date").agg(F.stddev_pop("close").alias("sd"), F.count("*").alias("n")).filter("n >= 3")
    return each.agg(F.round(F.avg("sd"), 6).alias("spread"), F.count("*").alias("dates"))


@query("j1_calendar_offset", "SELECT p.date, p.code, g.target_date, round(e.close / p.close - 1, 6) AS forward FROM hourly0 p JOIN goal g ON g.date = p.date AND horizon = 5 JOIN hourly0 e ON e.date = g.target_date AND e.code = p.code".replace("hourly0", "flags"), "flags", "goal")
def j1(spark, d):
    panel = P.flag_panel(spark, d)
    goal = F.broadcast(L.targets(P.benchmark(spark, d), [5]).select("date", "target_date"))
    ends = panel.select(F.col("date").alias("target_date"), "code", F.col("close").alias("end_close"))
    return panel.join(goal, "date").join(ends, ["target_date", "code"]).select("date", "code", "target_date", F.round(F.col("end_close") / F.col("close") - 1, 6).alias("forward"))


@query("j2_aligned_window", "SELECT code, date, round(p.close, 6) AS close, round(b.close, 6) AS bench_close FROM panel p JOIN bench b USING (date) QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 25", "panel", "bench")
def j2(spark, d):
    return X.aligned(P.brand_panel(spark, d), P.benchmark(spark, d)).select("code", "date", *r6("close", "bench_close"))


def flagship(spark, d):
    """Momentum, its z-score and rank on the weekly panel of return flags."""
    panel = P.flag_panel(spark, d)
    rows = X.trailing_features(panel).filter("momentum5 is not null").select("date", "code", "momentum5")
    z = X.cross_section(rows, X.universe_size(panel), ["momentum5"])
    rank = F.row_number().over(X.cross().orderBy(F.desc(F.round("momentum5", 10)), "code"))
    return z.select("date", "code", *r6("momentum5", "z_momentum5"), rank.cast("long").alias("rank"))


@query(
    "entry_momentum_rank",
    """WITH m AS (SELECT date, code, close / lag(close, 5) OVER (PARTITION BY code ORDER BY date) - 1 AS momentum5 FROM flags), c AS (SELECT * FROM m WHERE momentum5 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) = (SELECT count(DISTINCT code) FROM flags))
    SELECT date, code, round(momentum5, 6) AS momentum5, round((momentum5 - avg(momentum5) OVER w) / coalesce(nullif(stddev_pop(momentum5) OVER w, 0), 1), 6) AS z_momentum5, row_number() OVER (PARTITION BY date ORDER BY round(momentum5, 10) DESC, code) AS rank
    FROM c WINDOW w AS (PARTITION BY date)""",
    "flags",
)
def entry_query(spark, d):
    return flagship(spark, d)
