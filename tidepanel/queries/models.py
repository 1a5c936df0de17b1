"""Folds, models, metrics and decisions (M1 to M30), on weekly bars: two years of training, blocks of a quarter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.operators import candidates as C
from tidepanel.operators import features as X
from tidepanel.operators import folds as W
from tidepanel.operators import ledger as G
from tidepanel.operators import metrics as E
from tidepanel.operators import models as M
from tidepanel.operators import policies as P
from tidepanel.queries.aggregates import predictions
from tidepanel.queries.features import labels, r6, scored, stored_panel, z_scores
from tidepanel.queries.registry import NEEDS, VIEWS, query

c = F.col
TRAINING, BLOCK, HOLDOUT = 104, 13, 52
FEATURES = ["z_momentum5", "z_momentum20", "z_volatility20", "z_amount_ratio"]
H = 5

VIEWS["days"] = f"SELECT date, max(target_date) AS target_date FROM lab WHERE horizon = {H} AND target_date IS NOT NULL GROUP BY 1"
NEEDS["days"] = ["lab"]
VIEWS["fold_"] = f"""SELECT (place - 1) // {BLOCK} AS fold, min(date) AS start, max(date) AS "end", count(*) AS sessions
    FROM (SELECT date, row_number() OVER (ORDER BY date) AS place FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS turn FROM days) WHERE turn <= {TRAINING}) GROUP BY 1"""
NEEDS["fold_"] = ["days"]
VIEWS["ranked_"] = f"""SELECT date, code, p, excess, row_number() OVER (PARTITION BY date ORDER BY round(p, 10) DESC, code) AS a, row_number() OVER (PARTITION BY date ORDER BY round(p, 10), code DESC) AS z,
    row_number() OVER (PARTITION BY date ORDER BY round(excess, 10) DESC, code) AS r, greatest(1, ceil(count(*) OVER (PARTITION BY date) * 0.25)) AS top,
    rank() OVER (PARTITION BY date ORDER BY p) + (count(*) OVER (PARTITION BY date, p) - 1) / 2 AS i, rank() OVER (PARTITION BY date ORDER BY excess) + (count(*) OVER (PARTITION BY date, excess) - 1) / 2 AS j FROM scored WHERE horizon = {H}"""
NEEDS["ranked_"] = ["scored"]
VIEWS["daily_"] = """SELECT date, count(*) FILTER (a <= top AND r <= top) / max(top) AS hit, avg(excess) FILTER (a <= top) - avg(excess) FILTER (z <= top) AS spread, stddev_pop(p) AS dispersion, max(p) - min(p) AS range_,
    (avg(i * j) - avg(i) * avg(j)) / nullif(stddev_pop(i) * stddev_pop(j), 0) AS rank_ic FROM ranked_ GROUP BY date HAVING count(*) >= 3 AND stddev_pop(i) * stddev_pop(j) > 0"""
NEEDS["daily_"] = ["ranked_"]


def own_labels(spark, d):
    return labels(spark, d, [H])


def training_panel(spark, d):
    """z-scores with the labels of one horizon."""
    panel = stored_panel(spark, d)
    return z_scores(spark, d, panel).join(labels(spark, d, [H], panel), ["date", "code"])


def windows():
    return {"training": TRAINING, "evaluation": TRAINING, "block": BLOCK}


@query("m1_labelled_dates", "SELECT DISTINCT date FROM lab WHERE horizon = 5 AND target_date < DATE '2000-01-01'", "lab")
def m1(spark, d):
    return W.labelled_dates(own_labels(spark, d), "2000-01-01").select("date")


@query("m2_training_window", f"SELECT date, target_date FROM days WHERE target_date < DATE '2001-01-01' AND (SELECT count(*) FROM days WHERE target_date < DATE '2001-01-01') >= {TRAINING} ORDER BY date DESC LIMIT {TRAINING}", "days")
def m2(spark, d):
    return W.training_window(own_labels(spark, d), "2001-01-01", TRAINING)


@query("m3_fold_blocks", 'SELECT fold, start, "end", sessions FROM fold_', "fold_")
def m3(spark, d):
    return W.folds(own_labels(spark, d), **windows())


@query(
    "m4_fold_dates",
    f"""WITH t AS (SELECT fold, d.date, row_number() OVER (PARTITION BY fold ORDER BY d.date DESC) AS turn, count(*) OVER (PARTITION BY fold) AS n FROM days d JOIN fold_ ON d.target_date < start),
    k AS (SELECT fold, date, 'train' AS role FROM t WHERE turn <= {TRAINING} AND n >= {TRAINING})
    SELECT fold, role, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT * FROM k UNION ALL SELECT f.fold, d.date, 'test' FROM fold_ f JOIN days d ON d.date BETWEEN f.start AND f."end" WHERE f.fold IN (SELECT fold FROM k)) GROUP BY 1, 2""",
    "fold_",
)
def m4(spark, d):
    return W.fold_dates(own_labels(spark, d), **windows()).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def walk_forward(spark, d):
    """(models by fold, the panel's rows with fold and role)."""
    dates = F.broadcast(W.fold_dates(own_labels(spark, d), **windows()))  # a row per date and fold
    rows = training_panel(spark, d).join(dates, "date")
    return M.fit_logistic(rows.filter("role = 'train'"), FEATURES, "top_quartile", "fold", ridge=10.0), rows


@query("m5_walk_forward_logistic")
def m5(spark, d):
    models, rows = walk_forward(spark, d)
    found = M.score(rows.filter("role = 'test'"), models, FEATURES, "fold")
    return found.select("fold", "date", "code", F.round(S.sigmoid(c("raw_score")), 6).alias("p"), "top_quartile")


def shown(models):
    return models.select(models.columns[0], "rows", F.round("base_rate", 6).alias("base_rate"), F.round("intercept", 6).alias("intercept"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


@query("m6_ridge_linear")
def m6(spark, d):
    return shown(M.fit_linear(training_panel(spark, d), FEATURES, "excess", "horizon", ridge=10.0))


@query("m7_ridge_logistic")
def m7(spark, d):
    return shown(M.fit_logistic(training_panel(spark, d), FEATURES, "absolute_up", "horizon", ridge=4.0, iterations=80, sample_sd=False, clip=30.0, base_start=False))


@query("m8_linear_score", "SELECT date, code, round(-1.1 + 0.3 * (z_momentum5 - 0.01) / 0.9 + 0.2 * (z_momentum20 - 0.02) / 0.8, 6) AS raw_score FROM zs", "zs")
def m8(spark, d):
    model = spark.createDataFrame([(1, -1.1, [0.3, 0.2], [0.01, 0.02], [0.9, 0.8])], "m int, intercept double, weights array<double>, means array<double>, scales array<double>")
    return M.score(z_scores(spark, d).withColumn("m", F.lit(1)), model, FEATURES[:2], "m").select("date", "code", F.round("raw_score", 6).alias("raw_score"))


@query("m9_platt_calibration")
def m9(spark, d):
    rows = scored(spark, d)
    found = M.calibrated(rows, M.fit_platt(rows, "score", "y", "horizon"), "score", "horizon")
    return found.select("date", "code", "horizon", F.round("calibrated", 6).alias("p"))


_AUC = "SELECT horizon, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM (SELECT horizon, y, rank() OVER (PARTITION BY horizon ORDER BY {p}) + (count(*) OVER (PARTITION BY horizon, {p}) - 1) / 2 AS r FROM {t}) GROUP BY 1"


ORACLE_SQL_M10 = f"""WITH q AS (SELECT *, round(0.5 + 0.6 * (p - 0.5), 9) AS k FROM scored), a AS ({_AUC.format(p='p', t='q')}),
    b AS (SELECT horizon, avg((p - y) ** 2) AS raw, avg((k - y) ** 2) AS cal, avg(y) * (1 - avg(y)) AS base FROM q GROUP BY 1),
    s AS (SELECT horizon, avg(sp) AS sp, avg(sk) AS sk FROM (SELECT horizon, date, stddev_pop(p) AS sp, stddev_pop(k) AS sk FROM q GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1)
    SELECT horizon, auc > 0.52 AND 1 - raw / base > 0 AND cal <= raw AND sk >= greatest(0.01, sp * 0.35) AS enabled FROM a JOIN b USING (horizon) JOIN s USING (horizon)"""


@query("m10_calibration_rule", ORACLE_SQL_M10, "scored")
def m10(spark, d):
    q = scored(spark, d).withColumn("k", F.round(0.5 + 0.6 * (c("p") - 0.5), 9))
    return E.calibration_rule(q, ["horizon"], "p", "k", "y").select("horizon", "enabled")


@query("m11_brier", "SELECT horizon, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(y) * (1 - avg(y)), 6) AS baseline_brier, round(1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))), 6) AS brier_skill FROM scored GROUP BY 1", "scored")
def m11(spark, d):
    return E.brier(scored(spark, d), ["horizon"]).select("horizon", "n", *r6("brier", "baseline_brier", "brier_skill"))


@query("m12_log_loss", "SELECT horizon, code, round(avg(-(y * ln(greatest(p, 1e-12)) + (1 - y) * ln(greatest(1 - p, 1e-12)))), 6) AS log_loss FROM scored GROUP BY 1, 2", "scored")
def m12(spark, d):
    return E.brier(scored(spark, d), ["horizon", "code"]).select("horizon", "code", *r6("log_loss"))


@query("m13_auc", f"SELECT horizon, round(auc, 6) AS auc FROM ({_AUC.format(p='p', t='scored')})", "scored")
def m13(spark, d):
    return E.auc(scored(spark, d), ["horizon"]).select("horizon", *r6("auc"))


@query("m14_auc_by_pairs", "WITH q AS (SELECT horizon, y, round(p, 2) AS p FROM scored) SELECT a.horizon, round(avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END), 6) AS auc FROM q a JOIN q b ON a.horizon = b.horizon AND a.y = 1 AND b.y = 0 GROUP BY 1", "scored")
def m14(spark, d):
    return E.auc(scored(spark, d).withColumn("p", F.round("p", 2)), ["horizon"]).select("horizon", *r6("auc"))


@query("m15_calibration_error", "SELECT horizon, round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT horizon, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY 1, 2) GROUP BY 1", "scored")
def m15(spark, d):
    return E.calibration_error(scored(spark, d), ["horizon"]).select("horizon", *r6("ece"))


@query("m16_calibration_line")
def m16(spark, d):
    return M.calibration_line(scored(spark, d), "p", "y", "horizon").select("horizon", *r6("intercept", "slope"))


def daily(spark, d, p="p"):
    return E.daily_ranking(scored(spark, d).filter(c("horizon") == H), p)


@query("m17_daily_ranking", "SELECT date, round(rank_ic, 6) AS rank_ic, round(hit, 6) AS hit, round(spread, 6) AS spread, round(spread - 0.004, 6) AS after_cost FROM daily_", "daily_")
def m17(spark, d):
    return daily(spark, d).select("date", *r6("rank_ic", "hit", "spread", "after_cost"))


@query(
    "m18_ranking_summary",
    f"""WITH x AS (SELECT *, (row_number() OVER (ORDER BY date) - 1) // {BLOCK} AS b, sum(spread - 0.004) OVER (ORDER BY date) AS s FROM daily_), y AS (SELECT *, s - greatest(0, max(s) OVER (ORDER BY date)) AS drop_ FROM x),
    k AS (SELECT avg(CAST(ic > 0 AS INTEGER)) AS positive_share, min(cost) AS worst_block FROM (SELECT b, avg(rank_ic) AS ic, avg(spread - 0.004) AS cost FROM y GROUP BY 1))
    SELECT count(*) AS dates, round(avg(rank_ic), 6) AS rank_ic, round(avg(hit), 6) AS hit_rate, round(avg(spread), 6) AS spread, round(avg(spread - 0.004), 6) AS after_cost, round(avg(dispersion), 6) AS dispersion,
    round(avg(CAST(dispersion < 0.01 OR range_ < 0.03 AS INTEGER)), 6) AS abstention_share, round(least(0, min(drop_)), 6) AS max_drawdown, round(max(positive_share), 6) AS positive_share, round(max(worst_block), 6) AS worst_block FROM y, k""",
    "daily_",
)
def m18(spark, d):
    s = E.ranking_summary(daily(spark, d), BLOCK)
    return s.select("dates", *r6(*s.columns[1:]))


@query("m19_coefficient_stability")
def m19(spark, d):
    return M.coefficient_stability(walk_forward(spark, d)[0], FEATURES).select("feature", *r6("sign_stability", "dispersion"))


@query("m20_block_bootstrap")
def m20(spark, d):
    rows = scored(spark, d).filter(c("horizon") == H)
    champion, challenger = E.daily_ranking(rows), E.daily_ranking(rows.withColumn("q", c("momentum20")), "q")
    delta = champion.select("date", c("rank_ic").alias("a")).join(challenger.select("date", c("rank_ic").alias("b")), "date").select("date", (c("b") - c("a")).alias("delta"))
    return E.block_bootstrap(delta, "delta", block=BLOCK).select(*r6("point", "lower", "upper"))


def _named(rules, test):
    """SQL for the names of the rules that hold or fail; `test` gives a rule's condition."""
    return "list_filter([" + ", ".join(f"CASE WHEN {test(r)} THEN '{r[1]}' END" for r in rules) + "], lambda x: x IS NOT NULL)"


def _holds(r):
    _, _, metric, op, bound, upper, _, unknown = r
    told = f"{metric} BETWEEN {bound} AND {upper}" if op == "within" else f"{metric} {op} {bound}"
    return f"coalesce({told}, {str(unknown).lower()})"


@query(
    "m22_abstain_reasons",
    f"""WITH m AS (SELECT date, round(max(p) - min(p), 9) AS range, round(stddev_pop(p), 9) AS dispersion, CAST(bool_and(p BETWEEN 0.47 AND 0.53) AS INTEGER) AS near_even FROM scored WHERE horizon = 5 GROUP BY 1),
    v AS (SELECT date, round(avg(CAST(volume > 400 AS INTEGER)), 9) AS completeness FROM panel GROUP BY 1), k AS (SELECT round(avg(rank_ic), 9) AS rank_ic, round(avg(spread - 0.004), 9) AS after_cost FROM daily_),
    w AS (SELECT round(avg(CAST(ic > 0 AS INTEGER)), 9) AS positive_share FROM (SELECT b, avg(rank_ic) AS ic FROM (SELECT *, (row_number() OVER (ORDER BY date) - 1) // {BLOCK} AS b FROM daily_) GROUP BY 1)),
    s AS (SELECT round(1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))), 9) AS brier_skill FROM scored WHERE horizon = 5), e AS (SELECT CAST(enabled AS INTEGER) AS calibrated FROM ({ORACLE_SQL_M10}) WHERE horizon = 5)
    SELECT date, {_named(P.ABSTENTION, _holds)} AS reasons FROM m JOIN v USING (date), k, w, s, e""",
    "daily_",
    "panel",
)
def m22(spark, d):
    """Per date all nine reasons to publish no ranking, by the policy's table."""
    rows = scored(spark, d)
    own = rows.filter(c("horizon") == H)
    r9 = lambda *names: [F.round(n, 9).alias(n) for n in names]
    today = own.groupBy("date").agg(F.round(F.max("p") - F.min("p"), 9).alias("range"), F.round(F.stddev_pop("p"), 9).alias("dispersion"), F.bool_and(c("p").between(0.47, 0.53)).cast("int").alias("near_even"))
    complete = stored_panel(spark, d).groupBy("date").agg(F.round(F.avg((c("volume") > 400).cast("int")), 9).alias("completeness"))
    past = E.ranking_summary(daily(spark, d), BLOCK).select(*r9("rank_ic", "after_cost", "positive_share"), F.lit(H).alias("horizon"))
    skill = E.brier(own, ["horizon"]).select("horizon", *r9("brier_skill"))
    rule = E.calibration_rule(own.withColumn("k", F.round(0.5 + 0.6 * (c("p") - 0.5), 9)), ["horizon"], "p", "k", "y").select("horizon", c("enabled").cast("int").alias("calibrated"))
    one = past.join(skill, "horizon").join(rule, "horizon")  # one row each
    metrics = today.join(complete, "date").withColumn("horizon", F.lit(H)).join(F.broadcast(one), "horizon").drop("horizon")
    return P.reasons(metrics, P.policy(spark, P.ABSTENTION), "date")


@query(
    "m24_fold_checks",
    f"""WITH b AS (SELECT (place - 1) // {BLOCK} AS fold, avg(y) * (1 - avg(y)) - avg((p - y) ** 2) AS gain FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS place FROM scored WHERE horizon = {H}) GROUP BY 1)
    SELECT count(*) AS folds, round(avg(CAST(gain > 0 AS INTEGER)), 6) AS pass_share, round(max(gain) FILTER (gain > 0) / sum(gain) FILTER (gain > 0), 6) AS largest_share FROM b HAVING count(*) > 0""",
    "scored",
)
def m24(spark, d):
    rows = scored(spark, d).filter(c("horizon") == H)
    block = X.blocks(rows.select("date").distinct(), BLOCK)  # a row per date
    return E.fold_checks(rows.join(F.broadcast(block), "date"), "block").select("folds", *r6("pass_share", "largest_share"))


@query(
    "m25_expanding_folds",
    f"""WITH n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM lab WHERE horizon = {H})),
    f AS (SELECT start, min(fold) AS fold FROM (SELECT DISTINCT k AS fold, greatest({HOLDOUT}, n - {BLOCK} * (5 - k)) AS start, n FROM n, (SELECT unnest(range(5)) AS k)) WHERE start < n GROUP BY 1)
    SELECT fold, CASE WHEN place >= start THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(date) AS first, max(date) AS last FROM n JOIN f ON place < start + {BLOCK} WHERE place >= start OR place + {H} < start GROUP BY 1, 2""",
    "lab",
)
def m25(spark, d):
    return W.expanding_folds(own_labels(spark, d), H, block=BLOCK, least=HOLDOUT).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "m26_evaluations",
    """WITH o AS (SELECT p.*, l.rank, l.size, round(l.excess, 6) AS realized FROM pred p JOIN lab l ON l.date = p.prediction_date AND l.code = p.code AND l.horizon = p.horizon)
    SELECT prediction_id, rank, size, realized, top_quartile, CASE WHEN status <> 'published' THEN status WHEN abs(round(p, 9) - 0.25) < 0.03 THEN 'near_neutral' WHEN (round(p, 9) > 0.25) = (top_quartile = 1) THEN 'correct' ELSE 'wrong' END AS result FROM o JOIN (SELECT date, code, horizon, top_quartile FROM scored) s ON s.date = prediction_date AND s.code = o.code AND s.horizon = o.horizon""",
    "pred",
)
def m26(spark, d):
    real = labels(spark, d).select(c("date").alias("prediction_date"), "code", "horizon", "rank", c("excess").alias("realized"), "top_quartile")
    rows = predictions(spark, d).join(real, ["prediction_date", "code", "horizon"])
    size = F.count("*").over(Window.partitionBy("prediction_date", "horizon"))
    result = G.outcome(F.round("p", 9), c("top_quartile"), c("status"), F.lit(0.25), 0.03)
    return rows.select("prediction_id", "rank", size.alias("size"), F.round("realized", 6).alias("realized"), "top_quartile", result.alias("result"))


@query(
    "m27_metric_bundle",
    f"""WITH s AS (SELECT *, 0.5 AS base FROM scored WHERE horizon <> 20 OR code < 'Brand#13'), a AS ({_AUC.replace('horizon', 'date').format(p='p', t='s')}),
    e AS (SELECT date, sum(n * gap) / sum(n) AS ece FROM (SELECT date, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM s GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT date, count(*) AS n, avg((p - y) ** 2) AS brier, avg((base - y) ** 2) AS base FROM s GROUP BY 1)
    SELECT date, n, CASE WHEN n >= 60 THEN round(brier, 6) END AS brier, CASE WHEN n >= 60 THEN round(1 - brier / base, 6) END AS brier_skill, CASE WHEN n >= 60 THEN round(auc, 6) END AS auc, CASE WHEN n >= 60 THEN round(ece, 6) END AS ece,
    CASE WHEN n < 60 THEN 'insufficient_sample' END AS reason FROM b JOIN a USING (date) JOIN e USING (date)""",
    "scored",
)
def m27(spark, d):
    rows = scored(spark, d).filter((c("horizon") != 20) | (c("code") < "Brand#13")).withColumn("base", F.lit(0.5))
    return E.bundle(rows, ["date"], least=60).select("date", "n", *r6("brier", "brier_skill", "auc", "ece"), "reason")


@query("m28_holdout_windows", f"SELECT CASE WHEN turn <= {HOLDOUT} THEN 'holdout' ELSE 'selection' END AS \"window\", min(date) AS start, max(date) AS \"end\", count(*) AS sessions FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS turn, count(*) OVER () AS n FROM days) WHERE turn <= {HOLDOUT + TRAINING} AND n >= {HOLDOUT + TRAINING} GROUP BY 1", "days")
def m28(spark, d):
    return W.holdout_windows(own_labels(spark, d), selection=TRAINING, holdout=HOLDOUT)


SINGLE_RIDGES = [0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 640.0, 1280.0]
Z = [f"z_{f}" for f in X.FEATURES]


@query(
    "m29_candidate_grid",
    f"""WITH x AS (SELECT horizon, feature, v, excess AS y FROM (SELECT horizon, excess, {', '.join(Z)} FROM zs JOIN lab USING (date, code) WHERE excess IS NOT NULL) UNPIVOT (v FOR feature IN ({', '.join(Z)}))),
    m AS (SELECT horizon, feature, count(*) AS n, avg(v) AS mv, avg(y) AS my, var_pop(v) * count(*) AS sxx, covar_pop(v, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM x GROUP BY 1, 2),
    w AS (SELECT *, sxy / sqrt(sxx / (n - 1)) / (n - 1 + ridge) / sqrt(sxx / (n - 1)) AS w FROM m, (VALUES {', '.join(f"({r}::DOUBLE, '{r:g}')" for r in SINGLE_RIDGES)}) r(ridge, shown))
    SELECT horizon, feature || '|' || shown AS candidate, n, round(my - w * mv, 8) AS intercept, round(w, 8) AS weight, round((syy - 2 * w * sxy + w * w * sxx) / n, 9) AS error FROM w""",
    "zs",
    "lab",
)
def m29(spark, d):
    """Every feature alone under every ridge, for every horizon, from one scan of the panel."""
    panel = stored_panel(spark, d)
    rows = z_scores(spark, d, panel).join(labels(spark, d, panel=panel), ["date", "code"])
    grid = [k for k in C.plan(Z, {}, [], SINGLE_RIDGES)]
    found = C.fitted(C.shared_sums(rows, Z, "excess", ["horizon"]), Z, grid, ["horizon"])
    return found.select("horizon", "candidate", "n", F.round("intercept", 8).alias("intercept"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 8).alias("weight"), F.round("error", 9).alias("error"))


def ablations():
    """(features, candidates): linear and nonlinear terms, all and without each family, under four ridges, and the linear ones alone."""
    nonlinear = list(X.nonlinear_terms())
    families = {"linear": Z, "momentum": [f for f in Z + nonlinear if "momentum" in f], "volume": [f for f in Z + nonlinear if "amount" in f or "volume" in f], "drawdown": [f for f in Z + nonlinear if "drawdown" in f], "nonlinear": nonlinear}
    return Z + nonlinear, C.plan(Z + nonlinear, families, [10.0, 40.0, 80.0, 160.0], [40.0])


@query("m29_candidate_walk")
def m29_walk(spark, d):
    """The error of every candidate on the evaluation dates of every fold, after training on the dates before; all from one scan."""
    features, grid = ablations()
    dates = F.broadcast(W.fold_dates(own_labels(spark, d), **windows()))  # a row per date and fold
    rows = training_panel(spark, d).select("*", *[term.alias(name) for name, term in X.nonlinear_terms().items()]).join(dates, "date")
    walks = C.walked(C.shared_sums(rows, features, "excess", ["horizon", "fold", "role"]), features, grid, ["horizon", "fold"], "role")
    best = C.selected(walks, ["horizon"]).select("horizon", c("candidate").alias("_best"))
    return walks.join(F.broadcast(best), "horizon").select("horizon", "fold", "candidate", "n", F.round("error", 9).alias("error"), (c("candidate") == c("_best")).alias("selected"))


@query("m30_shadow_deltas", "SELECT date, code, round(0.5 * z_momentum20 - 0.2 * z_volatility20 - (0.32 * z_momentum5 + 0.26 * z_momentum20 + 0.18 * z_amount_ratio + 0.12 * z_volume_ratio - 0.12 * z_volatility20), 6) AS delta FROM zs", "zs")
def m30(spark, d):
    from tidepanel.queries.features import composite

    return z_scores(spark, d).select("date", "code", F.round(0.5 * c("z_momentum20") - 0.2 * c("z_volatility20") - composite(), 6).alias("delta"))
