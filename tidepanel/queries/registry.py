"""Where queries and their SQL are registered, and the SQL views that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB views by name; each may use those before it.
VIEWS = {
    "panel": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS code,
        round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS close, round(sum(l_quantity), 4) AS volume, round(sum(l_extendedprice), 4) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "flags": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_returnflag AS code,
        round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS close, round(sum(l_quantity), 4) AS volume, round(sum(l_extendedprice), 4) AS amount
        FROM lineitem GROUP BY 1, 2""",
    "bench": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
        round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS close, round(sum(l_quantity), 4) AS volume, round(sum(l_extendedprice), 4) AS amount
        FROM lineitem GROUP BY 1""",
    "prio": """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS code,
        round(avg(o_totalprice), 6) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(o_totalprice), 4) AS amount FROM orders GROUP BY 1, 2""",
    "hourly": """SELECT date_trunc('hour', ts) AS date, event_type AS code, round(avg(value), 6) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(value), 4) AS amount
        FROM events GROUP BY 1, 2""",
    "sess": "SELECT date, row_number() OVER (ORDER BY date) AS session FROM bench",
    "raw": """SELECT *, close / lag(close) OVER s - 1 AS ret, row_number() OVER s - 1 AS session FROM panel WINDOW s AS (PARTITION BY code ORDER BY date)""",
    "feat": """SELECT date, code, session, ret, close / lag(close, 5) OVER s - 1 AS momentum5, close / lag(close, 20) OVER s - 1 AS momentum20,
        close / lag(close, 60) OVER s - 1 AS momentum60, -ret AS reversal1,
        CASE WHEN count(ret) OVER (s ROWS 19 PRECEDING) >= 15 THEN stddev_pop(ret) OVER (s ROWS 19 PRECEDING) END AS volatility20,
        CASE WHEN count(*) OVER (s ROWS 59 PRECEDING) = 60 THEN close / max(close) OVER (s ROWS 59 PRECEDING) - 1 END AS drawdown60,
        CASE WHEN count(*) OVER (s ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING) = 20 THEN
          ln(avg(amount) OVER (s ROWS 4 PRECEDING) / avg(amount) OVER (s ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING)) END AS amount_ratio,
        CASE WHEN count(*) OVER (s ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING) = 20 THEN
          ln(avg(volume) OVER (s ROWS 4 PRECEDING) / avg(volume) OVER (s ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING)) END AS volume_ratio,
        momentum5 * amount_ratio AS acceleration
        FROM raw WINDOW s AS (PARTITION BY code ORDER BY date)""",
    "rows_": """SELECT * FROM feat WHERE session >= 60 AND momentum5 IS NOT NULL AND momentum20 IS NOT NULL AND momentum60 IS NOT NULL AND volatility20 IS NOT NULL
        AND drawdown60 IS NOT NULL AND amount_ratio IS NOT NULL AND volume_ratio IS NOT NULL""",
    "whole": "SELECT * FROM rows_ QUALIFY count(*) OVER (PARTITION BY date) = (SELECT count(DISTINCT code) FROM panel)",
    "zs": "SELECT *, "
    + ", ".join(
        f"({c} - avg({c}) OVER (PARTITION BY date)) / coalesce(nullif(stddev_pop({c}) OVER (PARTITION BY date), 0), 1) AS z_{c}"
        for c in ("momentum5", "momentum20", "momentum60", "reversal1", "volatility20", "drawdown60", "amount_ratio", "volume_ratio", "acceleration")
    )
    + " FROM whole",
    "goal": """SELECT b.date, h AS horizon, t.date AS target_date, b.close AS bench_start, t.close AS bench_end
        FROM (SELECT bench.*, session FROM bench JOIN sess USING (date)) b CROSS JOIN (VALUES (1), (5), (20)) v(h)
        JOIN (SELECT bench.*, session FROM bench JOIN sess USING (date)) t ON t.session = b.session + h""",
    "fwd": """SELECT p.date, p.code, g.horizon, g.target_date, e.close / p.close - 1 AS forward, bench_end / bench_start - 1 AS bench_forward,
        e.close / p.close - 1 - (bench_end / bench_start - 1) AS excess
        FROM panel p JOIN goal g USING (date) LEFT JOIN panel e ON e.date = g.target_date AND e.code = p.code
        QUALIFY count(e.close) OVER (PARTITION BY p.date, g.horizon) = (SELECT count(DISTINCT code) FROM panel)""",
    "lab": """SELECT *, CAST(forward > 0 AS INTEGER) AS absolute_up, CAST(excess > 0 AS INTEGER) AS outperformed, rank_ AS rank,
        CAST(rank_ <= ceil(size * 0.25) AS INTEGER) AS top_quartile, 1 - (rank_ - 1) / greatest(1, size - 1) AS percentile
        FROM (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY round(excess, 10) DESC, code) AS rank_, (SELECT count(DISTINCT code) FROM panel) AS size FROM fwd)""",
    "scored": """SELECT z.date, z.code, l.horizon, 0.32 * z_momentum5 + 0.26 * z_momentum20 + 0.18 * z_amount_ratio + 0.12 * z_volume_ratio - 0.12 * z_volatility20 AS score,
        1 / (1 + exp(-(0.32 * z_momentum5 + 0.26 * z_momentum20 + 0.18 * z_amount_ratio + 0.12 * z_volume_ratio - 0.12 * z_volatility20))) AS p,
        l.outperformed AS y, l.excess, l.top_quartile, z.momentum20
        FROM zs z JOIN lab l USING (date, code)""",
}
#: What each view uses.
NEEDS = {"sess": ["bench"], "raw": ["panel"], "feat": ["raw"], "rows_": ["feat"], "whole": ["rows_", "panel"], "zs": ["whole"], "goal": ["bench", "sess"], "fwd": ["panel", "goal"], "lab": ["fwd", "panel"], "scored": ["zs", "lab"]}


def sql(text: str, *views: str) -> str:
    """The text after the views that it names, in the order in which they are defined."""
    needed: set[str] = set()
    todo = list(views)
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo += NEEDS.get(v, [])
    parts = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed]
    text = text.strip()
    if parts and text[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + text


def query(name: str, text: str | None = None, *views: str):
    """Registers a query and the SQL that checks it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if text is not None:
            ORACLE_SQL[name] = sql(text, *views)
        return f

    return keep
