"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tidepanel.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    """Six digits of numbers, days of midnights, text of the rest."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat().removesuffix("T00:00:00")
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    order = sorted(names)
    expected = sorted([plain(row[names.index(c)]) for c in order] for row in theirs.fetchall())
    found = sorted([plain(row[c]) for c in order] for row in ours.collect())
    assert found == expected


#: Fitted models and resampling, which SQL cannot express; tests/test_models.py holds their operators against numpy.
NO_SQL = {"m5_walk_forward_logistic", "m6_ridge_linear", "m7_ridge_logistic", "m9_platt_calibration", "m16_calibration_line", "m19_coefficient_stability", "m20_block_bootstrap", "m29_candidate_walk"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_models_run_on_small_tables(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
