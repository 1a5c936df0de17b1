"""Rounding in doubles: ties fall as in SQL, and the queries whose digits show it equal their SQL exactly."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.scalars import rounded
from tidepanel.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_ties_fall_as_in_sql(spark):
    values = [k / 1000 + 0.0005 for k in range(-3000, 3000)] + [67.75795, 1e300, 0.0]
    found = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(rounded(F.col("v"), 3)).collect()]
    assert found == [duckdb.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("name", ["c6_number_text", "c12_score_with_enough_factors"])
def test_every_digit_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("lineitem", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    found = sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*names).collect())
    assert found == sorted(str(r) for r in theirs.fetchall())
