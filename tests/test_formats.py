"""Readers of loose formats on hard cells."""

from tidepanel.sources import formats


def test_wrapped_rows_take_the_first_key_present(spark):
    df = spark.createDataFrame([(1, '{"rows": [{"a": 1, "b": 2.5}]}'), (2, '{"data": [{"a": 3}]}'), (3, "no json"), (4, None)], "k int, p string")
    assert sorted(map(tuple, formats.wrapped_rows(df, "p", "a long, b double").collect())) == [(1, 1, 2.5), (2, 3, None)]


def test_delimited_rows_make_bad_cells_null(spark):
    df = spark.createDataFrame([("x", "2020-01-02,1.5;2020-01-03,oops;bad")], "k string, p string")
    out = formats.delimited_rows(df, "p", [("d", "date"), ("v", "double")]).collect()
    assert [(str(r["d"]), r["v"]) for r in out] == [("2020-01-02", 1.5), ("2020-01-03", None), ("None", None)]


def test_first_alias_ignores_case(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, 3.0)], "Close double, LAST double")
    assert [r[0] for r in df.select(formats.first_alias(df, ["close", "last"])).collect()] == [2.0, 1.0]
