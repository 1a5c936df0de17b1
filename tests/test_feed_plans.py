"""What the plans of feeds and entry lists hold, and edges of their dates and refusals."""

from tidepanel.sources.feeds import feed_entries

RSS = "<rss><channel><item><title>t</title><link>https://a.b/c</link>{}</item></channel></rss>"


def largest_methods(spark, df) -> list[int]:
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]


def test_no_method_is_too_large_to_be_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = feed_entries(spark.range(3).selectExpr("id", "concat('<rss>', id) AS xml"), "xml", ["id"])
        assert 0 < max(largest_methods(spark, df)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dates_and_refusals_at_their_edges(spark):
    date = lambda text: RSS.format(f"<pubDate>{text}</pubDate>")
    feeds = [
        ("space", date("\t2026-07-06\n")), ("instant", date("2026-07-06T01:00:00+02:00")), ("blank", date("2026-07-06 01:00:00")), ("longer", date("2026-07-06x")), ("month", date("2026-13-06")), ("lower", "<!doctype x>" + date("x")),
        ("comment", "<!-- <!entities --><rss><channel/></rss>"), ("entity", "<!EnTiTy x 'y'><rss/>"), ("note", "<!-- doctype entity -->" + date("2026-07-06")),
    ]
    found = {r["id"]: (str(r["published_date"]), str(r["published_at"]), r["reasons"]) for r in feed_entries(spark.createDataFrame(feeds, "id string, xml string"), "xml", ["id"]).collect()}
    refused = ("None", "None", ["xml-doctype-forbidden"])
    bad = ("None", "None", ["invalid-published-date"])
    assert found == {
        "space": ("2026-07-06", "None", []), "instant": ("2026-07-06", "2026-07-05 23:00:00", []), "blank": ("2026-07-06", "2026-07-06 01:00:00", []), "longer": bad, "month": bad,
        "lower": refused, "entity": refused, "note": ("2026-07-06", "None", []),
    }
