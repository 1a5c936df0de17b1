"""Substring search over an index against a scan of every text."""

import random

from pyspark.sql import functions as F

from tidepanel.operators import trigrams as TG


def test_search_equals_a_scan(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gämma", "ÜBER", "x", "🙂🙂🙃", "aaa", "a-b", "\n", "İ"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)] + [(None, "alpha without id"), (7, "twin of seven: beta"), (400, None), (401, ""), (402, "long " * 50_000 + "needle")]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "id long, text string, term string, gram int").drop("term").repartition(5)
    terms = ["alpha", "BETA", "gämma", "über", "🙂🙃", "🙂🙂🙃", "aaa aaa", "needle", "x", "", "zzz", "a-", "alpha beta", "with", "i̇"]
    found = sorted(((r["term"], r["id"], r["text"]) for r in TG.search(df, TG.build(df, "id", "text"), terms, "id", "text").collect()), key=str)
    assert found == sorted(((t, i, x) for t in terms for i, x in docs if t.lower() in (x or "").lower()), key=str)
    assert TG.search(df.limit(0), TG.build(df.limit(0), "id", "text"), ["abc", "a"], "id", "text").count() == 0


def test_postings_are_bounded_and_sorted(spark, monkeypatch):
    df = spark.range(25_000).select(F.col("id"), F.lit("every document has this").alias("text")).coalesce(2)
    postings = TG.build(df, "id", "text")
    assert postings.agg(F.max(F.size("ids"))).first()[0] <= TG.BATCH
    assert postings.filter(F.col("gram") == int(TG.grams_of("eve")[0])).agg(F.sum(F.size("ids"))).first()[0] == 25_000
    plan = postings.filter(F.col("gram").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
