"""Trigrams of many texts at once, and an index whose input comes in one piece."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidepanel.operators import trigrams as TG


def brute(texts):
    return sorted((int(g), i) for i, t in enumerate(texts) for g in TG.grams_of(t))


def test_grams_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    cases = [[], [""], ["ab", "c"], ["abc"], ["aaaa", "", "aaa", "ab"], ["\U0010ffff" * 4, "\ud800xy", "abcabc"]]
    cases += [["".join(rng.choices("abü🙂 ", k=rng.randint(0, 9))) for _ in range(200)], ["".join(map(chr, range(0x4E00, 0x9000)))] * 3]
    for texts in cases:
        gram, place = TG.grams_of_texts(texts)
        assert list(zip(gram.tolist(), place.tolist())) == brute(texts)


def test_pairs_without_room_in_one_number():
    texts = ["".join(map(chr, range(256, 0xD800)))] * 2 + ["".join(map(chr, range(0x10000, 0x110000)))] + [""] * 5
    gram, place = TG.grams_of_texts(texts)
    assert len(set("".join(texts))) ** 3 * len(texts) >= 1 << 63 and len(gram) == sum(len(TG.grams_of(t)) for t in texts) and (np.diff(gram) >= 0).all() and set(place) == {0, 1, 2}


def test_rows_of_one_file_are_spread(spark, tmp_path):
    spark.range(TG.BATCH * 3).select("id", F.lit("abc").alias("text")).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    parts = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert parts(one) == 1 and parts(TG.spread(one)) == 3
    postings = TG.build(one, "id", "text")
    assert sorted(r[0] for r in postings.select(F.explode("ids")).collect()) == list(range(TG.BATCH * 3))
