"""Training of the toxicity model from every labelled row, in shards."""

import numpy as np

from tidepanel.llm import toxicity


def learnable(spark, n):
    return [r[0] for r in spark.range(3 * n).filter(~toxicity.held_out("id")).orderBy("id").limit(n).collect()]


def test_every_labelled_row_and_a_whole_long_text_are_learnt(spark):
    ids = learnable(spark, 2_401)
    texts = [f"fine w{i}x" for i in ids[:-1]] + ["awful " * 60_000 + "lastword"]
    y = [0] * 2_350 + [1] * 51
    model = toxicity.fit(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), spark.createDataFrame(list(zip(ids, y)), "doc_id long, toxic int"))
    words = [t.split()[-1] for t in texts]
    assert (model.embed[[toxicity.features(w)[0] for w in words], 0] != 0).all()  # a word that no learnt text has stays at zero


def test_shards_give_one_model_whatever_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 50)
    ids = learnable(spark, 200)
    y = [int(i % 4 == 0) for i in range(200)]
    rows = [(i, f"the day {'awful' if t else 'kind'} w{i % 30}") for i, t in zip(ids, y)]
    labels = spark.createDataFrame(list(zip(ids, y)), "doc_id long, toxic int")
    one, other = (toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows[::-1]))
    assert (one.embed == other.embed).all() and (toxicity._rest(one) == toxicity._rest(other)).all()
    score = toxicity.Scorer(one)([t for _, t in rows])
    assert score[np.array(y) == 1].min() > score[np.array(y) == 0].max()


def test_pooling_in_blocks_is_pooling_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    size = np.array([0, 5, 1, 0, 30, 2, 17, 0])
    table = np.round(rng.normal(0, 1, (size.sum(), sum(toxicity.WIDTHS) * toxicity.FILTERS)), 1).astype(np.float32)
    whole = toxicity._pooled(lambda a, b: table[a:b], size)
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert all((x == y).all() for x, y in zip(whole, toxicity._pooled(lambda a, b: table[a:b], size)))
    assert np.allclose(whole[0], toxicity._values(table, np.arange(len(table)), size), atol=1e-6)


def test_steps_of_logits_give_the_best_f1(monkeypatch):
    rng = np.random.default_rng(5)
    step, y = rng.integers(-30, 30, 400), rng.integers(0, 2, 400)
    every, place = np.unique(step, return_inverse=True)
    at = round(toxicity.best_step(every, np.stack([np.bincount(place, y), np.bincount(place)], 1)) * toxicity.STEPS, 6)
    f1 = lambda cut: 2 * y[step >= cut].sum() / ((step >= cut).sum() + y.sum())
    assert np.isclose(f1(at), max(f1(c) for c in step))
