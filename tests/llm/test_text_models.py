"""Quality and toxicity against brute force and on held-out rows."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import ngram_quality, toxicity

SF = "/root/testdata/sf0.001"


def brute_nats(texts, trusted):
    """Negative log-likelihoods under an interpolated modified Kneser-Ney model of the trusted texts, with dicts."""
    order = ngram_quality.ORDER
    signs = lambda t: [ngram_quality.START] * (order - 1) + [int.from_bytes(x, "little") for raw in [t.encode("utf-16-le")] for x in (raw[i : i + 2] for i in range(0, len(raw), 2))] + [ngram_quality.END]
    grams = lambda t: [tuple(c[i : i + order]) for c in [signs(t)] for i in range(len(c) - order + 1)]
    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, held = {}, {}, {}
    for k, table in counts.items():
        n = Counter(table.values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.0]
            discount[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        else:
            discount[k] = [0.5] * 3
        total[k], held[k] = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[k][g[:-1]] += c
            held[k][g[:-1]] += discount[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / ngram_quality.CODES
        c, h = counts[k].get(g, 0), g[:-1]
        own = (c - discount[k][min(c, 3) - 1]) / total[k][h] if c else 0.0
        return own + (held[k][h] / total[k][h] if total[k].get(h) else 1.0) * p(g[1:])

    return [sum(-math.log(p(g)) for g in grams(t)) for t in texts]


def test_perplexity_equals_a_model_of_dicts(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", None, "", "zzqx!! 漢字 \U0001f600", "the cat sat on the mat", "the " * 300_000]
    marks = [1, 1, 1, None, 1, 0, None, None]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, block int").coalesce(1)
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks) if m is not None] + [(None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in ngram_quality.score(docs, labels).collect()}
    out = {r[0] for r in spark.range(len(texts)).filter(ngram_quality.held_out("id")).collect()}
    expected = brute_nats([t or "" for t in texts], [t or "" for i, (t, m) in enumerate(zip(texts, marks)) if m == 1 and i not in out])
    assert len(found) == len(texts) and out & {0, 1, 2, 4} != {0, 1, 2, 4}
    for i, nats in enumerate(expected):
        assert math.isclose(found[i]["nats"], nats, rel_tol=1e-9)
        assert found[i]["n_grams"] == len((texts[i] or "").encode("utf-16-le")) // 2 + 1


def test_units_in_pieces_are_the_units_of_the_text(monkeypatch):
    texts = ["", "a", "the cat sat on the mat " * 9, "\U0001f600" * 20, "x" * 63]
    whole = [[tuple(u[i : i + 4]) for i in range(len(u) - 3)] for u in (ngram_quality.units(t).tolist() for t in texts)]
    monkeypatch.setattr(ngram_quality, "PIECE", 16)
    found = [[] for _ in texts]
    for group in ngram_quality.groups(texts):
        number, gram, size = ngram_quality.ngrams([u for _, u in group])
        at = 0
        for (i, _), n in zip(group, size.tolist()):
            found[i] += [tuple(int(g) >> 16 * k & 0xFFFF for k in (3, 2, 1, 0)) for g in gram[number[at : at + n]]]
            at += n
    assert found == whole


def test_quality_rejects_noise_and_keeps_columns(spark):
    rng = np.random.default_rng(0)
    vocabulary = "river stone bridge light water under quiet morning walks slowly with over the and small".split()
    good = [" ".join(rng.choice(vocabulary, 60)) for _ in range(80)]
    noise = ["".join(rng.choice(list("qxzjkvw#%@0123456789"), 300)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "c") for i, t in enumerate(good + noise)], "doc_id long, text string, lang string, cut string")
    labels = spark.createDataFrame([(i, 1 if i < 80 else 0) for i in range(0, 100, 2)], "doc_id long, quality int")
    kept = ngram_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(80))


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert ngram_quality.keep_good(docs, labels).count() == 2
    assert ngram_quality.keep_good(docs.limit(0), labels).count() == 0


def test_quality_cut_has_the_fewest_errors(spark):
    rows = [("en", 1, x) for x in [1.50] * 90 + [1.60] * 9 + [2.40]] + [("en", 0, x) for x in [1.70] * 10 + [5.0] * 10] + [("de", 1, 1.0), ("fr", 0, 9.0)]
    ids = [r[0] for r in spark.range(3000).filter(ngram_quality.held_out("id")).limit(len(rows)).collect()]
    fitted = spark.range(9).filter(~ngram_quality.held_out("id")).first()[0]  # what fitted the model sets no cut
    rows = [(i, lang, mark, 100, 100 * x) for i, (lang, mark, x) in zip(ids, rows)] + [(fitted, "en", 1, 100, 900.0)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, label int, n_grams long, nats double")
    found = {(r["lang"], r["every"]): r["cut"] for r in ngram_quality.cuts(scored).collect()}
    assert set(found) == {("en", False), ("de", False), (None, True)}
    assert math.isclose(found["en", False], 1.65) and math.isclose(found[None, True], 1.65)
    assert math.isclose(found["de", False], 1.0005)


def test_quality_rejects_what_is_labelled_bad_in_every_language(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = {r["doc_id"]: r for r in ngram_quality.judge(ngram_quality.score(docs, labels)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bad, repeated, good = defaultdict(list), [], defaultdict(list)
    for r in labels.filter("quality is not null").collect():
        if r["doc_id"] not in judged:
            continue
        j = judged[r["doc_id"]]
        if r["quality"] == 1:
            good[j["lang"]].append(j["rejected"])
            continue
        bad[j["lang"]].append(j["rejected"])
        words = texts[r["doc_id"]].split()
        if len(words) > 20 and len(set(words)) < len(words) / 4:
            repeated.append(j["rejected"])
    assert set(bad) == {"en", "de", "fr", "es"}
    shares = {lang: np.mean(x) for lang, x in bad.items()} | {"repeated": np.mean(repeated)}
    assert min(shares.values()) >= 0.85, shares
    assert max(np.mean(x) for x in good.values()) <= 0.03


def test_convolution_scores_equal_the_formula():
    texts = ["bad words here", "good words", "", "one", "worse words here and there"]
    model = toxicity.train(texts, [1, 0, 0, 0, 1])
    found = toxicity.Scorer(model)(texts)
    for text, score in zip(texts, found):
        words = [model.embed[list(toxicity.features(c))].sum(0) for c in text.split()]
        pooled = []
        for f in model.filters:
            for k in range(toxicity.FILTERS):
                values = [sum(float(words[i + j] @ f[j, :, k]) for j in range(len(f)) if i + j < len(words)) for i in range(len(words))]
                pooled.append(max(values, default=0.0))
        shown = np.maximum(np.array(pooled) + model.bias, 0)
        assert math.isclose(score, 1 / (1 + math.exp(-float(shown @ model.weight + model.base))), rel_tol=1e-4)


def test_toxicity_is_accurate_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.held_out_scores(docs, labels)
    held = scored.filter("held_out").join(labels, "doc_id").filter("toxic is not null").collect()
    assert scored.count() == docs.count()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) >= 0.85


def test_thresholds_have_the_best_f1_of_rows_that_were_not_fitted(spark):
    rng = np.random.default_rng(9)
    ids = [r[0] for r in spark.range(4000).filter(toxicity.held_out("id")).limit(300).collect()]
    fitted = [r[0] for r in spark.range(4000).filter(~toxicity.held_out("id")).limit(300).collect()]
    y = rng.integers(0, 2, 600)
    score = np.round(np.clip(0.4 * y + rng.normal(0.3, 0.15, 600), 0, 0.999), 3)
    lang = np.where(np.arange(600) % 3 > 0, "en", "de")
    rows = [(i, str(k), float(v)) for i, k, v in zip(ids + fitted, lang, score)]
    marks = [(i, int(t)) for i, t in zip(ids + fitted, y)]
    found = {(r["lang"], r["every"]): r["threshold"] for r in toxicity.thresholds(spark.createDataFrame(rows, "doc_id long, lang string, score double"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    assert set(found) == {("en", False), ("de", False), (None, True)}
    for (k, _), t in found.items():
        own = [(v, m) for v, m, n in zip(score[:300], y[:300], lang[:300]) if k in (None, n)]
        f1 = lambda cut: 2 * sum(m for v, m in own if v >= cut) / (sum(v >= cut for v, _ in own) + sum(m for _, m in own))
        assert math.isclose(f1(t), max(f1(i / 100) for i in range(100)))


def test_training_lowers_the_loss():
    texts = ["bad words here", "good words", "worse words", "fine day", "bad day", "good night"] * 20
    y = [1, 0, 1, 0, 1, 0] * 20
    model = toxicity.train(texts, y)
    p = np.clip(toxicity.Scorer(model)(texts[:6]), 1e-9, 1 - 1e-9)
    loss = -np.mean(np.log(np.where(np.array(y[:6]) == 1, p, 1 - p)))
    assert loss < 0.4  # an untrained model has 0.69


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "", None, 0.5), (2, "fine words", "en", None), (None, "x", "en", 0.1)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, none).count() == 4
    assert toxicity.keep_clean(docs.limit(0), none).count() == 0
    assert [r["score"] for r in toxicity.held_out_scores(docs, none).collect()] == [0.0] * 4
    some = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert toxicity.held_out_scores(docs, some).count() == 4


def test_thresholds_by_language_have_the_best_f1():
    rng = np.random.default_rng(2)
    for n in (2, 3, 10, 200):
        logits, y = np.round(rng.normal(0, 2, n), 1), np.append([1], rng.integers(0, 2, n - 1))
        f1 = lambda cut: 2 * (y[logits >= cut].sum()) / ((logits >= cut).sum() + y.sum())
        assert math.isclose(f1(toxicity.best_threshold(logits, y)), max(f1(c) for c in logits))


def test_calibration_moves_each_language_and_keeps_its_order():
    texts, y = [], []
    for k, (the, good, bad) in enumerate([("the of", "kind", "awful"), ("der und", "nett", "schlimm")]):
        for i in range(40):
            y.append(int(i % 3 == 0))
            texts.append(f"{the} w{i} {bad if y[-1] else good} x{k}")
    model = toxicity.train(texts, y)
    before = toxicity.Scorer(model)(texts)
    toxicity.calibrate(model, texts, y)
    after = toxicity.Scorer(model)(texts)
    assert set(model.shift) == {None, "en", "de"}
    for part in (slice(0, 40), slice(40, 80)):
        assert (np.argsort(before[part], kind="stable") == np.argsort(after[part], kind="stable")).all()
        assert ((after[part] >= 0.5) == np.array(y[part])).all()
    assert toxicity.Scorer(model).logits(["", "xyz", "der Hund und", "THE end"])[1].tolist() == [-1, -1, 1, 0]


def test_scores_depend_on_the_text_and_the_learnable_labels_only(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    scores = lambda d, m: sorted((r["doc_id"], r["score"]) for r in toxicity.held_out_scores(d, m).collect())
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert scores(docs, labels) == scores(other, flipped)
