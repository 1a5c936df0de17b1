"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of hashed vectors of the word and of its first 3, 4 and 5 bytes, so that words that differ
only in their ending share most of it. Filters of WIDTHS words run over the text; each filter's largest value over the
whole text, cut at zero, is pooled; one linear layer and the logistic function make the score. Training takes every labelled row
with its whole text: the rows lie in shards by their id, each shard runs over its rows by minibatches with Adam from vectors that start at the smoothed log
odds of their hash, and the model is the mean of the shards' models, which share their random start (a bucket's vector is weighted by the
shard's texts that have it). Every random choice has a fixed seed, and a shard's rows are taken in the order of their ids, so the same rows give the same model.

Calibration: a part of the learnable rows (FOLD of FOLDS, by the id's checksum) isn't fitted. On it each language's threshold is that of the
best F1, in the middle of its gap; a language with fewer than 2 MIN_POSITIVE positives or negatives takes that of all. A score is moved by
its language's threshold, so that 0.5 is the best point of every language, and its order within a language stays. The language is read from
the text itself, by its most frequent FUNCTION_WORDS, so a score depends on nothing but the text. `thresholds` does the same for a given
column of languages, on the held-out fifth; the filter `keep_clean` uses it.

Scale: scoring is a map without shuffle over whole texts. A worker turns each chunk of text that it has not met into the filters'
contributions once; a text is then a gather, a sum and a maximum. The model is a few MB whatever the input.

Cases: null is the empty text; a text without words pools zeros and has the score of the bias; without labels of both classes
there is nothing to learn and every score is 0; a null label, or a label without a document, is left out; repeated labels
of an id count once, as toxic if any says so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import add_columns, release, slices, without
from tidepanel.session import cut

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 4  # of each width
EPOCHS = 6
VISITS = 24_000  # texts that a shard's training runs over at least, if EPOCHS runs over its texts are as many
SHARD_ROWS = 16_000
SHARD_BYTES = 64 << 20  # of text, on average
SEED = 7
PART = 1 << 10  # buckets that are averaged at once
STEPS = 100  # of a logit, in calibration
BLOCK = 1 << 15  # words that a filter runs over at once; memory, not results, depends on it
BATCH = 50
RATE = 0.02
MIN_POSITIVE = 5
MAX_CHUNKS = 120_000
FOLDS, FOLD = 5, 1  # the fold that calibrates; fold 0 is held out
#: Frequent function words, by which a text's language is known.
FUNCTION_WORDS = {
    "en": "the of and to in is it that for was on with as by at be this are from or".split(),
    "de": "der die und das ist nicht mit den dem ein eine von zu auf sich auch im für als es".split(),
    "fr": "le la les des du et est une un que qui dans pour par sur au ne pas ce elle".split(),
    "es": "el los las del y es una un que se por con para su no lo como al más en".split(),
}
NOT_WORD = re.compile(r"[\W_]+")


def chunks_of(text: str) -> list[str]:
    return text.split()


def features(chunk: str) -> tuple[int, int, int, int]:
    word = NOT_WORD.sub("", chunk.lower()).encode()
    return tuple(zlib.crc32(part) % BUCKETS for part in (b"w" + word, b"3" + word[:3], b"4" + word[:4], b"5" + word[:5]))


@dataclass
class Model:
    """embed: BUCKETS x DIM; filters[w]: w x DIM x FILTERS; bias and weight of the pooled values; bias of the score."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    base: float
    shift: dict[str | None, float] = field(default_factory=dict)  # the logit that becomes 0.5, by language; None: any other

    @property
    def table_width(self) -> int:
        return sum(WIDTHS) * FILTERS

    def table(self, buckets: np.ndarray) -> np.ndarray:
        """What words with these buckets add to every filter at every place of it."""
        word = self.embed[buckets].sum(1)
        return np.concatenate([word @ f[j] for f in self.filters for j in range(len(f))], 1)


def _pooled(rows_of: Callable[[int, int], np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of every filter in every text, and the place it begins at. rows_of: the table's rows of a range of the words of all texts.

    A filter may hang over the end of its text; what is missing there counts as zero. BLOCK words at a time, so memory doesn't depend on a text's length.
    """
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    value = np.zeros((len(size), len(WIDTHS) * FILTERS), np.float32)
    place = np.full(value.shape, -1, np.int64)
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        table, at = rows_of(first, min(n, last + max(WIDTHS) - 1)), np.arange(first, last)
        here = np.arange(np.searchsorted(ends, first, "right"), np.searchsorted(ends, last - 1, "right") + 1)
        here = here[size[here] > 0]
        begin = np.maximum(ends[here] - size[here], first) - first
        count = np.minimum(ends[here], last) - first - begin
        left, column = np.repeat(ends[here], count) - at, 0
        for k, width in enumerate(WIDTHS):
            total = table[: last - first, column : column + FILTERS].copy()
            for j in range(1, width):
                m = min(last - first, len(table) - j)
                total[:m] += table[j : j + m, column + j * FILTERS : column + (j + 1) * FILTERS] * (left[:m, None] > j)
            column += width * FILTERS
            best = np.maximum.reduceat(total, begin)
            found = np.minimum.reduceat(np.where(total == np.repeat(best, count, axis=0), at[:, None], n), begin)
            spot = np.ix_(here, range(k * FILTERS, (k + 1) * FILTERS))
            better = (place[spot] < 0) | (best > value[spot])
            value[spot], place[spot] = np.where(better, best, value[spot]), np.where(better, found, place[spot])
    return value, place


class Words:
    """Texts as numbers of their words, and the words' buckets."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.docs: list[np.ndarray] = []

    def add(self, text: str) -> None:
        known = self.known
        self.docs.append(np.fromiter((known.setdefault(c, len(known)) for c in chunks_of(text)), np.int32))

    def buckets(self) -> np.ndarray:
        return np.array([features(c) for c in self.known] or [(0, 0, 0, 0)], np.int64)


def started(random: np.random.Generator) -> np.ndarray:
    """The buckets' vectors before any text."""
    embed = random.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = 0
    return embed


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    """A model of whole texts."""
    words = Words()
    for t in texts:
        words.add(t)
    return trained(words, labels, seed)[0]


def trained(words: Words, labels: list[int], seed: int = SEED) -> tuple[Model, np.ndarray]:
    """A model of the texts, and how many of them have each bucket. Fewer texts than VISITS are run over again, EPOCHS times at most."""
    random = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    docs, buckets = words.docs, words.buckets()
    # Document frequencies of each bucket in both classes.
    seen = np.zeros((2, BUCKETS))
    for d, label in zip(docs, labels):
        seen[label, np.unique(buckets[np.unique(d)])] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
    embed = started(random)
    embed[:, 0] = odds * (np.log1p(seen.sum(0)) / 8)
    model = Model(
        embed,
        [random.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        np.full(len(WIDTHS) * FILTERS, 0.5, np.float32),
        -1.0,
    )
    for f in model.filters:
        f[:, 0, : FILTERS // 2 + 1] += 0.5
    parts = [model.embed, *model.filters, model.bias, model.weight]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    base_moment = [0.0, 0.0]
    step = 0
    for _ in range(min(EPOCHS, -(-VISITS // max(1, len(docs))))):
        order = random.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            size = np.array([len(docs[r]) for r in rows])
            flat = np.concatenate([docs[r] for r in rows])
            value, place = _pooled(lambda a, b: model.table(buckets[flat[a:b]]), size)
            shown = np.maximum(value + model.bias, 0)
            score = 1 / (1 + np.exp(-np.clip(shown @ model.weight + model.base, -30, 30)))
            slope = (score - y[rows]) / len(rows)
            active = (value + model.bias > 0) & (place >= 0)
            d_value = slope[:, None] * model.weight * active
            grads = [np.zeros_like(p) for p in parts]
            grads[-1][:] = shown.T @ slope
            grads[-2][:] = d_value.sum(0)
            end = np.cumsum(size)
            for k, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    c = k * FILTERS + f
                    used = np.flatnonzero(active[:, c])
                    for j in range(width):
                        here = place[used, c] + j
                        inside = here < end[used]
                        b = buckets[flat[here[inside]]]
                        d = d_value[used[inside], c]
                        grads[1 + k][j, :, f] += model.embed[b].sum(1).T @ d
                        np.add.at(grads[0], b.ravel(), np.repeat(d[:, None] * model.filters[k][j, :, f], 4, axis=0))
            step += 1
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip(parts, grads, moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= scale * m / (np.sqrt(v) + 1e-8)
            g = float(slope.sum())
            base_moment = [0.9 * base_moment[0] + 0.1 * g, 0.999 * base_moment[1] + 0.001 * g * g]
            model.base -= scale * base_moment[0] / (base_moment[1] ** 0.5 + 1e-8)
    return model, seen.sum(0)


def function_words(chunks: list[str]) -> np.ndarray:
    """For each chunk and each language of FUNCTION_WORDS whether it is one of its words."""
    of: dict[str, list[int]] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words:
            of.setdefault(w, []).append(k)
    out = np.zeros((len(chunks), len(FUNCTION_WORDS)), np.uint8)
    for i, chunk in enumerate(chunks):
        for k in of.get(NOT_WORD.sub("", chunk.lower()), ()):
            out[i, k] = 1
    return out


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F1 for `y`, in the middle between the values around it."""
    order = np.argsort(-logits, kind="stable")
    sorted_, hit = logits[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][sorted_[:-1] == sorted_[1:]] = -1  # equal logits stand on one side
    best = int(np.argmax(f1))
    return float(sorted_[best] + sorted_[best + 1]) / 2 if best + 1 < len(y) else float(sorted_[best]) - 1e-6


def calibrate(model: Model, texts: list[str], labels: list[int]) -> Model:
    """The model with the shifts that these texts ask for."""
    y = np.array(labels)
    enough = lambda part: min(part.sum(), len(part) - part.sum()) >= 2 * MIN_POSITIVE
    if not enough(y):
        return model
    logit, language = Scorer(model).logits(texts)
    names = [*FUNCTION_WORDS, None]
    model.shift = {None: best_threshold(logit, y)}
    for k, name in enumerate(names[:-1]):
        own = language == k
        if enough(y[own]):
            model.shift[name] = best_threshold(logit[own], y[own])
    return model


class Scorer:
    """A model with a table of the chunks that a worker has met."""

    def __init__(self, model: Model | None):
        self.model, self.number = model, {}
        self.table = np.empty((0, model.table_width if model else 0), np.float32)
        self.function = np.empty((0, len(FUNCTION_WORDS)), np.uint8)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        logit, language = self.logits(texts)
        other = self.model.shift.get(None, 0.0)
        shift = np.array([*(self.model.shift.get(name, other) for name in FUNCTION_WORDS), other])
        return 1 / (1 + np.exp(-np.clip(logit - shift[language], -30, 30)))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score before calibration, and its language: a place in FUNCTION_WORDS, or -1 without any such word."""
        if len(self.number) > MAX_CHUNKS:  # the half met first has the frequent ones
            half = len(self.number) // 2
            self.number, self.table = dict(zip(islice(self.number, half), range(half))), self.table[:half].copy()
            self.function = self.function[:half].copy()
        cut, new = [chunks_of(t) for t in texts], []
        index = []
        for chunks in cut:
            try:
                index.append(np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks)))
                continue
            except KeyError:
                pass
            for c in chunks:
                if c not in self.number:
                    self.number[c] = len(self.number)
                    new.append(c)
            index.append(np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks)))
        if new:
            self.table = np.concatenate([self.table, self.model.table(np.array([features(c) for c in new]))])
            self.function = np.concatenate([self.function, function_words(new)])
        size, flat = np.array([len(c) for c in cut]), np.concatenate(index)
        value = _values(self.table, flat, size)
        logit = np.maximum(value + self.model.bias, 0).astype(np.float64) @ self.model.weight + self.model.base
        seen = np.zeros((len(texts), len(FUNCTION_WORDS)), np.int64)
        if len(flat):
            seen[size > 0] = np.add.reduceat(self.function[flat].astype(np.int32), (np.cumsum(size) - size)[size > 0])
        return logit, np.where(seen.max(1) > 0, seen.argmax(1), -1)


def _values(table: np.ndarray, index: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pooled values only, without the places."""
    ends = np.cumsum(size)
    begin, n, column, some = ends - size, len(index), 0, size > 0
    value = np.zeros((len(size), len(WIDTHS) * FILTERS), np.float32)
    if n:
        left = np.repeat(ends, size) - np.arange(n)
        rows = table[index]
        for k, width in enumerate(WIDTHS):
            total = rows[:, column : column + FILTERS]
            for j in range(1, width):
                total = total.copy() if j == 1 else total
                total[: n - j] += rows[j:, column + j * FILTERS : column + (j + 1) * FILTERS] * (left[: n - j, None] > j)
            column += width * FILTERS
            value[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(total, begin[some])
    return value


def held_out(doc_id: str) -> Column:
    """True for the fifth of the ids that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def marked(labels: DataFrame, *, doc_id: str, toxic: str) -> DataFrame:
    """(_id, _y) of the labelled ids outside the held-out fifth."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(doc_id))
    return known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("_y"))


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def labelled(docs: DataFrame, marks: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """(_id, _y, _text) of every marked document, in shards of about SHARD_ROWS rows and SHARD_BYTES of text by the id. Of texts that share an id the least counts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-marks.count() // SHARD_ROWS), -(-size // SHARD_BYTES))
    own = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    met = own.repartition(shards, "_id").join(marks.repartition(shards, "_id"), "_id")
    return met.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).sortWithinPartitions("_id")


def _rest(model: Model) -> np.ndarray:
    """All values but the vectors of the buckets."""
    return np.concatenate([p.ravel() for p in (*model.filters, model.bias, model.weight, np.array([model.base]))]).astype(np.float32)


def _shaped(embed: np.ndarray, rest: np.ndarray) -> Model:
    shapes = [*[(w, DIM, FILTERS) for w in WIDTHS], (len(WIDTHS) * FILTERS,), (len(WIDTHS) * FILTERS,), (1,)]
    ends = np.cumsum([np.prod(x) for x in shapes])
    *filters, bias, weight, base = [rest[e - np.prod(x) : e].reshape(x) for e, x in zip(ends, shapes)]
    return Model(embed, filters, bias, weight, float(base[0]))


def mean_model(rows: DataFrame) -> Model | None:
    """The mean of the models of all shards: a bucket's vector by the texts of each shard that have it, the rest by the shards' rows.

    A shard gives the vectors that its texts have, in parts of PART buckets, and the rest as part -1; each part is averaged in a task, so the driver
    gets one model however many the shards. A bucket of no text keeps its start.
    """
    names = ["part", "first", "at", "weight", "value"]
    kinds = "part int, first long, at binary, weight binary, value binary"

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, labels, first = Words(), [], None
        for batch in batches:
            if first is None and len(batch):
                first = zlib.crc32(str(batch.column(0)[0].as_py()).encode())  # orders the shards
            labels += batch.column(1).to_pylist()
            for a, b in slices(batch.column(2)):
                for t in batch.column(2).slice(a, b - a).to_pylist():
                    words.add(t)
        if labels:
            model, seen = trained(words, labels)
            at, rest = np.flatnonzero(seen), _rest(model)
            told = [(-1, np.arange(len(rest)), np.full(len(rest), len(labels)), rest)]
            told += [(int(own[0]) // PART, own, seen[own], model.embed[own]) for own in np.split(at, np.flatnonzero(np.diff(at // PART)) + 1) if len(own)]
            columns = [pa.array([x[0] for x in told], pa.int32()), pa.array([first] * len(told), pa.int64())]
            columns += [pa.array([x[k].astype(kind).tobytes() for x in told], pa.binary()) for k, kind in ((1, np.int32), (2, np.int32), (3, np.float32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    def mean(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        base, n, width = (0, len(table["at"][0].as_buffer()) // 4, 1) if part < 0 else (part * PART, PART, DIM)
        total, weight = np.zeros((n, width)), np.zeros((n, 1))
        table = table.sort_by("first")
        for a, w, v in zip(table["at"], table["weight"], table["value"]):
            own = np.frombuffer(a.as_buffer(), np.int32) - base
            by = np.frombuffer(w.as_buffer(), np.int32).astype(np.float64)[:, None]
            total[own] += np.frombuffer(v.as_buffer(), np.float32).reshape(-1, width) * by
            weight[own] += by
        own = np.flatnonzero(weight[:, 0])
        found = [np.int32(own + base).tobytes(), np.float32(total[own] / weight[own]).tobytes()]
        return pa.table({"part": table["part"][:1], **{k: pa.array([x], pa.binary()) for k, x in zip(("at", "value"), found)}})

    parts = rows.select("_id", "_y", "_text").mapInArrow(shard, kinds).groupBy("part").applyInArrow(mean, "part int, at binary, value binary").collect()
    embed, rest = started(np.random.default_rng(SEED)), None
    for r in parts:
        value = np.frombuffer(r["value"], np.float32)
        if r["part"] < 0:
            rest = value
        else:
            embed[np.frombuffer(r["at"], np.int32)] = value.reshape(-1, DIM)
    return None if rest is None else _shaped(embed, rest)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", calibrated: bool = False) -> Model | None:
    """A model from every labelled document; None without both classes. `calibrated`: the rows of one fold stay out of it, for `shifts`."""
    marks = marked(labels, doc_id=doc_id, toxic=toxic)
    if calibrated:
        marks = marks.filter(fold("_id") != FOLD)
    known = marks.join(docs.select(F.col(doc_id).alias("_id")), "_id", "left_semi")
    if known.agg(F.count_distinct("_y")).first()[0] < 2:
        return None
    return mean_model(labelled(docs, marks, doc_id=doc_id, text=text))


def shifts(scored: DataFrame, labels: DataFrame) -> dict[str | None, float]:
    """What `calibrate` does, from all rows of the fold that wasn't fitted: each language's shift. Logits count in steps of 1 / STEPS.

    scored: doc_id, logit, language (a place in FUNCTION_WORDS, or -1).
    """
    marks = marked(labels, doc_id="doc_id", toxic="toxic").filter(fold("_id") == FOLD)
    steps = scored.join(marks, scored["doc_id"] == marks["_id"]).select("language", F.floor(F.col("logit") * STEPS).alias("bin"), "_y")
    counts = steps.groupBy("language", "bin").agg(F.sum("_y").alias("pos"), F.count("*").alias("n")).collect()  # steps of a logit within bounds
    rows = np.array([[r["language"], r["bin"], r["pos"], r["n"]] for r in counts], np.int64).reshape(-1, 4)
    enough = lambda part: min(part[:, 2].sum(), (part[:, 3] - part[:, 2]).sum()) >= 2 * MIN_POSITIVE
    if not enough(rows):
        return {}
    every, place = np.unique(rows[:, 1], return_inverse=True)
    both = np.stack([np.bincount(place, rows[:, k]).astype(np.int64) for k in (2, 3)], 1)
    out: dict[str | None, float] = {None: best_step(every, both)}
    for k, name in enumerate(FUNCTION_WORDS):
        own = rows[rows[:, 0] == k]
        if enough(own):
            out[name] = best_step(own[:, 1], own[:, 2:])
    return out


def best_step(step: np.ndarray, counts: np.ndarray) -> float:
    """`best_threshold` of rows that are counted by step: (positives, rows) of each."""
    order = np.argsort(-step)
    step, counts = step[order], np.cumsum(counts[order], 0)
    best = int(np.argmax(2 * counts[:, 0] / (counts[:, 1] + counts[-1, 0])))
    lower = step[best + 1] if best + 1 < len(step) else step[best] - 1
    return float(step[best] + lower + 1) / 2 / STEPS


def score(docs: DataFrame, model: Model | None, *, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the score of every whole text."""
    scorer = Scorer(model)
    work = lambda texts: [pa.array(scorer([t or "" for t in texts]), pa.float64())]
    return add_columns(docs, text, T.StructType([T.StructField(out, T.DoubleType())]), work, keep)


def thresholds(scored: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", lang: str = "lang", toxic: str = "toxic", score: str = "score") -> DataFrame:
    """(lang, every, threshold) of the best F1 for each language, and for all (`every`), from the labels of the held-out fifth, which no model has fitted. Scores count in steps of 0.01."""
    marks = labels.filter(F.col(toxic).isNotNull() & held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("y"))
    steps = scored.join(marks, scored[doc_id] == marks["_id"]).select(F.col(lang).alias("lang"), F.floor(F.col(score) * 100).alias("bin"), "y")
    one = steps.groupBy("lang", "bin").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).withColumn("every", F.lit(False))
    every = one.groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "pos", "n", F.lit(True).alias("every"))
    both = one.unionByName(every)
    group = Window.partitionBy("lang", "every")
    above = group.orderBy(F.desc("bin"))
    both = both.withColumn("hit", F.sum("pos").over(above)).withColumn("flagged", F.sum("n").over(above)).withColumn("all", F.sum("pos").over(group))
    f1 = 2 * F.col("hit") / (F.col("flagged") + F.col("all"))
    # Of equally good thresholds the one in the middle of the gap: between this step and the next one below that has rows.
    lower = F.coalesce(F.lead("bin").over(above), F.lit(0))
    both = both.withColumn("f1", f1).withColumn("threshold", (F.col("bin") + lower + 1) / 200.0)
    best = both.filter(F.col("all") >= MIN_POSITIVE).withColumn("turn", F.row_number().over(group.orderBy(F.desc("f1"), F.desc("bin"))))
    return best.filter("turn = 1").select("lang", "every", "threshold")


def with_thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """`scored` (with doc_id, lang, score) and `threshold`: that of its language, else of all, else 0.5."""
    found = thresholds(scored, labels)
    each = found.filter("not every").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_each"))
    every = found.filter("every").agg(F.max("threshold").alias("_every"))
    out = scored.join(F.broadcast(each), scored["lang"].eqNullSafe(each["_lang"]), "left")  # one row per labelled language
    out = out.join(F.broadcast(every), F.lit(True), "left")
    return out.select(*[scored[c] for c in scored.columns], F.coalesce("_each", "_every", F.lit(0.5)).alias("threshold"))


def flag(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic") -> DataFrame:
    """Per row: doc_id, lang, score, threshold (its language's, else that of all, else 0.5) and `toxic`."""
    model = fit(docs, labels, doc_id=doc_id, text=text, toxic=toxic)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    scored = cut(score(own, model, keep=["doc_id", "lang"]))
    out = with_thresholds(scored, labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")))
    return out.withColumn("toxic", F.col("score") >= F.col("threshold"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", **names: str) -> DataFrame:
    """The rows of `docs` that are not flagged; of rows that share an id none stays if one is flagged."""
    return without(docs, flag(docs, labels, doc_id=doc_id, **names).filter("toxic").select("doc_id"), doc_id)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (calibrated by the text's language), predicted (0.5 or more). No label of the held-out fifth is used."""
    model = fit(docs, labels, calibrated=True)
    if model is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scorer = Scorer(model)

        def work(texts: list) -> list[pa.Array]:
            logit, language = scorer.logits([t or "" for t in texts])
            return [pa.array(logit, pa.float64()), pa.array(language, pa.int32())]

        told = T.StructType([T.StructField("logit", T.DoubleType()), T.StructField("language", T.IntegerType())])
        found = cut(add_columns(docs.select("doc_id", "text"), "text", told, work, ["doc_id"]))
        moved = shifts(found, labels)
        other = moved.get(None, 0.0)
        shift = F.get(F.array(*[F.lit(moved.get(name, other)) for name in FUNCTION_WORDS]), F.col("language"))
        logit = F.col("logit") - F.coalesce(shift, F.lit(other))
        scored = found.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
