"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and a perplexity per document.

Units are the 16-bit code units of UTF-16, ORDER of them in one long, so every character keeps its own code. The model is
what trusted documents (labelled quality 1) hold, but for a fold of them (`held_out`, by a hash of the id) that only sets the cuts;
its counts grow with them. The highest order has raw counts, lower orders count distinct left neighbours; each order has
three discounts from its counts of counts; probabilities are interpolated down to a uniform one over all codes.

Everything about counts is a join of tables sharded by n-gram: raw and continuation counts, sums per context, and the n-grams
that documents ask for. Documents never become n-gram rows one by one. They are read in blocks (BLOCK_BYTES of text); a
block asks once for each different n-gram in it. The answers are shuffled back to the block and meet its texts, which travel
packed; there each document's sum is a numpy gather, PIECE units at a time.

Thresholds: each language's cut is the quantile of its trusted, held-out documents at which the labelled documents have the fewest
errors (`cuts`), exact up to BIN, from a histogram of all of them.

Scale: a task holds one block and its different n-grams; a text that is longer is a block of its own and is counted piece by piece.
The count tables are joined by shuffle; blocks are dealt to at most MAX_PARTITIONS partitions, many to each. The table of labels is
broadcast only while it has at most BROADCAST_ROWS rows, otherwise the documents are joined by shuffle and written once. The input
has to be one that yields the same rows in the same order each time it is read, such as files; block numbers rely on that.

Cases: null is the empty text; it has one n-gram, the end sign, and is judged like any other; a null language is a language;
without trusted text all n-grams are equally likely and nothing is rejected; a language without held-out trusted documents takes
the cut of all languages; rows that share an id are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import release, slices, without
from tidepanel.session import shared_dir

ORDER = 4
BITS = 16
CODES = 1 << BITS
START, END = 0xD800, 0xD8C0  # high surrogates of a block without letters and of an unassigned plane; alone they stand in no text
BLOCK_BYTES = 4 << 20
PACK_BYTES = 1 << 20
PIECE = 1 << 19  # units that are numbered at once
TABLE = 1 << 22  # entries of a lookup table in a task
MAX_PARTITIONS = 100_000
FOLDS = 5  # one of them is held out of the model
BROADCAST_ROWS = 2_000_000
BIN = 0.001
UPPER_QUANTILE = 0.99  # of trusted documents, where a language has none labelled quality 0


def units(text: str) -> np.ndarray:
    """START signs, the text's UTF-16 code units, and END."""
    own = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return np.concatenate([np.full(ORDER - 1, START, np.uint16), own, np.array([END], np.uint16)])


def groups(texts: list[str]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The texts' units as (number of the text, piece), with ORDER - 1 units before each piece; about PIECE units at a time."""
    out, size = [], 0
    for i, text in enumerate(texts):
        own = units(text)
        for at in range(0, len(own) - ORDER + 1, PIECE):
            out.append((i, own[at : at + PIECE + ORDER - 1]))
            size += len(out[-1][1])
            if size >= PIECE:
                yield out
                out, size = [], 0
    if out:
        yield out


def numbered(before: np.ndarray, n_before: int, sign: np.ndarray, n_signs: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of the pairs (before, sign), and the pairs as before * n_signs + sign in the order of the numbers."""
    key = before.astype(np.int64) * n_signs + sign
    if n_before * n_signs > TABLE:
        found, number = np.unique(key, return_inverse=True)
        return number.astype(np.int32), found
    seen = np.zeros(n_before * n_signs, bool)
    seen[key] = True
    found = np.flatnonzero(seen)
    number = np.empty(len(seen), np.int32)
    number[found] = np.arange(len(found), dtype=np.int32)
    return number[key], found


def ngrams(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the n-gram at each place, the different n-grams, how many places each array of units has)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts)
    alphabet = np.flatnonzero(np.bincount(flat, minlength=CODES))
    dense = np.zeros(CODES, np.int32)
    dense[alphabet] = np.arange(len(alphabet))
    sign = dense[flat]
    number, gram = sign, alphabet.astype(np.int64)
    for _ in range(ORDER - 1):
        # Runs over an array's border arise too; their places are left out below.
        number, found = numbered(number[:-1], len(gram), sign[len(sign) - len(number) + 1 :], len(alphabet))
        gram = gram[found // len(alphabet)] << BITS | alphabet[found % len(alphabet)]
    begin = np.cumsum(size) - size
    inside = np.ones(len(flat), bool)
    for j in range(ORDER - 1):
        inside[begin[1:] - 1 - j] = False
    return number[inside[: len(number)]], gram, size - (ORDER - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(block number, its rows) in the order of the task's input."""
    part, seq, rows, size = 0, 0, [], 0
    for batch in batches:
        for first, last in slices(batch.column(1)):  # not all of a batch at once as Python objects
            for *row, part in zip(*(c.to_pylist() for c in batch.slice(first, last - first).columns)):
                rows.append(row)
                size += len(row[1] or "") + 16
                if size >= BLOCK_BYTES:
                    yield part << 32 | seq, rows
                    seq, rows, size = seq + 1, [], 0
    if rows:
        yield part << 32 | seq, rows
    release()


ASKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("g", T.LongType()), T.StructField("n", T.LongType())])
PACKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("g", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("pack", T.BinaryType())])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("n_grams", T.LongType()), T.StructField("nats", T.DoubleType())])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's different n-grams with their count in the block's texts of the model (label 1)."""
    for block, rows in _blocks(batches):
        found, times = [], []
        for group in groups([r[1] or "" for r in rows]):
            number, gram, size = ngrams([u for _, u in group])
            trusted = np.repeat(np.array([rows[i][3] == 1 for i, _ in group]), size)
            here = np.bincount(number, minlength=len(gram)) > 0  # runs over a border have no place
            found.append(gram[here])
            times.append(np.bincount(number[trusted], minlength=len(gram))[here])
        gram, at = np.unique(np.concatenate(found), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(times)).astype(np.int64)
        for at in range(0, len(gram), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram[part]), block)), pa.array(gram[part]), pa.array(count[part])], names=ASKED.names)


def _row_table(rows: list[tuple]) -> bytes:
    columns = zip(*rows)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text", "lang", "label"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's rows, compressed, some at a time."""
    for block, rows in _blocks(batches):
        first, size = 0, 0
        for i, r in enumerate(rows):
            size += len(r[1] or "")
            if size >= PACK_BYTES or i + 1 == len(rows):
                pack = _row_table(rows[first : i + 1])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([pack], pa.binary())], names=PACKED.names)
                first, size = i + 1, 0


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, the n-grams' probabilities before the packs."""
    now, gram, nats, parts, done = None, np.empty(0, np.int64), np.empty(0), [], True
    for batch in batches:
        block, g, p = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(3))  # a null would make g a double
        is_pack = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (is_pack[1:] | is_pack[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            if block[a] != now:
                now, parts, done = block[a], [], False
            if not is_pack[a]:
                parts.append((g[a:b], p[a:b]))
                continue
            if not done:
                gram, nats = np.concatenate([x[0] for x in parts]), -np.log(np.concatenate([x[1] for x in parts]))
                order = np.argsort(gram)
                gram, nats, parts, done = gram[order], nats[order], [], True
            with pa.ipc.open_stream(batch.column(3)[a].as_buffer()) as r:
                rows = r.read_all()
            count, sums = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for group in groups([t or "" for t in rows["text"].to_pylist()]):
                number, own, size = ngrams([u for _, u in group])
                at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
                used = np.bincount(number, minlength=len(own)) > 0
                if (gram[at] != own)[used].any():
                    raise RuntimeError("a block was read again in another order; give files or a checkpoint")
                row = np.array([i for i, _ in group])
                np.add.at(count, row, size)
                np.add.at(sums, row, np.add.reduceat(nats[at][number], np.cumsum(size) - size))
            yield pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("doc_id", "lang", "label")), pa.array(count), pa.array(sums)], names=SCORED.names)
    release()


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order, from how many n-grams have a count of 1, 2, 3 and 4."""
    n = {r["n"]: r["m"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def probabilities(asked: DataFrame) -> DataFrame:
    """(g, p) for every different n-gram of `asked` (block, g, n), under the model of the counts n."""
    suffix = lambda k: F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
    total = _stored(asked.groupBy("g").agg(F.sum("n").alias("n")), "ngram-counts")
    wanted, counts = {ORDER: total.select("g")}, {ORDER: total.filter("n > 0")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(suffix(k).alias("g")).distinct()
        counts[k] = counts[k + 1].groupBy(suffix(k).alias("g")).agg(F.count("*").alias("n"))
    known = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[k])
        context = F.shiftrightunsigned("g", BITS)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        sums = counts[k].groupBy(context.alias("h")).agg(F.sum("n").alias("all"), F.sum(discount).alias("held"))
        rows = wanted[k].join(counts[k], "g", "left").withColumn("h", context).join(sums, "h", "left")
        if known is None:
            lower = F.lit(1.0 / CODES)
        else:
            rows = rows.withColumn("s", suffix(k - 1)).join(known.select(F.col("g").alias("s"), F.col("p").alias("low")), "s")
            lower = F.col("low")
        seen = F.coalesce((F.col("n") - discount) / F.col("all"), F.lit(0.0))
        known = rows.select("g", (seen + F.coalesce(F.col("held") / F.col("all"), F.lit(1.0)) * lower).alias("p"))
        if k == ORDER - 2:
            known = _stored(known, "ngram-probabilities")
    return known


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a trusted document sets the cuts and stays out of the model."""
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)) == 0


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, lang, label (1 trusted, 0 not, null unknown), n_grams, nats (negative log-likelihood), perplexity."""
    spark = docs.sparkSession
    marks = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(quality).cast("int").alias("label"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    small = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = own.join(F.broadcast(marks) if small else marks, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "lang", "label")
    if not small:
        own = _stored(own, "labelled-documents")
    own = own.withColumn("part", F.spark_partition_id())
    fitted = own.withColumn("label", F.when(~held_out(), F.col("label")))
    asked = _stored(fitted.mapInArrow(_asked, ASKED), "asked-ngrams")
    answers = asked.select("block", "g").join(probabilities(asked), "g").select("block", "g", "p", F.lit(None).cast("binary").alias("pack"))
    both = answers.unionByName(own.mapInArrow(_packs, PACKED))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(asked.select("block").distinct().count(), MAX_PARTITIONS))
    met = both.repartition(n, "block").sortWithinPartitions("block", F.col("pack").isNotNull())
    return met.mapInArrow(_scores, SCORED).withColumn("perplexity", F.exp(F.col("nats") / F.col("n_grams")))


def cuts(scored: DataFrame) -> DataFrame:
    """(lang, cut) in nats a unit: the step of the labelled rows' histogram with the fewest errors (held-out trusted rows above, label 0 at
    or below), of equal steps the highest, midway to the next labelled row; `lang` null and `every` true: all languages. A language
    without rows labelled 0 takes the quantile UPPER_QUANTILE of its held-out trusted rows."""
    bins = scored.filter((F.col("label") == 0) | (F.col("label") == 1) & held_out()).withColumn("bin", F.round(F.col("nats") / F.col("n_grams") / BIN).cast("long"))
    counted = bins.groupBy("lang", "bin").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    counted = counted.select("lang", F.lit(False).alias("every"), "bin", "good", "bad").unionByName(
        counted.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("every"), "bin", "good", "bad")
    )
    group = Window.partitionBy("lang", "every")
    upto = group.orderBy("bin")
    part = counted.select(
        "lang", "every", "bin", "bad", "good", F.lead("bin").over(upto).alias("next"), F.sum("good").over(upto).alias("kept"),
        F.sum("good").over(group).alias("all_good"), F.sum("bad").over(upto).alias("missed"),
    )
    wrong = F.col("all_good") - F.col("kept") + F.col("missed")
    ends = part.groupBy("lang", "every").agg(
        F.max("all_good").alias("all_good"),
        F.sum("bad").alias("all_bad"),
        F.min(F.when(F.col("kept") >= UPPER_QUANTILE * F.col("all_good"), F.col("bin"))).alias("high"),
        F.min_by(F.struct("bin", "next"), F.struct(wrong, -F.col("bin"))).alias("best"),
    )
    middle = (F.col("best.bin") + F.coalesce(F.col("best.next"), F.col("best.bin") + 1)) / 2
    return ends.filter("all_good > 0").select("lang", "every", (F.when(F.col("all_bad") > 0, middle).otherwise(F.col("high") + 0.5) * BIN).alias("cut"))


def judge(scored: DataFrame) -> DataFrame:
    """`scored` with `cut` (a perplexity) and `rejected`."""
    scored = _stored(scored, "perplexities")
    found = cuts(scored)
    own = found.filter("not every").select(F.col("lang").alias("_lang"), F.col("cut").alias("own_cut"))
    every = found.filter("every").select(F.col("cut").alias("every_cut"))
    out = scored.join(own, scored["lang"].eqNullSafe(own["_lang"]), "left").join(F.broadcast(every), F.lit(True), "left")
    cut = F.coalesce("own_cut", "every_cut")
    return out.select(*scored.columns, F.exp(cut).alias("cut"), F.coalesce(F.col("nats") / F.col("n_grams") > cut, F.lit(False)).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", **names: str) -> DataFrame:
    """The rows of `docs` that are not rejected; of rows that share an id none stays if one is rejected."""
    judged = judge(score(docs, labels, doc_id=doc_id, **names))
    return without(docs, judged.filter("rejected").select("doc_id"), doc_id)
