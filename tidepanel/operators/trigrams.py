"""Substring search by an index of trigrams: posting lists narrow a search to candidates, which are then verified in their texts.

A posting row holds one trigram and the ids of a batch of documents (BATCH at most) that have it, so no list grows with the corpus. The
index is written in the order of the trigrams, whose ranges the reader skips by. A search takes the RAREST rarest trigrams of each term; documents
that have them all are candidates. Terms shorter than a trigram are looked for in every text.

Cases: upper and lower case are one; null texts are empty; a document without id is looked at in every search; ids may repeat, each row is
verified; the empty term is in every document; a term with a trigram that no document has finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.session import cut, shared_dir

RAREST = 3
BATCH = 10_000  # documents of a posting list; the batches that Spark sends are no larger
PIECE_BYTES = 4 << 20  # text whose trigrams a task sorts at once; memory, not results, depends on it
BROADCAST_ROWS = 100_000
POSTINGS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])


def grams_of(text: str) -> np.ndarray:
    """The different trigrams of a text, three code points of 21 bits each in one number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.empty(0, np.int64)


def grams_of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, place of its text) of all different pairs, in that order; all texts are told and sorted at once."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = max(0, len(points) - 2)
    place = np.repeat(np.arange(len(texts)), size)
    inside = place[:n] == place[2:]
    alphabet = np.flatnonzero(np.bincount(points, minlength=1))
    if len(alphabet) ** 3 * max(1, len(texts)) >= 1 << 63:  # a pair has no room in one number
        own = [grams_of(t) for t in texts]
        gram, place = np.concatenate(own), np.repeat(np.arange(len(texts)), [len(g) for g in own])
        order = np.lexsort((place, gram))
        return gram[order], place[order]
    dense = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    sign, base = dense[points], len(alphabet)
    pair = (((sign[:n] * base + sign[1 : n + 1]) * base + sign[2:]) * len(texts) + place[:n])[inside]
    pair.sort()
    pair = pair[np.diff(pair, prepend=-1) != 0]
    code, place = np.divmod(pair, max(1, len(texts)))
    first, last = np.divmod(code, base * base or 1)
    second, third = np.divmod(last, base or 1)
    return alphabet[first] << 42 | alphabet[second] << 21 | alphabet[third], place


def spread(rows: DataFrame) -> DataFrame:
    """`rows` in a partition for each BATCH of them (spark.sql.shuffle.partitions at most), if they come in fewer than the cores, as from a small file."""
    spark = rows.sparkSession
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BATCH))
    if wanted < 2 or rows.select(F.spark_partition_id()).distinct().count() >= min(wanted, spark.sparkContext.defaultParallelism):
        return rows
    return rows.repartition(wanted)


def pieces(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with BATCH rows and PIECE_BYTES of text at most; a longer text stands alone."""
    ends, first = np.cumsum(size, dtype=np.int64), 0
    while first < len(size):
        before = ends[first - 1] if first else 0
        last = min(first + BATCH, max(first + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right"))))
        yield first, last
        first = last


def build(docs: DataFrame, doc_id: str, text: str, folder: str | None = None) -> DataFrame:
    """The postings of all documents, written to the shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
                part = batch.slice(first, last - first)
                part = part.take(pc.sort_indices(part.column(0)))
                gram, place = grams_of_texts([t or "" for t in part.column(1).to_pylist()])
                if not len(gram):
                    continue
                ids = part.column(0).to_numpy()[place]
                begin = np.flatnonzero(np.diff(gram, prepend=-1))
                offsets = pa.array(np.append(begin, len(gram)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(gram[begin]), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=POSTINGS.names)

    known = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.lower(text).alias("text"))
    spread(known).mapInArrow(run, POSTINGS).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(folder)
    return spark.read.schema(POSTINGS).parquet(folder)


def candidates(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(term, id) of the documents that have the rarest trigrams of a term; terms of three code points or more."""
    spark = postings.sparkSession
    asked = [(t, int(g)) for t in terms for g in grams_of(t)]
    wanted = spark.createDataFrame(asked, "term string, gram long")  # a term's length
    grams = sorted({g for _, g in asked})
    met = postings.filter(F.col("gram").isin(grams))  # reaches the file's statistics
    often = {r["gram"]: r["n"] for r in met.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}
    picked = [(t, g) for t in terms for own in [[int(g) for g in grams_of(t)]] if all(g in often for g in own) for g in sorted(own, key=lambda g: (often[g], g))[:RAREST]]
    if not picked:
        return wanted.select("term", F.col("gram").alias("id")).limit(0)
    # A bit for each picked trigram of a term: ids are met once, however often a list repeats them.
    bits = [(t, g, 1 << [h for x, h in picked if x == t].index(g)) for t, g in picked]
    need = spark.createDataFrame([(t, (1 << sum(x == t for x, _ in picked)) - 1) for t in {t for t, _ in picked}], "term string, need int")
    few = postings.filter(F.col("gram").isin(sorted({g for _, g in picked}))).join(F.broadcast(spark.createDataFrame(bits, "term string, gram long, bit int")), "gram")
    have = few.select("term", F.explode("ids").alias("id"), "bit").groupBy("term", "id").agg(F.bit_or("bit").alias("have"))
    return have.join(F.broadcast(need), "term").filter("have = need").select("term", "id")


def search(docs: DataFrame, postings: DataFrame, terms: list[str], doc_id: str, text: str) -> DataFrame:
    """`term` and the columns of `docs`: every row whose text holds a term anywhere, whatever the case."""
    spark = docs.sparkSession
    lowered = {t: r for t, r in zip(terms, [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string").orderBy("i").select(F.lower("t")).collect()])}
    long = sorted({t for t in lowered.values() if len(t) >= 3})
    names = spark.createDataFrame(list(lowered.items()), "term string, _low string")
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    short = docs.join(F.broadcast(names.filter(F.length("_low") < 3)), body.contains(F.col("_low")))
    without_id = docs.filter(F.col(doc_id).isNull()).join(F.broadcast(names.filter(F.length("_low") >= 3)), body.contains(F.col("_low")))
    out = short.unionByName(without_id)
    if long:
        found = cut(candidates(postings, long).select(F.col("term").alias("_low"), F.col("id").alias("_id")))  # counted and joined
        found = F.broadcast(found) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found
        verified = docs.join(found, docs[doc_id] == F.col("_id")).filter(body.contains(F.col("_low"))).join(F.broadcast(names), "_low")
        out = out.unionByName(verified.select(*docs.columns, "term", "_low"))
    return out.select("term", *docs.columns)
