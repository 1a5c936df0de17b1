"""Exact dedup by content-defined chunk recipes: long texts are compared as ordered lists of chunk identifiers.

A text (runs of ASCII white space become one space) is cut where a gear hash of the last GEAR bytes has zero high bits, no sooner
than LEAST bytes after the last cut and no later than MOST. The cut depends on the bytes alone, so equal texts have equal chunks, and copied
passages share most of theirs. A chunk is known by the first `width` bytes of its 128-bit hash. These identifiers are verified, not
trusted: every different chunk is moved once, to its identifier, and an identifier with two contents makes all of them wider until
none is left. From then on identifier and content are one to one, so two texts are equal if and only if their recipes
(ordered identifiers) are, and only recipes are grouped and joined.

Scale: texts are read twice (recipes; chunks) and never shuffled. Chunks are made distinct in each slice of text and again before
the shuffle, so a passage that everybody shares travels once per task. Rows of one text are counted in SALTS parts before their recipe
is, and meet the result in the same parts, so that a text which a third of all rows have isn't one task's work.

Cases: null is the empty text, which has the empty recipe; a text of white space only is one space; of rows that share the
smallest id one stays; a null id is larger than any other, so such a row stays only where no row of the group has an id (keep_id is null
then); an empty table gives an empty result; other columns are ignored by `duplicate_groups` and kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import BROADCAST_IDS, add_columns, release, slices
from tidepanel.session import cut

LEAST, MOST = 1 << 10, 1 << 14
MEAN_BITS = 11  # a cut comes every 2^11 bytes on average, after the first LEAST
GEAR = 32
STEP = 1 << 20  # bytes that are hashed at once; cuts don't depend on it
WIDTH = 16
MAX_WIDTH = 64
SALTS = 32
SEED = 42
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalized(text: str | None) -> bytes:
    """The text's UTF-8 with one space for each run of ASCII white space."""
    out = (text or "").encode("utf-8", "surrogatepass").translate(BLANKS)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def gears() -> np.ndarray:
    """256 pseudo-random numbers, one for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), SEED) for b in range(256)], np.uint32)


def cut_candidates(flat: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The places after which a chunk may end: the sum of gears over the last GEAR bytes, each shifted by its distance, has zero high bits."""
    found = []
    for at in range(0, len(flat), STEP):
        first = max(0, at - GEAR + 1)
        h, reach = gear[flat[first : at + STEP]], 1
        while reach < GEAR:
            h[reach:] += h[:-reach] << np.uint32(reach)
            reach *= 2
        # The high bits depend on all GEAR bytes, the low ones on the last few only.
        ends = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + first
        found.append(ends[ends >= at] + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunks_of(texts: list[bytes], gear: np.ndarray) -> tuple[list[bytes], list[int]]:
    """All chunks of all texts, in order, and each text's number of them."""
    chunks, counts = [], []
    for text in texts:
        first, before = 0, len(chunks)
        if len(text) > LEAST:
            ends = cut_candidates(np.frombuffer(text, np.uint8), gear)
            while len(text) - first > LEAST:
                at = int(np.searchsorted(ends, first + LEAST))
                last = min(int(ends[at]) if at < len(ends) else len(text), first + MOST, len(text))
                chunks.append(text[first:last])
                first = last
        if first < len(text):
            chunks.append(text[first:])
        counts.append(len(chunks) - before)
    return chunks, counts


def identifier(chunk: bytes, width: int) -> bytes:
    """The first `width` bytes of the chunk's hashes under one seed after another."""
    out = xxhash.xxh3_128_digest(chunk, SEED)
    while len(out) < width:
        out += xxhash.xxh3_128_digest(chunk, SEED + len(out))
    return out[:width]


def recipes(docs: DataFrame, width: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the digest of the normalized text, and its chunks' identifiers in order."""
    added = T.StructType([T.StructField("text_sha256", T.StringType()), T.StructField("recipe", T.BinaryType())])
    gear = gears()

    def work(texts: list) -> list[pa.Array]:
        plain = [normalized(t) for t in texts]
        chunks, counts = chunks_of(plain, gear)
        ids, at, out = [identifier(c, width) for c in chunks], 0, []
        for n in counts:
            out.append(b"".join(ids[at : at + n]))
            at += n
        return [pa.array([hashlib.sha256(t).hexdigest() for t in plain], pa.string()), pa.array(out, pa.binary())]

    return add_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", added, work, keep=["doc_id"])


def distinct_chunks(docs: DataFrame, width: int, *, text: str = "text") -> DataFrame:
    """Every different (identifier, chunk) of the texts once."""
    schema = T.StructType([T.StructField("id", T.BinaryType()), T.StructField("chunk", T.BinaryType())])
    gear = gears()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(0)):
                texts = batch.column(0).slice(first, last - first).to_pylist()
                chunks = list(dict.fromkeys(chunks_of([normalized(t) for t in texts], gear)[0]))
                yield pa.RecordBatch.from_arrays([pa.array([identifier(c, width) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())], names=schema.names)
        release()

    return docs.select(text).mapInArrow(run, schema).distinct()


def verified_recipes(docs: DataFrame, *, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`recipes` under identifiers that are known to stand for one content each."""
    while width <= MAX_WIDTH:
        if distinct_chunks(docs, width, text=text).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return recipes(docs, width, doc_id=doc_id, text=text)
        width *= 2
    raise RuntimeError("identifiers of 64 bytes stand for different chunks: the hash is at fault")


def duplicate_groups(docs: DataFrame, *, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = cut(verified_recipes(docs, width=width, doc_id=doc_id, text=text)).withColumn("salt", salt)
    # Rows that share id and text are one row with their number here, and rows again below.
    own = rows.groupBy("recipe", "salt", "doc_id", "text_sha256").agg(F.count("*").alias("_n"))
    parts = own.groupBy("recipe", "salt").agg(F.min("doc_id").alias("_least"), F.sum("_n").alias("_size"))
    whole = parts.groupBy("recipe").agg(F.min("_least").alias("keep_id"), F.sum("_size").alias("group_size"))
    told = parts.select("recipe", "salt").join(whole, "recipe")
    each = own.join(told, ["recipe", "salt"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_at"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_at") == 1)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, *, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each different text, with all columns: the one with the smallest id.

    Texts stay where they are as long as at most BROADCAST_IDS rows go; more of them meet the documents by shuffle.
    """
    mark = "_sha"
    while mark in docs.columns:
        mark += "_"
    groups = duplicate_groups(docs, width=width, doc_id=doc_id, text=text)
    rows = cut(groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).filter("not _kept or _n > 1"))
    marked = docs.withColumn(mark, F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256))

    def met(keys: DataFrame, how: str, of: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_of"))
        few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return of.join(F.broadcast(keys) if few else keys, of[doc_id].eqNullSafe(keys["_id"]) & (of[mark] == keys["_of"]), how)

    kept = met(rows, "left_anti", marked)
    twins = rows.filter("_kept")
    if not twins.isEmpty():  # only rows that share id and text are gathered by them
        kept = kept.unionByName(met(twins, "left_semi", marked).dropDuplicates([doc_id, mark]))
    return kept.drop(mark)


#: DuckDB SQL for `duplicate_groups` of the table `documents`.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain
  FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY plain) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
  row_number() OVER (PARTITION BY plain ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""
