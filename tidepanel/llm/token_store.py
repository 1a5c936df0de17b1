"""Token ids in wavelet matrices: one compressed file per shard that answers access, count and occurrence queries.

A shard holds the ids of consecutive documents, by ascending doc_id, as a wavelet matrix: one bit-plane per bit of an id, from the
highest bit down; each plane lists the ids in the order that a stable split by the bits above leaves them in. Planes are
compressed in segments of SEGMENT bytes, and the file says how many ones stand before each of them. So rank takes one segment, select
a search and one segment, and a shard gives the id at any place, counts a token in any range and lists its places by unpacking
no more than the segments that these touch.

The file format (`to_bytes`): the magic `WVM2`, then n, levels and segment size as little-endian unsigned 64-bit integers;
for each level its segments' packed sizes and the ones before each segment and after the last, as unsigned 64-bit integers; then
the zstandard-packed segments. Spark writes each shard as one row of a Parquet file beside the ids and sizes of its
documents, into the shared folder, so a lost executor's shard is written again by another task.

Scale: documents are encoded where they are read, in one pass; what is shuffled once, by ranges of doc_id, are their
ids. The bounds of the ranges come from at most SAMPLE documents' ids and sizes, so ranges have about `shard_bytes` of text, or at
scale a MAX_RANGES-th of all; a task cuts its ranges into shards of at most SHARD_IDS ids (one longer document stands alone), in a stream, also where
one id holds many rows. A shard knows the ids before it in its range; across ranges only their sums are added up, one row each.

Cases: null is the empty text, which has the end id alone; a null doc_id comes first; rows that share a doc_id keep
together, ordered by their ids; an empty table makes no shard.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.bpe import Vocabulary, byte_signs
from tidepanel.llm.shared import add_columns
from tidepanel.session import shared_dir

BLOCK = 512  # bits
SEGMENT = 1 << 14
SHARD_BYTES = 4 << 20
SHARD_IDS = 4 << 20
MAX_RANGES = 20_000
SAMPLE = 400_000
MAGIC = b"WVM2"
KNOWN_CHUNKS = 400_000  # that a worker remembers


class Plane:
    """A bit-plane of n bits in compressed segments; `before` has the ones before each segment, and all of them."""

    def __init__(self, n: int, segments: list[bytes], before: np.ndarray):
        self.n, self.segments, self.before = n, segments, before
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        raw, codec = np.packbits(bits), pa.Codec("zstd", 1)
        parts = [raw[at : at + SEGMENT] for at in range(0, len(raw), SEGMENT)]
        ones = [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in parts]
        return cls(len(bits), [codec.compress(x, asbytes=True) for x in parts], np.append(0, np.cumsum(ones)).astype(np.int64))

    def _raw(self, i: int) -> np.ndarray:
        size = min(SEGMENT, (self.n + 7) // 8 - i * SEGMENT)
        return np.frombuffer(pa.Codec("zstd").decompress(self.segments[i], size), np.uint8)

    def bits(self) -> np.ndarray:
        """All bits, as booleans."""
        raw = [self._raw(i) for i in range(len(self.segments))]
        return np.unpackbits(np.concatenate(raw) if raw else np.empty(0, np.uint8), count=self.n).view(bool)

    def segment(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """A segment's bytes, and the ones of the plane before each of its blocks."""
        if i not in self._open:
            raw = self._raw(i)
            padded = np.zeros(SEGMENT + BLOCK // 8, np.uint8)
            padded[: len(raw)] = raw
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            self._open[i] = padded, self.before[i] + np.cumsum(ones) - ones
        return self._open[i]

    def _each(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each segment that places touch: which they are, their places in it, its bytes and its counts."""
        number = np.minimum(at // (8 * SEGMENT), len(self.segments) - 1)
        for i in np.unique(number):
            own = np.flatnonzero(number == i)
            yield own, at[own] - i * (8 * SEGMENT), *self.segment(int(i))

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for own, local, raw, _ in self._each(at):
            out[own] = raw[local >> 3] >> (7 - (local & 7)) & 1
        return out

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        out = np.zeros(len(at), np.int64)
        for own, local, raw, counts in self._each(at) if self.segments else ():
            block = local // BLOCK
            byte = (block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)
            left = np.clip(local[:, None] - byte * 8, 0, 8)
            mask = ((0xFF00 >> left) & 0xFF).astype(np.uint8)
            out[own] = counts[block] + np.bitwise_count(raw[byte] & mask).sum(1, dtype=np.int64)
        return out

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) one or zero."""
        starts = np.arange(len(self.before)) * (8 * SEGMENT)
        before = self.before if bit else starts - self.before
        number = np.searchsorted(before[:-1], k, "right") - 1
        out = np.empty(len(k), np.int64)
        for i in np.unique(number):
            own = np.flatnonzero(number == i)
            raw, _ = self.segment(int(i))
            places = np.flatnonzero(np.unpackbits(raw[:SEGMENT]) == bit)
            out[own] = i * (8 * SEGMENT) + places[k[own] - before[i]]
        return out


class WaveletMatrix:
    """A sequence of ids as bit-planes with counts."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes
        self.zeros = [n - int(p.before[-1]) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, now = [], ids
        for level in range(levels - 1, -1, -1):
            bit = now & now.dtype.type(1 << level) != 0
            planes.append(Plane.of(bit))
            # Places first, then a gather: twice as fast as picking by the booleans.
            now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))])
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        head = [struct.pack("<QQQ", self.n, len(self.planes), SEGMENT)]
        for p in self.planes:
            head += [np.array(list(map(len, p.segments)), "<u8").tobytes(), p.before.astype("<u8").tobytes()]
        return MAGIC + b"".join(head) + b"".join(s for p in self.planes for s in p.segments)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """The matrix of a file; segments are unpacked when they are asked for."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, levels, segment = struct.unpack_from("<QQQ", data, 4)
        if segment != SEGMENT:
            raise ValueError(f"segments of {segment} bytes")
        count = -(-((n + 7) // 8) // SEGMENT)
        numbers = np.frombuffer(data, "<u8", levels * (2 * count + 1), 28).astype(np.int64).reshape(levels, 2 * count + 1)
        at, planes = 28 + 8 * numbers.size, []
        for row in numbers:
            ends = at + np.cumsum(row[:count])
            planes.append(Plane(n, [data[e - k : e] for e, k in zip(ends.tolist(), row[:count].tolist())], row[count:]))
            at = int(ends[-1]) if count else at
        return cls(n, planes)

    def ids(self) -> np.ndarray:
        """The whole sequence: the splits undone from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level, (zeros, plane) in enumerate(zip(reversed(self.zeros), reversed(self.planes))):
            bit = plane.bits()
            back = np.empty_like(now)
            back[np.flatnonzero(~bit)] = now[:zeros]
            back[np.flatnonzero(bit)] = now[zeros:] | kind(1 << level)
            now = back
        return now

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for zeros, plane in zip(self.zeros, self.planes):
            bit, ones = plane.get(at), plane.rank(at)
            at = np.where(bit, zeros + ones, at - ones)
            out = (out << 1) | bit.astype(np.uint32)
        return out

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        for level, (zeros, plane) in enumerate(zip(self.zeros, self.planes)):
            ones = plane.rank(np.array([first, last]))
            if token >> (len(self.planes) - 1 - level) & 1:
                first, last = zeros + ones
            else:
                first, last = np.array([first, last]) - ones
        return int(first), int(last)

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often the token is in [first, last)."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, first, self.n if last is None else last)
        return high - low

    def occurrences(self, token: int) -> np.ndarray:
        """The places of the token, ascending."""
        if token >> len(self.planes) or not self.n:
            return np.empty(0, np.int64)
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self.planes[level].select(bit, at - (self.zeros[level] if bit else 0))
        return np.sort(at)


class _Encoder(Vocabulary):
    """The tokenizers library behind tables of chunks and words, so that it meets each word once.

    A word comes normalized and split as the vocabulary file says; the library's model gets it in the signs of its bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__(path, KNOWN_CHUNKS)
        self.model = Tokenizer.from_file(path).model
        self.sign = dict(enumerate(byte_signs()))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        shown = (w if w.isascii() else w.encode().decode("latin-1").translate(self.sign) for w in words)
        made = [[t.id for t in self.model.tokenize(w)] for w in shown]
        return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _encoded(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """Columns doc_id and ids (little-endian integers of `width` bytes, with the end id)."""
    added = T.StructType([T.StructField("ids", T.BinaryType())])

    def work(texts: list) -> list[pa.Array]:
        flat, n = _encoder(path).encode([t or "" for t in texts])
        whole = np.insert(flat, np.cumsum(n), end_id).astype(f"<u{width}")
        at = (np.append(0, np.cumsum(n + 1)) * width).astype(np.int32)
        return [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(whole)])]

    return add_columns(docs.select("doc_id", "text"), "text", added, work, ["doc_id"])


STORE = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("shard", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_sizes", T.ArrayType(T.LongType())),
        T.StructField("file", T.BinaryType()),
    ]
)


def _bounds(docs: DataFrame, range_bytes: int) -> np.ndarray:
    """The greatest doc_id of each range but the last, for ranges of about equal bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows, total = docs.agg(F.count("*"), F.sum(size)).first()
    n = min(MAX_RANGES, math.ceil((total or 0) / range_bytes))
    if n < 2:
        return np.empty(0, np.int64)
    sizes = docs.filter("doc_id is not null").select("doc_id", size.alias("size"))
    found = sizes.sample(min(1.0, SAMPLE / rows), 0).limit(2 * SAMPLE).toPandas().sort_values("doc_id")
    if found.empty:
        return np.empty(0, np.int64)
    upto = found["size"].cumsum().to_numpy()
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    return np.unique(found["doc_id"].to_numpy(np.int64)[at])


def write_store(docs: DataFrame, path: str, *, end_id: int, vocabulary_size: int = 49_408, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_ids: int = SHARD_IDS, folder: str | None = None) -> str:
    """Writes the ids of all documents in ascending order of doc_id, shard by shard; returns the folder."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    folder = folder or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    bounds = _bounds(docs, shard_bytes)
    n = len(bounds) + 1
    levels = max(1, (max(vocabulary_size - 1, end_id)).bit_length())
    width = 2 if levels <= 16 else 4
    coded = _encoded(docs, path, end_id, width)
    schema = T.StructType([T.StructField("range", T.IntegerType()), *coded.schema.fields])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.searchsorted(bounds, batch.column(0).fill_null(-(2**63)).to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *batch.columns], names=schema.names)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, before, held, ids, sizes, parts = None, 0, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            flat, size = np.concatenate(parts), np.concatenate(sizes)
            row = [[now], [now << 32 | seq], [len(size)], [len(flat)], [before]]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.array(size))]
            columns = [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *lists, pa.array([WaveletMatrix.build(flat, levels).to_bytes()], pa.binary())], names=STORE.names)

        for batch in batches:
            number, packed = batch.column(0).to_numpy(), batch.column(2)
            at = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset).astype(np.int64)
            flat = np.frombuffer(packed.buffers()[2], f"<u{width}", int(at[-1]) // width)
            size, at = np.diff(at) // width, at // width
            row = 0
            while row < len(number):
                if number[row] != now or held >= shard_ids:
                    if parts:
                        yield flush()
                    seq, before = (seq + 1, before + held) if number[row] == now else (0, 0)
                    now, held, ids, sizes, parts = int(number[row]), 0, [], [], []
                # Up to the end of the range, or to the row that fills the shard.
                end = int(np.searchsorted(number, now, "right"))
                end = min(end, max(row + 1, int(np.searchsorted(at, at[row] + shard_ids - held, "right"))))
                ids.append(batch.column(1).slice(row, end - row))
                sizes.append(size[row:end])
                parts.append(flat[at[row] : at[end]].copy())
                held += int(at[end] - at[row])
                row = end
        if parts:
            yield flush()

    dealt = coded.mapInArrow(assigned, schema).repartition(n, "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "ids")
    dealt.mapInArrow(shards, STORE).write.mode("errorifexists").option("compression", "uncompressed").parquet(folder)
    return folder


def read_store(spark, folder: str) -> DataFrame:
    """One row per shard with `start`, the ids in all shards before it."""
    store = spark.read.schema(STORE).parquet(folder)
    sums = store.groupBy("range").agg(F.sum("n_ids").alias("_own"))  # MAX_RANGES rows at most
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("_own").over(every), F.lit(0)).alias("_range_start"))
    return store.join(F.broadcast(starts), "range").withColumn("start", F.col("_range_start") + F.col("before")).drop("_range_start")


def documents_of(store: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, all from the ids that the shards' files give back."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                doc_ids, sizes = batch.column(0)[i].values, batch.column(1)[i].values
                flat = WaveletMatrix.from_bytes(batch.column(2)[i].as_py()).ids().astype("<u4")
                n, start = sizes.to_numpy(), batch.column(3)[i].as_py()
                ends, view = np.cumsum(n), memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=schema.names)

    return store.select("doc_ids", "doc_sizes", "file", "start").mapInArrow(run, schema)


def token_places(store: DataFrame, token: int) -> DataFrame:
    """Every occurrence of a token: shard and place in the whole sequence, by select alone."""
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = WaveletMatrix.from_bytes(file).occurrences(token) + start
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(at), pa.int64()), pa.array(at, pa.int64())], names=schema.names)

    return store.select("shard", "file", "start").mapInArrow(run, schema)


def token_counts(store: DataFrame, token: int) -> DataFrame:
    """How often a token is in each shard, by rank alone."""
    count = lambda files: (WaveletMatrix.from_bytes(f).count(token) for f in files)
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], names=schema.names)

    return store.select("shard", "file").mapInArrow(run, schema)
