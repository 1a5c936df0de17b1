"""Importance resampling towards a target: documents are drawn by how much more likely the target makes their n-grams.

Features are all runs of 1 to GRAMS words. A dictionary over all documents and the target holds each different feature string once,
with its counts; each string is hashed once, there, to one of BUCKETS buckets. Bucket sums give each bucket's gain (the logarithm of how
often the target has it against the documents), gains meet the per-document feature counts, and a document's weight is the sum of its
features' gains. Gumbel noise from the id's digest turns weights into a draw without replacement.

How the dictionary is built: a block of text (BLOCK bytes) numbers its words and sorts its windows of GRAMS words, so a block has each window
once, with the documents that have it and how often. A window stands for the runs of 1, 2 and 3 words that begin it, so only windows
travel: to parts by their first word and SPREAD values of the second, packed as a tree (first words, second words, third words, postings) over
numbers of the words that the part needs. A part joins the words of its runs to strings, turn by turn, finds the different ones, hashes those, and
gives back bucket sums and, block by block, the feature counts of each document with buckets for strings. These counts are written
once; gains (BUCKETS numbers) are sent to them, and partial weights go back to the block's documents.

Scale: what is shuffled is packed arrays, one row for each block and part. A part is sized by the text (PART_BYTES); a window that every
document has is one entry per block. A word lies in SPREAD parts, which each count and hash it, so that a word with a third of all
windows isn't one task's work; runs of two or three words are in one part. A text longer than a block is cut into pieces, each with the first
words of the next. Ranks come from a range partitioning by score.

Cases: null has no words; documents without words have weight 0 and are scored like others; fewer than LEAST_WORDS words are never drawn; rows
that share an id and a score are ranked side by side; a null id has the digest of the empty id and comes after others; an empty table
gives an empty result, an empty target gains below zero; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import placed, release, slices
from tidepanel.session import cut

GRAMS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42
BLOCK = 8 << 20
SPREAD = 8  # parts that share the windows of one first word
PART_BYTES = 24 << 20  # text whose features make one part of the dictionary
LEVEL = 3  # of compression
TURNS = 4  # in which a part's dictionary is made
MAX_WORDS = 1 << 21  # different words of a block: three numbers below this fit in a long
WORD = re.compile(rb"[^ ]+")
#: A-Z become lower case, digits, letters and all bytes above ASCII stay, the rest is a space.
SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

CELL = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("target", T.BooleanType()), T.StructField("body", T.BinaryType())])
COUNTED = T.StructType([*CELL.fields[1:], T.StructField("bucket", T.IntegerType()), T.StructField("s", T.LongType()), T.StructField("t", T.LongType())])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers (of one kind each) as one compressed string, byte plane by byte plane."""
    head = [len(arrays)]
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [len(a), a.itemsize]
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = np.array(head, "<u8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def unpacked(body: bytes) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, "<u8", 2 * n, 8).astype(np.int64).reshape(n, 2)
    out, at = [], 8 * (2 * n + 1)
    for size, width in head.tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}")[:, 0] if size else np.empty(0, f"<u{width}"))
        at += size * width
    return out


def strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the bytes of a binary array."""
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
    flat = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.diff(at).astype(np.uint32), flat


def binary(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    at = np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])


def crc32(sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The CRC-32 of many strings at once, byte by byte: the longest come first and the others drop out."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = table >> np.uint32(1) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    order = np.argsort(sizes, kind="stable")[::-1]
    first = (np.cumsum(sizes, dtype=np.int64) - sizes)[order]
    left = np.searchsorted(-sizes[order].astype(np.int64), -np.arange(int(sizes.max(initial=0))) - 1, "right")
    state = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for i, n in enumerate(left.tolist()):
        now = state[:n]
        state[:n] = now >> np.uint32(8) ^ table[(now ^ flat[first[:n] + i]) & np.uint32(255)]
    out = np.empty(len(sizes), np.uint32)
    out[order] = ~state
    return out


def pieces(texts: list) -> Iterator[list[tuple[int, bytes, int]]]:
    """Blocks of (place of the text, signs, number of last words that belong to the next piece of it)."""
    held, size = [], 0
    for i, text in enumerate(texts):
        signs = (text or "").encode("utf-8", "surrogatepass").translate(SIGNS)
        first = 0
        while True:
            end = len(signs)
            if end - first > BLOCK:
                end = signs.rfind(b" ", first, first + BLOCK) + 1 or signs.find(b" ", first) + 1 or end
                end = end if end > first else len(signs)
            ahead = [m[0] for m in islice(WORD.finditer(signs, end), GRAMS - 1)]
            held.append((i, b" ".join([signs[first:end], *ahead]), len(ahead)))
            size += end - first
            if size >= BLOCK:
                yield held
                held, size = [], 0
            first = end
            if first >= len(signs):
                break
    if held:
        yield held


def tokens(block: list[tuple[int, bytes, int]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, sorted; each word's number among them; its row in the block; whether it belongs to the next piece."""
    flat = np.frombuffer(b" ".join(one for _, one, _ in block), np.uint8)
    inside = flat != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]
    coded = binary(last - first, flat[inside]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row = np.searchsorted(np.cumsum([len(one) + 1 for _, one, _ in block]), first, "right")
    ends = np.searchsorted(row, np.arange(len(block)), "right")
    ahead = np.array([n for _, _, n in block], np.int64)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()], row, ends[row] - np.arange(len(row)) <= ahead[row]


def windows(word: np.ndarray, row: np.ndarray, next_: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The GRAMS words from each word of a row on as one number (`none` stands for no word), and its row; no window begins in the next piece."""
    key = np.zeros(len(word), np.int64)
    for j in range(GRAMS):
        own = np.full(len(word), none, np.int64)
        inside = row[j:] == row[: len(row) - j] if j else np.ones(len(row), bool)
        own[: len(inside)] = np.where(inside, word[j:], none)
        key = key * (none + 1) + own
    return key[~next_], row[~next_]


def cells(block: list[tuple[int, bytes, int]], parts: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, bytes]]]:
    """The number of words and of features of each row of the block, and its windows by part.

    A cell holds: sizes and bytes of its words; its first words, how many second words follow each, those words, and likewise the third ones; how
    many rows have each window; those rows; how often each has it.
    """
    vocabulary, word, row, next_ = tokens(block)
    none = len(vocabulary)
    if none >= MAX_WORDS:
        raise ValueError("a block has too many different words: lower BLOCK")
    key, at = windows(word, row, next_, none)
    words = np.bincount(at, minlength=len(block))
    features = words + sum(np.bincount(at[key // (none + 1) ** (GRAMS - 1 - j) % (none + 1) < none], minlength=len(block)) for j in range(1, GRAMS))
    order = np.argsort(key, kind="stable")  # rows ascend within a window
    key, at = key[order], at[order]
    new = np.diff(key, prepend=-1) != 0
    post = np.flatnonzero(new | (np.diff(at, prepend=-1) != 0))
    often = np.diff(np.append(post, len(key)))
    own = key[new]
    counts = np.bincount(np.cumsum(new)[post] - 1, minlength=len(own))
    starts = np.cumsum(counts) - counts
    a, b, c = own // (none + 1) ** 2, own // (none + 1) % (none + 1), own % (none + 1)
    hashes = np.append(np.fromiter(map(xxhash.xxh32_intdigest, vocabulary.to_pylist()), np.uint64, none), np.uint64(0))
    part = ((hashes[a] + hashes[b] % np.uint64(SPREAD) * np.uint64(0x9E3779B1)) % np.uint64(parts)).astype(np.int64)
    by_part = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[by_part], np.arange(parts + 1))

    def packs() -> Iterator[tuple[int, bytes]]:
        local = np.zeros(none + 1, np.uint32)
        small = lambda x: x.astype(np.uint32)
        for p in range(parts):
            mine = by_part[bounds[p] : bounds[p + 1]]
            if not len(mine):
                continue
            x, y, z = a[mine], b[mine], c[mine]
            used = np.unique(np.concatenate([x, y, z]))
            used = used[used < none]
            local[used] = np.arange(len(used))
            local[none] = len(used)
            sizes, flat = strings(vocabulary.take(pa.array(used)))
            begins = np.flatnonzero(np.diff(x, prepend=-1) != 0)
            pairs = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
            n = counts[mine]
            of = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            seconds, thirds = np.diff(np.append(np.searchsorted(pairs, begins), len(pairs))), np.diff(np.append(pairs, len(mine)))
            yield p, packed(sizes, flat, np.diff(local[x[begins]], prepend=np.uint32(0)), small(seconds), local[y[pairs]], small(thirds), local[z], small(n), small(at[post[of]]), small(often[of]))

    return words, features, packs()


def feature_cells(docs: DataFrame, parts: int, target: bool, *, doc_id: str, text: str) -> DataFrame:
    """For each block one row of its documents (part null) and one cell for each part."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = document = TaskContext.get().partitionId() << 40
        row = lambda part, body: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, block, target, body), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], names=CELL.names)
        for batch in batches:
            for first, last in slices(batch.column(1), BLOCK):
                ids = batch.column(0).slice(first, last - first)
                for held in pieces(batch.column(1).slice(first, last - first).to_pylist()):
                    words, features, made = cells(held, parts)
                    places = np.array([i for i, _, _ in held], np.int64)
                    own = ids.take(pa.array(places))
                    known = own.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                    yield row(None, packed(document + places, own.fill_null(0).to_numpy(), known, words, features))
                    for p, body in made:
                        yield row(p, body)
                    block += 1
                document += last - first
        release()

    return source.mapInArrow(run, CELL)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def runs_of(body: bytes, turn: int) -> tuple[list[pa.Array], int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell, what begins with a word of this turn: the strings of its different runs and their number; for each window where its runs stand among
    them (-1: it has none); how many rows have the window; those rows; how often each has it."""
    sizes, flat, steps, seconds, second, thirds, third, n, rows, often = unpacked(body)
    words, none = binary(sizes, flat), len(sizes)
    last = np.cumsum(sizes, dtype=np.int64)
    turn_of = (flat[last - sizes] * np.uint32(31) + flat[last - 1] * np.uint32(7) + sizes) % TURNS
    a = np.cumsum(steps, dtype=np.int64)
    mine = turn_of[a] == turn
    first = np.repeat(np.arange(len(a)), seconds)  # of each pair
    pairs = mine[first]
    of_pair = np.repeat(np.arange(len(second)), thirds)  # of each window
    own = pairs[of_pair]
    posted = np.repeat(own, n)
    renumbered = lambda kept: np.cumsum(kept) - 1
    first, of_pair = renumbered(mine)[first[pairs]], renumbered(pairs)[of_pair[own]]
    a, second, third = a[mine], second[pairs], third[own]
    two_at, three_at = second < none, third < none
    taken = lambda x: words.take(pa.array(x))
    one = taken(a)
    two = pc.binary_join_element_wise(taken(a[first[two_at]]), taken(second[two_at]), b" ")
    has = of_pair[three_at]
    three = pc.binary_join_element_wise(taken(a[first[has]]), taken(second[has]), taken(third[three_at]), b" ")
    place = lambda there, base: np.where(there, renumbered(there) + base, -1)
    runs = np.stack([first[of_pair], place(two_at, len(a))[of_pair], place(three_at, len(a) + len(two))]).astype(np.int32)
    return [one, two, three], len(one) + len(two) + len(three), runs, n[own], rows[posted], often[posted]


def counted(cells_: DataFrame, parts: int) -> DataFrame:
    """The dictionary's bucket sums (s of documents, t of the target), and for each cell of documents its counts by row and bucket.

    All cells of a part are in one task, packed, one part after another; it takes them in TURNS by the first words' letters, and holds the strings of one turn.
    """

    def row(*values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))], names=COUNTED.names)

    def made_of(held: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
        """What a part's cells (block, target, cell) give back."""
        sums = np.zeros((2, BUCKETS), np.int64)
        found: list[list] = [[] for _ in held]  # (row and bucket as one number, how often) of each cell
        for turn in range(TURNS):
            made, heads = [], []
            for _, _, body in held:
                own, *head = runs_of(body, turn)
                made += own
                heads.append(head)
            coded = pa.chunked_array(made, pa.binary()).combine_chunks().dictionary_encode()
            made.clear()
            bucket = (crc32(*strings(coded.dictionary)) % np.uint32(BUCKETS)).astype(np.int64)  # each different string once
            index = coded.indices.to_numpy()
            coded = None
            totals = np.zeros((2, len(bucket)), np.int64)  # the dictionary's counts
            at = 0
            for (_, target, _), (size, runs, n, rows, often), kept in zip(held, heads, found):
                mine = index[at : at + size]
                at += size
                window, own = np.repeat(np.arange(len(n)), n), np.zeros(size, np.int64)  # of each posting
                for places in runs:
                    place = places[window]
                    there = place >= 0
                    own += np.bincount(place[there], weights=often[there], minlength=size).astype(np.int64)
                    if not target:
                        kept.append((narrow(rows[there].astype(np.int64) * BUCKETS + bucket[mine[place[there]]]), narrow(often[there])))
                totals[int(target)][mine] += own  # a cell has each string once
            for x, total in zip(sums, totals):
                x += np.bincount(bucket, weights=total, minlength=BUCKETS).astype(np.int64)
        for k, (block, target, _) in enumerate(held):
            if not target:
                key, often = (np.concatenate([x[i].astype(np.int64) for x in found[k]]) for i in (0, 1))
                order = np.argsort(key)
                key = key[order]
                new = np.flatnonzero(np.diff(key, prepend=-1))
                yield row(block, False, packed(np.diff(key[new], prepend=0).astype(np.uint32), np.add.reduceat(often[order], new).astype(np.uint32)), None, None, None)
            found[k] = []
        nothing = pa.nulls(BUCKETS)
        yield pa.RecordBatch.from_arrays([nothing.cast(pa.int64()), nothing.cast(pa.bool_()), nothing.cast(pa.binary()), pa.array(np.arange(BUCKETS), pa.int32()), *map(pa.array, sums)], names=COUNTED.names)
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, block, target, body in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None:
                    if not target:
                        yield row(block, None, body, None, None, None)
                    continue
                if part != now:
                    if held:
                        yield from made_of(held)
                    now, held = part, []
                held.append((block, target, body))
        if held:
            yield from made_of(held)

    # Documents' own rows have no part; they are dealt out by their block.
    return cells_.repartition(parts, F.coalesce(F.col("part").cast("long"), F.col("block"))).sortWithinPartitions("part").mapInArrow(run, COUNTED)


def gains_of(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down."""
    ratio = (t + 1.0) * (s.sum() + float(BUCKETS)) / ((s + 1.0) * (t.sum() + float(BUCKETS)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_features and weight, the sum of the gains of its features."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = 1 + size // PART_BYTES
    own = feature_cells(docs, parts, False, doc_id=doc_id, text=text)
    aim = feature_cells(target.select(F.lit(None).alias("doc_id"), F.col(target_text).alias("text")), parts, True, doc_id="doc_id", text="text")
    found = cut(counted(own.unionByName(aim), parts))
    sums = found.filter("bucket is not null").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # BUCKETS rows at most
    table = np.zeros((2, BUCKETS), np.int64)
    for r in sums:
        table[:, r["bucket"]] = r["s"], r["t"]
    gain = gains_of(*table)
    sent = T.StructType([T.StructField("block", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("body", T.BinaryType())])
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("row", "doc_id", "n_words", "n_features", "weight")])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents' own rows as they are, and for each cell the sums of gains of the block's rows."""
        for batch in batches:
            for block, target_, body in zip(*(c.to_pylist() for c in batch.columns)):
                if target_ is not None:
                    step, often = unpacked(body)
                    row, bucket = np.divmod(np.cumsum(step, dtype=np.int64), BUCKETS)
                    new = np.flatnonzero(np.diff(row, prepend=-1))
                    body = packed(row[new].astype(np.uint32), np.add.reduceat(gain[bucket] * often, new))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([target_ is None]), pa.array([body], pa.binary())], names=sent.names)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of one block after another; its documents come before its cells."""
        held = total = None

        def flush() -> pa.RecordBatch:
            row, ids, known, words, features = held
            columns = [pa.array(row.view(np.int64)), pa.array(ids.view(np.int64), mask=known == 0), *(pa.array(x.view(np.int64)) for x in (words, features)), pa.array(total)]
            return pa.RecordBatch.from_arrays(columns, names=out.names)

        for batch in batches:
            for own_, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if own_:
                    if held is not None:
                        yield flush()
                    held = unpacked(body)
                    total = np.zeros(len(held[0]), np.int64)
                else:
                    row, sums_ = unpacked(body)
                    total[row] += sums_.view(np.int64)
        if held is not None:
            yield flush()

    partial = found.filter("bucket is null").select("block", "target", "body").mapInArrow(weighed, sent)
    whole = partial.repartition(max(1, min(parts, docs.rdd.getNumPartitions())), "block").sortWithinPartitions("block", F.desc("own")).mapInArrow(gathered, out)
    # A text of several pieces has a row in each of their blocks.
    return whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]).drop("row")


def drawn(weighed: DataFrame, *, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """`weighed` with `score` (weight and the noise of the id) and `rank`, from 1, of those drawn; null for the others."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # Rows that are too short stand apart from those that are ranked.
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_fit", (F.col("n_words") >= least_words).cast("int"))
    ranked = placed(scored, "_fit", [F.desc("score"), F.asc_nulls_last("doc_id")])
    rank = F.when((F.col("_fit") == 1) & (F.col("at") < F.floor(F.col("size") * percent / 100)), F.col("at").cast("long") + 1)
    return ranked.withColumn("rank", rank).drop("_fit", "at", "size")


def resampled(docs: DataFrame, target: DataFrame, **names: str) -> DataFrame:
    """Per row of `docs`: doc_id, n_features, weight, score and rank among those drawn."""
    return drawn(weights(docs, target, **names)).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL for `resampled` of the tables `documents` and `benchmark`; the CRC-32 of a string goes over the hexadecimal digits of its bytes.
ORACLE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM (SELECT r, text FROM d UNION ALL SELECT -1, text FROM benchmark)),
f AS (SELECT r, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT r, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)),
c AS (SELECT r, g, count(*) AS n FROM f GROUP BY 1, 2),
h AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(g))), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket, s, t
  FROM (SELECT g, hex(encode(g)) AS x, coalesce(sum(n) FILTER (r > 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM c GROUP BY g), crc),
b AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM h GROUP BY 1), z AS (SELECT sum(s) AS sa, sum(t) AS ta FROM b),
y AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sa + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(ta + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM b, z),
k AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN h USING (g) JOIN y USING (bucket) WHERE r > 0 GROUP BY 1),
s AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, len(w) >= 20 AS fit
  FROM d JOIN w USING (r) LEFT JOIN k USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY fit) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM o"""
