"""Sharding along a Hilbert curve: several metadata dimensions, one order, runs of it as shards.

Each dimension is quantised to 2^BITS steps (numbers by approximate quantiles, strings by a hash), the steps are coordinates
of a cell, and cells are numbered along a Hilbert curve, on which neighbours differ by one step of one dimension. Rows
are sorted by the cell's number and cut into runs of equal count, so a shard covers few cells, and the ranges of its
numbers and the steps of its strings (`shard_ranges`, `may_hold`) let a reader with conditions on any of the dimensions skip most shards.

The curve's number of a cell follows from bit operations on columns (exchange and invert from the high bit down, then a Gray code);
it runs inside Spark's generated code, without a table.

Scale: to number documents only ids, sizes and dimensions are sorted; to write them, texts are shuffled once, with the sort. Rows go to range partitions by (cell, hash of the id), so a hot
cell is split; a row's place is its partition's offset plus its place inside, from one count per partition.

Cases: null text has no bytes; a null number is step 0, a null string hashes like any other; rows that are equal in all that is sorted
take neighbouring places in either order, and null or repeated ids are rows like others; columns named like an added one
(size, shard, slot, curve_index) are replaced by it; fewer rows than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.session import cut

SHARDS = 40
BITS = 5
OVERHEAD = 16  # bytes of a row besides its text


def with_hilbert_index(df: DataFrame, coordinates: list[str], out: str, bits: int = BITS) -> DataFrame:
    """`df` with the number on the curve of its cell. coordinates: columns of whole numbers from 0 to 2^bits - 1.

    Each step is a projection of its own, so that none is written out again inside the next one.
    """
    n = len(coordinates)
    names = [f"_x{i}" for i in range(n)]
    columns = df.columns
    now = df.select(*columns, *[F.col(c).cast("long").alias(x) for c, x in zip(coordinates, names)])
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for x in names:
            set_ = F.col(x).bitwiseAND(F.lit(q)) != 0
            if x == names[0]:
                now = now.withColumn(x, F.when(set_, F.col(x).bitwiseXOR(F.lit(low))).otherwise(F.col(x)))
                continue
            differ = F.col(names[0]).bitwiseXOR(F.col(x)).bitwiseAND(F.lit(low))
            first = F.when(set_, F.col(names[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(names[0]).bitwiseXOR(differ))
            now = now.select(*columns, first.alias(names[0]), *[(F.when(set_, F.col(x)).otherwise(F.col(x).bitwiseXOR(differ)) if c == x else F.col(c)).alias(c) for c in names[1:]])
        q >>= 1
    for before, x in zip(names, names[1:]):
        now = now.withColumn(x, F.col(x).bitwiseXOR(F.col(before)))
    turn = F.lit(0).cast("long")
    q = high
    while q > 1:
        turn = F.when(F.col(names[-1]).bitwiseAND(F.lit(q)) != 0, turn.bitwiseXOR(F.lit(q - 1))).otherwise(turn)
        q >>= 1
    now = now.withColumn("_turn", turn)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for x in names:
            bit = F.shiftright(F.col(x).bitwiseXOR(F.col("_turn")), b).bitwiseAND(F.lit(1))
            index = F.shiftleft(index, 1).bitwiseOR(bit)
    return now.withColumn("_index", index).select(*columns, F.col("_index").alias(out))


def quantised(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """`df` with a column `_d<i>` of steps for each dimension."""
    steps = 1 << bits
    numbers = [d for d in dimensions if isinstance(df.schema[d].dataType, T.NumericType)]
    edges = dict(zip(numbers, df.approxQuantile(numbers, [i / steps for i in range(1, steps)], 0.002))) if numbers else {}
    for i, d in enumerate(dimensions):
        if d in edges:
            marks = sorted(set(edges[d]))
            step = F.lit(0)
            for m in marks:  # as many terms as steps
                step = step + F.when(F.col(d) > m, 1).otherwise(0)
        else:
            step = _step(F.col(d), bits)
        df = df.withColumn(f"_d{i}", step.cast("long"))
    return df


def along_curve(rows: DataFrame, dimensions: list[str], shards: int, *, doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """`rows` with `shard` and `slot`: runs of the curve whose counts differ by one at most."""
    columns = rows.columns
    steps = quantised(rows, dimensions, bits)
    placed = with_hilbert_index(steps, [f"_d{i}" for i in range(len(dimensions))], "_cell", bits).withColumn("_salt", F.xxhash64(doc_id, *dimensions))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_cell", "_salt", doc_id]
    ordered = placed.select(*columns, "_cell", "_salt").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    every = Window.orderBy("_part")  # one row per partition
    offsets = counts.withColumn("_before", F.sum("_n").over(every) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    out = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", rank)
    # Shard s holds the ranks from ceil(s * all / shards) on.
    shard = F.expr(f"(_rank * {shards}) div _all")
    first = F.expr(f"((shard * _all) + {shards - 1}) div {shards}")
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - first).select(*columns, F.col("_cell").alias("curve_index"), "shard", "slot")


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("n_chars", "lang", "source")) -> DataFrame:
    """Per row: doc_id, size, text_crc32, the dimensions, curve_index, shard, slot."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *dimensions)
    return along_curve(rows, list(dimensions), shards)


def _step(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << bits))


def shard_ranges(sharded: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Per shard: rows, bytes, the least and greatest value of each number (min_, max_) and the steps that each string takes (steps_, at most
    2^bits of them), for readers that skip shards."""
    ends = []
    for d in dimensions:
        if isinstance(sharded.schema[d].dataType, T.NumericType):
            ends += [F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}")]
        else:
            ends.append(F.array_sort(F.collect_set(_step(F.col(d), bits))).alias(f"steps_{d}"))
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def may_hold(dimension: str, value: str | None, bits: int = BITS) -> Column:
    """A condition on `shard_ranges`: whether a shard may have rows with this value of a string dimension."""
    return F.array_contains(f"steps_{dimension}", _step(F.lit(value).cast("string"), bits))


def write_shards(docs: DataFrame, folder: str, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("n_chars", "lang", "source")) -> DataFrame:
    """Writes whole documents, one folder per shard in curve order, and returns the shards' ranges.

    Every row is written once, with its place (`shard`, `slot`), whatever its id is.
    """
    added = ("size", "curve_index", "shard", "slot")
    rows = docs.select(*[docs[c] for c in docs.columns if c not in added], (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"))
    # The rows come in runs of the curve, so each task writes to few shards.
    along_curve(rows, list(dimensions), shards, doc_id=doc_id).write.partitionBy("shard").parquet(folder)
    written = docs.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())])).parquet(folder)
    return shard_ranges(written, list(dimensions))
