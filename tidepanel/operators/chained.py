"""Chained digests of a ledger: rows, shards of rows, groups of shards, up to one root, so that a change is found by comparing few digests.

A row's digest is that of its canonical content. A shard's is that of its rows' digests in sorted order, so it doesn't depend on how rows
are stored; a level above is the digest of its parts' keys, counts and digests. Two ledgers are compared from the root down: only
parts whose digests differ are opened, and rows are compared in those shards alone.

Cases: null is a value, in keys too; repeated rows count as often as they are there; an empty ledger has no root; rows of one id with different
contents on the same side are told as altered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.documents import canonical_value
from tidepanel.session import cut


def with_digest(rows: DataFrame, content: list[str], out: str = "row_digest") -> DataFrame:
    """`rows` with the digest of the named columns; null fields are left out of the canonical form, as if they were not there."""
    whole = F.struct(*[canonical_value(F.col(c), rows.schema[c].dataType).alias(c) for c in sorted(content)])
    return rows.withColumn(out, F.sha2(F.to_json(whole), 256))


def _folded(parts: Column) -> Column:
    return F.sha2(F.concat_ws("", F.array_sort(F.collect_list(parts))), 256)


def level_digests(rows: DataFrame, levels: list[list[str]]) -> list[DataFrame]:
    """(keys, n, digest) of every level: levels[0] are the shards' keys, each next one has fewer of them, the last none. `rows` need row_digest."""
    out = [cut(rows.groupBy(*levels[0]).agg(F.count("*").alias("n"), _folded(F.col("row_digest")).alias("digest")))]
    for before, keys in zip(levels, levels[1:]):
        name = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in before]
        part = F.concat_ws("\x1f", *name, F.col("n").cast("string"), F.col("digest"))
        out.append(out[-1].groupBy(*keys).agg(F.sum("n").alias("n"), _folded(part).alias("digest")))
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides by key: keys, a_n, a_digest, b_n, b_digest; null where a side doesn't have it."""
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("n").alias("b_n"), F.col("digest").alias("b_digest"))
    a = a.select(*keys, F.col("n").alias("a_n"), F.col("digest").alias("a_digest"))
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_k_{k}"]) for k in keys], F.lit(True))
    return a.join(b, on, "full").select(*[F.when(F.col("a_digest").isNotNull(), F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in keys], "a_n", "a_digest", "b_n", "b_digest")


def manifest_faults(claimed: list[DataFrame], derived: list[DataFrame], levels: list[list[str]]) -> DataFrame:
    """(level, keys, fault) where a manifest tells other counts or digests than the rows: false-count, false-digest, unlisted or unfounded parts."""
    found = None
    for k, keys in enumerate(levels):
        both = _met(claimed[k], derived[k], keys)
        fault = F.when(F.col("a_digest").isNull(), "unlisted").when(F.col("b_digest").isNull(), "unfounded").when(F.col("a_n") != F.col("b_n"), "false-count").when(F.col("a_digest") != F.col("b_digest"), "false-digest")
        missing = [F.lit(None).cast("string").alias(c) for c in levels[0] if c not in keys]
        own = both.select(F.lit(k).alias("level"), *[F.col(c).cast("string").alias(c) for c in keys], *missing, fault.alias("fault")).filter("fault is not null")
        found = own if found is None else found.unionByName(own)
    return found


def opened(stored: list[DataFrame], derived: list[DataFrame], levels: list[list[str]]) -> DataFrame:
    """The shards (keys, a_n, b_n) that differ: looked for from the last level down, in parts that differ only."""
    todo = None
    for keys, a, b in reversed(list(zip(levels, stored, derived))):
        if todo is not None:
            above = [k for k in keys if k in todo.columns]
            a, b = (x.join(F.broadcast(todo) if small else todo, _same(x, todo, above), "left_semi") for x in (a, b))
        differ = cut(_met(a, b, keys).filter(~F.col("a_digest").eqNullSafe(F.col("b_digest"))))
        if differ.isEmpty():
            return differ
        todo, small = differ.select(*keys), differ.limit(10_001).count() <= 10_000
    return differ


def row_faults(stored: DataFrame, derived: DataFrame, key: str, levels: list[list[str]]) -> DataFrame:
    """(keys of the shard, key, fault): altered, missing and unknown rows of `stored` against `derived`; a shard that is wholly gone is one row, lost-shard. Both have row_digest."""
    shards = opened(level_digests(stored, levels), level_digests(derived, levels), levels)
    names = levels[0]
    if shards.isEmpty():
        return stored.select(*names, key, F.lit("altered").alias("fault")).limit(0)
    lost = shards.filter("a_n is null").select(*names, F.lit(None).cast(stored.schema[key].dataType).alias(key), F.lit("lost-shard").alias("fault"))
    whole = shards.filter("a_n is not null").select(*names)
    inside = lambda x: x.join(F.broadcast(whole) if whole.limit(10_001).count() <= 10_000 else whole, _same(x, whole, names), "left_semi")
    sides = inside(stored).select(*names, key, "row_digest", F.lit(1).alias("_side")).unionByName(inside(derived).select(*names, key, "row_digest", F.lit(-1).alias("_side")))
    each = sides.groupBy(*names, key, "row_digest").agg(F.sum("_side").alias("_more")).filter("_more <> 0")
    told = each.groupBy(*names, key).agg(F.max(F.col("_more") > 0).alias("_stored"), F.max(F.col("_more") < 0).alias("_derived"))
    fault = F.when(F.col("_stored") & F.col("_derived"), "altered").when(F.col("_stored"), "unknown").otherwise("missing")
    return told.select(*names, key, fault.alias("fault")).unionByName(lost)
