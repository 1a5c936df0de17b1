"""A Merkle manifest of a table: a tree of digests per source, and one over the sources, by superblock reduction.

A row's leaf is the SHA-256 of its fields, each with its length before it. The leaves of a source ascend by id; every FANOUT consecutive
nodes become the SHA-256 of their digests, as hex text, until one is left. The last run of a level has what remains, even one node.
The sources' roots, in order of source, are reduced likewise to one root.

Superblocks: the index of a node divided by FANOUT^LEVELS is its bucket. `applyInPandas` collapses LEVELS levels of one bucket,
so that a bucket gives back one root, and each of its nodes the lower part of its proof. The bucket roots are the nodes of the next,
far smaller reduction, and the proof of a bucket's root there is the upper part of the proofs of all its nodes. A proof is a
byte string: at each level the node's place in its run, the run's size, and the digests of the others.

Scale: the texts are read once and never shuffled; what travels is digests. A source's order is that of a range partitioning by
(source, id), whose partitions are counted, so that one source with a third of all rows lies in many tasks; a bucket has at most
FANOUT^LEVELS rows, however large its source. The trees of 10^11 rows need three reductions. Counts of sources and bucket roots meet their rows
by broadcast only up to BROADCAST_ROWS of them, counted first.

Cases: a null field is `-`, unlike an empty text, which has length 0; a null id is before all others; rows that share an id are in the order
of their leaves; equal rows have equal leaves in neighbouring places; a null source is a source and the first one; an empty table has no
rows and no root; other columns, also those called `leaf` or `root`, are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import placed
from tidepanel.session import cut

FANOUT = 3
LEVELS = 7  # 2,187 nodes to a bucket
BROADCAST_ROWS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SALTS = 32


def joined_digest(parts: list[bytes]) -> bytes:
    """The digest of the parts' hex text, one after another."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf(fields: list[Column]) -> Column:
    """The SHA-256 of the fields, each `-` or the number of its bytes, a colon and its text."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(one, fields)).cast("binary"), 256))


def _depth(count: Column) -> Column:
    """How many levels reduce `count` nodes to one."""
    begin = F.struct(count.cast("long").alias("left"), F.lit(0).alias("levels"))
    less = lambda s: F.struct(F.floor((s["left"] + (FANOUT - 1)) / FANOUT).cast("long").alias("left"), (s["levels"] + 1).alias("levels"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), begin, lambda s, _: F.when(s["left"] > 1, less(s)).otherwise(s))["levels"]


def _told(rows: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """`rows` with what `facts` says of their key: by broadcast of few facts, else in SALTS parts, since a key may have a third of all rows."""
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), key)
    salt = F.pmod(F.xxhash64("at"), F.lit(SALTS)).alias("_salt")
    parts = facts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return rows.select("*", salt).join(parts, [*key, "_salt"]).drop("_salt")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `at`, the place of each among the rows of its `tree`, from 0, and `depth`, the levels of that tree."""
    return placed(rows, "tree", [F.col(c) for c in order]).withColumn("depth", _depth(F.col("size"))).drop("size")


def collapsed(digests: list[bytes], levels: int) -> tuple[list[bytes], bytes]:
    """Each node's proof up to the digest that `levels` levels leave, and that digest."""
    proofs = [b""] * len(digests)
    reach = 1
    for _ in range(levels):
        runs = [digests[i : i + FANOUT] for i in range(0, len(digests), FANOUT)]
        steps = [bytes([place, len(run)]) + b"".join(run[:place] + run[place + 1 :]) for run in runs for place in range(len(run))]
        proofs = [p + steps[i // reach] for i, p in enumerate(proofs)]
        digests = [joined_digest(run) for run in runs]
        reach *= FANOUT
    return proofs, digests[0]


def siblings(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The place in the run and the other digests of it, level by level."""
    at = 0
    while at < len(proof):
        end = at + 2 + 32 * (proof[at + 1] - 1)
        yield proof[at], [proof[i : i + 32] for i in range(at + 2, end, 32)]
        at = end


def folded(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for place, others in siblings(proof):
        digest = joined_digest([*others[:place], digest, *others[place:]])
    return digest


def proven(nodes: DataFrame) -> DataFrame:
    """`nodes` (tree, at, digest, depth and others) with `proof`, up to the root of their tree, and `top`, that root."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("proof", T.BinaryType()), T.StructField("top", T.BinaryType())])

    def collapse(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        proofs, top = collapsed(list(block["digest"]), min(LEVELS, int(block["depth"].iloc[0])))
        return block.assign(proof=proofs, top=[top] * len(block))

    width = FANOUT**LEVELS
    low = cut(nodes.withColumn("bucket", F.floor(F.col("at") / width)).groupBy("tree", "bucket").applyInPandas(collapse, schema))
    deepest = low.agg(F.max("depth")).first()[0]
    if deepest is None or deepest <= LEVELS:
        return low.drop("bucket")
    tops = low.filter(F.col("at") == F.col("bucket") * width).select("tree", F.col("bucket").alias("at"), F.col("top").alias("digest"), F.greatest(F.col("depth") - LEVELS, F.lit(0)).alias("depth"))
    upper = proven(tops).select("tree", F.col("at").alias("bucket"), F.col("proof").alias("_upper"), F.col("top").alias("_root"))
    whole = low.drop("top").join(upper, ["tree", "bucket"])
    return whole.withColumn("proof", F.concat("proof", "_upper")).withColumnRenamed("_root", "top").drop("bucket", "_upper")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, tampered_where: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot and root (hex), proof (bytes), and `other`, the leaf's digest after `tampered` replaces fields.

    `fields` are the leaf's, the first the id and the second the source; `other` is null where `tampered_where` isn't true.
    """
    columns = [F.col(f) for f in fields]
    changed = leaf([(tampered or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(
        columns[0].alias("doc_id"), columns[1].alias("source"), leaf(columns).alias("digest"), F.when(tampered_where, changed).alias("other") if tampered_where is not None else F.lit(None).cast("binary").alias("other")
    ).withColumn("tree", F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")))  # nulls first, in the order of UTF-8
    low = proven(numbered(cut(rows), ["doc_id", "digest"]))  # a range partitioning reads its input twice
    roots = cut(low.filter("at = 0").select("tree", F.col("top").alias("digest")))
    high = proven(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"]))
    facts = cut(high.select(F.col("source").alias("tree"), F.col("proof").alias("_upper"), F.col("digest").alias("_subroot"), F.col("top").alias("_root")))
    hexed = lambda c: F.lower(F.hex(c))
    return _told(low, facts, ["tree"]).select(
        "doc_id", "source", hexed("digest").alias("leaf"), hexed("_subroot").alias("subroot"), hexed("_root").alias("root"), F.concat("proof", "_upper").alias("proof"), "other"
    )


def verified(found: DataFrame) -> DataFrame:
    """What `manifest` gives, with the digest of each proof, the root that the row (or its tampered form) leads to, and whether it is the root."""
    added = "proof_sha256 string, folded_root string"
    kept = found.drop("proof", "other")

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            digest = [joined_digest([d for _, others in siblings(p) for d in others]).hex() for p in block["proof"]]
            root = [folded(bytes.fromhex(own) if other is None else other, p).hex() for own, other, p in zip(block["leaf"], block["other"], block["proof"])]
            yield block.drop(columns=["proof", "other"]).assign(proof_sha256=digest, folded_root=root)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [added])
    return found.mapInPandas(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering_report(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, where every second id's text lost its line ends."""
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(docs, tampered={"text": F.translate("text", "\n", "")}, tampered_where=where)
    return verified(found.drop("source")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle_sql(levels: int = 16) -> str:
    """DuckDB SQL for `tampering_report` of `documents`: one level after another, for up to FANOUT^levels rows of a source and as many sources."""
    one = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    digest = lambda text: f"sha256({' || '.join(one(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {one(text)})"
    # CRC-32 of the decimal digits, bit by bit.
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: " + step + ")"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    parts = [f"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS tree, {digest("text")} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {digest("replace(text, chr(10), '')")} END AS other FROM documents),
s0 AS (SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest FROM d)"""]

    def grown(name: str, key: str) -> None:
        """Levels of trees `name`: the nodes of each, and what every first node meets on its way."""
        own = f"{name}0"
        parts.append(f"{name}n0 AS (SELECT tree, pos, digest FROM {own}), {name}w0 AS (SELECT {key} AS r, tree, pos, [] :: VARCHAR[][] AS steps FROM {own})")
        for i in range(levels):
            parts.append(f"{name}c{i} AS (SELECT tree, count(*) AS n FROM {name}n{i} GROUP BY tree)")
            parts.append(f"{name}r{i} AS (SELECT tree, pos // {FANOUT} AS run, list(digest ORDER BY pos) AS members FROM {name}n{i} JOIN {name}c{i} USING (tree) WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{name}n{i + 1} AS MATERIALIZED (SELECT tree, run AS pos, sha256(array_to_string(members, '')) AS digest FROM {name}r{i} UNION ALL SELECT tree, pos, digest FROM {name}n{i} JOIN {name}c{i} USING (tree) WHERE n = 1)")
            parts.append(
                f"{name}w{i + 1} AS MATERIALIZED (SELECT w.r, w.tree, CASE WHEN members IS NULL THEN w.pos ELSE w.pos // {FANOUT} END AS pos, CASE WHEN members IS NULL THEN steps ELSE list_append(steps, list_concat([CAST(w.pos % {FANOUT} AS VARCHAR)], members)) END AS steps "
                f"FROM {name}w{i} w LEFT JOIN {name}r{i} g ON g.tree = w.tree AND g.run = w.pos // {FANOUT})"
            )

    grown("s", "r")
    parts.append(f"t0 AS (SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest FROM sn{levels})")
    grown("t", "name")
    others = "list_filter(list_transform(p, lambda x, i: CASE WHEN i > 1 AND i - 2 <> CAST(p[1] AS BIGINT) THEN x END), lambda x: x IS NOT NULL)"
    fold = "list_reduce(list_prepend([start], steps), lambda c, p: [sha256(array_to_string(list_transform(p[2:], lambda x, i: CASE WHEN i - 1 = CAST(p[1] AS BIGINT) THEN c[1] ELSE x END), ''))])[1]"
    parts.append(f"""
whole AS (SELECT d.doc_id, d.leaf, coalesce(d.other, d.leaf) AS start, n.digest AS subroot, top.digest AS root, list_concat(w.steps, u.steps) AS steps
  FROM d JOIN sw{levels} w ON w.r = d.r JOIN sn{levels} n ON n.tree = d.tree JOIN tw{levels} u ON u.r = d.tree CROSS JOIN tn{levels} top),
judged AS (SELECT *, {fold} AS folded_root FROM whole)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda p: array_to_string({others}, '')), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM judged"""
