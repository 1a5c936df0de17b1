"""SimHash near-duplicates: 64-bit fingerprints, linked at few differing bits through vantage-point trees.

Fingerprint: words of the text (A-Z lower-cased, cut at ASCII white space), shingles of 3 words joined by a space, XXH64
with seed 42 of each; a bit is set if it is set in over half of the hashes. Fewer words than a shingle make one shingle; no
words make fingerprint 0, which is linked like any other.

Links: equal fingerprints are one node from the start. A vantage-point tree cuts them into shards: an inner node splits by the Hamming
distance to its vantage point into three shells. A fingerprint lives in one shard and, by the triangle inequality, can have partners
only in shards that its distances come within RADIUS of; those near a boundary visit the shards behind it, where they are compared with
what lives there. Inside a shard another tree, with a shell for each distance, follows only the shells within RADIUS of a fingerprint's own
distance, down to small leaves, where pairs are compared exactly. So no link is lost, and no band or bucket has to be capped.

Random fingerprints lie near the boundaries of every shell, and visits grow with the tree's depth. So where the sample says that a
fingerprint would be in more than RADIUS + 1 shards, the first level is by parts: of two fingerprints that differ in RADIUS bits or fewer, one of
RADIUS + 1 equal parts of the bits is the same in both, and a tree over each part sends a fingerprint to one shard. A shard of more than
twice SHARD_NODES, such as that of one frequent part, is cut again by a tree over all bits, with visits over its boundaries, and
its pieces are other tasks' work.

Scale: few nodes (SHARD_NODES) make one shard. A shard gives back a forest over its nodes, not its pairs: at most one link per
node, however large a group of near copies is. Fingerprints travel as packed arrays, one row per batch and shard. The sample (SAMPLE rows, and
every value of a part once shards outnumber it) only balances the shards. Components are joined up by star contraction, and a component's smallest id meets its members in SALTS parts; nothing about all documents reaches
the driver.

Cases: null or empty texts have fingerprint 0; repeated rows and ids are kept as rows; a component without any id has a
null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.components import connected_components
from tidepanel.llm.shared import add_columns, without
from tidepanel.session import cut

SHINGLE = 3
SEED = 42
RADIUS = 3
SAMPLE = 4096
SHARD_NODES = 20_000
LEAF = 64
MAX_PAIRS = 1 << 20
SALTS = 32


def shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    return np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, text: str = "text", out: str = "fp", size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the signed 64-bit fingerprint of each text."""
    work = lambda texts: [pa.array([fingerprint(shingle_hashes(t or "", size)) for t in texts], pa.int64())]
    return add_columns(docs, text, T.StructType([T.StructField(out, T.LongType())]), work, keep)


def distances(a: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ point)


def vantage(nodes: np.ndarray) -> np.uint64:
    """Of a few nodes, the one whose distances to the others differ most."""
    tried = nodes[:: max(1, len(nodes) // 5)][:5]
    seen = nodes[:: max(1, len(nodes) // 500)]
    return tried[int(np.argmax([distances(seen, t).astype(np.int64).var() for t in tried]))]


@dataclass
class Shells:
    """An inner node of the tree over shards: the vantage point, and each child's range of distances to it."""

    point: int = 0
    ranges: list[tuple[int, int]] = field(default_factory=list)
    children: list = field(default_factory=list)
    shard: int = -1


def shell_tree(sample: np.ndarray, depth: int) -> tuple[Shells, int]:
    """A tree of `depth` levels at most over the sample, and its number of shards."""
    count = 0

    def grow(nodes: np.ndarray, left: int) -> Shells:
        nonlocal count
        if left and len(nodes) >= 9:
            point = vantage(nodes)
            far = distances(nodes, point).astype(np.int64)
            edges = sorted({int(np.quantile(far, q)) for q in (1 / 3, 2 / 3)} - {int(far.max())})
            if edges:
                lows = [0, *(e + 1 for e in edges)]
                highs = [*edges, 64]
                kids = [grow(nodes[(far >= lo) & (far <= hi)], left - 1) for lo, hi in zip(lows, highs)]
                return Shells(int(point), list(zip(lows, highs)), kids)
        count += 1
        return Shells(shard=count - 1)

    return grow(sample, depth), count


def part_of(fps: np.ndarray, i: int, parts: int) -> np.ndarray:
    """The bits of the i-th of `parts` parts of each fingerprint, as a number of its own."""
    low, high = 64 * i // parts, 64 * (i + 1) // parts
    return fps >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)


def routed(tree: Shells, fps: np.ndarray, radius: int, keys: np.ndarray | None = None, guests: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its own fingerprints, those that visit it), empty ones left out. The tree is over `keys`, the fingerprints unless they are given; equal
    keys (radius 0) visit nothing. `guests` live elsewhere and visit wherever they may have partners."""
    live = len(fps)
    fps = fps if guests is None else np.concatenate([fps, guests])
    keys = fps if keys is None else keys

    def walk(node: Shells, own: np.ndarray, near: np.ndarray) -> Iterator:
        """own: indices that live below this node; near: indices that live elsewhere and may have neighbours here."""
        if node.shard >= 0:
            yield node.shard, own, near
            return
        far_own = distances(keys[own], np.uint64(node.point)).astype(np.int64)
        far_near = distances(keys[near], np.uint64(node.point)).astype(np.int64)
        for (lo, hi), child in zip(node.ranges, node.children):
            # A pair that spans two shards is looked for in the later one: what lives further in visits nothing back.
            before = own[(far_own < lo) & (far_own >= lo - radius)]
            inside = near[(far_near >= lo - radius) & (far_near <= hi + radius)]
            yield from walk(child, own[(far_own >= lo) & (far_own <= hi)], np.concatenate([inside, before]))

    for shard, own, near in walk(tree, np.arange(live), np.arange(live, len(fps))):
        if len(own) or len(near):
            yield shard, fps[own], fps[near]


def depth_for(n: int, most: int) -> int:
    depth = 0
    while n > most * 3**depth:
        depth += 1
    return depth


def pieces(own: np.ndarray, near: np.ndarray, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A shard cut into smaller ones, by trees over all bits, until each has `most` fingerprints at the utmost or no tree makes it smaller."""
    stack = [(own, near)]
    while stack:
        own, near = stack.pop()
        size = len(own) + len(near)
        if not len(own):
            continue
        if size <= most:
            yield own, near
            continue
        tree, _ = shell_tree(own[:: max(1, len(own) // SAMPLE)], max(1, depth_for(size, most)))
        cut_up = [(o, v) for _, o, v in routed(tree, own, radius, guests=near)]
        if max(len(o) + len(v) for o, v in cut_up) > 0.9 * size:
            yield own, near
        else:
            stack += cut_up


def merged_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's smallest known partner) after the pairs are linked."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def linked(own: np.ndarray, near: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over own and near that joins all whose distance to one of own is `radius` or less."""
    nodes = np.concatenate([own, near])
    label = np.arange(len(nodes))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        nonlocal label, waiting
        if pairs:
            label = merged_labels(label, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        pairs.clear()
        waiting = 0

    def compare(held: np.ndarray, asked: np.ndarray) -> None:
        nonlocal waiting
        step = max(1, MAX_PAIRS // len(held))
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            q, h = np.nonzero(np.bitwise_count(nodes[part][:, None] ^ nodes[held][None, :]) <= radius)
            q, h = part[q], held[h]
            new = (q != h) & (label[q] != label[h])
            if new.any():
                pairs.append((q[new], h[new]))
                waiting += int(new.sum())
                if waiting > MAX_PAIRS:
                    settle()

    stack = [(np.arange(len(own)), np.arange(len(nodes)))]
    while stack:
        held, asked = stack.pop()
        if not len(held) or not len(asked):
            continue
        if len(held) <= LEAF:
            compare(held, asked)
            continue
        point = vantage(nodes[held])
        far_held, far_asked = distances(nodes[held], point), distances(nodes[asked], point)
        if int(far_held.max()) - int(far_held.min()) <= 1:  # a ball that no shell divides
            compare(held, asked)
            continue
        held, asked = held[np.argsort(far_held, kind="stable")], asked[np.argsort(far_asked, kind="stable")]
        far_held, far_asked = np.sort(far_held).astype(np.int64), np.sort(far_asked).astype(np.int64)
        for shell in np.unique(far_held):
            a, b = np.searchsorted(far_held, [shell, shell + 1])
            c, d = np.searchsorted(far_asked, [shell - radius, shell + radius + 1])
            stack.append((held[a:b], asked[c:d]))
    settle()
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(nodes: DataFrame, *, fp: str = "fp", radius: int = RADIUS, shard_nodes: int | None = None) -> DataFrame:
    """A forest (a, b) over distinct fingerprints that has the components of all pairs at `radius` bits or less."""
    nodes = nodes.select(F.col(fp).alias("fp"))
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    shard_nodes = shard_nodes or SHARD_NODES
    depth, parts = depth_for(n, shard_nodes), radius + 1
    tree, shards = shell_tree(sample, depth)
    visits = sum(len(o) + len(v) for _, o, v in routed(tree, sample, radius)) / max(1, len(sample))
    trees = []  # by part; none: one tree over all bits
    if depth and visits > parts:
        shards = 0
        for i in range(parts):
            keys = part_of(sample, i, parts)
            if 3**depth * 32 > SAMPLE and 64 // parts <= 16:
                keys = np.concatenate([keys, np.arange(1 << 64 * (i + 1) // parts - 64 * i // parts, dtype=np.uint64)])
            by_part, count = shell_tree(keys, depth)
            trees.append((shards, by_part))
            shards += count
    packed = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("own", T.BinaryType()), T.StructField("near", T.BinaryType())])
    found = T.StructType([T.StructField("own", T.BinaryType()), T.StructField("near", T.BinaryType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    most = 2 * shard_nodes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            to = ((first + s, o, v) for i, (first, t) in enumerate(trees) for s, o, v in routed(t, fps, 0, part_of(fps, i, parts))) if trees else routed(tree, fps, radius)
            rows = [(s, o.tobytes(), v.tobytes()) for s, o, v in to]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=packed.names)

    def pairs(own: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        a, b = linked(own, near, radius)
        nothing = pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_arrays([nothing, nothing, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=found.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of each shard, or the pieces of one that is too large."""
        now, own, near = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            mine, guests = (np.frombuffer(b"".join(x), np.uint64) for x in (own, near))
            if len(mine) + len(guests) <= most:
                yield pairs(mine, guests)
                return
            for o, v in pieces(mine, guests, radius, most):
                yield pa.RecordBatch.from_arrays([pa.array([o.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=found.names)

        for batch in batches:
            for shard, o, v in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if own:
                        yield from flush()
                    now, own, near = shard, [], []
                own.append(o)
                near.append(v)
        if own:
            yield from flush()

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pairs(np.frombuffer(o, np.uint64), np.frombuffer(v, np.uint64))

    dealt = nodes.mapInArrow(send, packed).repartition(max(1, shards), "shard").sortWithinPartitions("shard")
    first = cut(dealt.mapInArrow(search, found))
    open_ = first.filter("own is not null")
    left = open_.count()
    done = first.filter("own is null").select("a", "b")
    return done.unionByName(open_.repartition(left).mapInArrow(rest, found).select("a", "b")) if left else done


def near_duplicate_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest id that is reachable over links, its own included)."""
    own = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size=size, keep=["doc_id"]))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes, radius=radius))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    joined = nodes.join(members, nodes["fp"] == members["node"]).select("fp", "least", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    least = joined.groupBy("root").agg(F.min("least").alias("_least")).select("root", "_least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    linked_ = joined.join(least, ["root", "salt"]).select(F.col("fp").alias("_fp"), "_least")
    alone = F.col("_fp").isNull()
    named = nodes.join(linked_, nodes["fp"] == linked_["_fp"], "left").select("fp", F.when(alone, F.col("least")).otherwise(F.col("_least")).alias("component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group; of rows that share that id one stays, of those without id all."""
    groups = cut(near_duplicate_groups(docs, doc_id=doc_id, text=text, size=size, radius=radius))
    kept = without(docs, groups.filter("doc_id <> component_id").select("doc_id"), doc_id)
    shared = cut(groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id")))
    if shared.isEmpty():
        return kept
    # Only rows that share an id are gathered by it.
    twins = kept.join(shared, kept[doc_id] == shared["_id"], "left_semi").dropDuplicates([doc_id])
    return without(kept, shared, doc_id).unionByName(twins)
