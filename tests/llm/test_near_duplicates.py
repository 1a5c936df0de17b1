"""SimHash near-duplicates against all pairs."""

import numpy as np
import pytest
import xxhash

from tidepanel.llm import simhash
from tidepanel.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or r in least else None
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "One"), (5, "one two"), (6, " x ÄÖ y z"), (7, "w " * 5000)]
    for i in range(40):
        base = list(rng.choice(words, 150))
        for k in range(4):
            near = list(base)
            for _ in range(k):
                near[int(rng.integers(150))] = "changed"
            rows.append((10 + 4 * i + k, " ".join(near)))
    docs = spark.createDataFrame([(d, t, "fp", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int").repartition(5)
    found = simhash.near_duplicate_groups(docs)
    found = sorted(((r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in found.collect()), key=str)
    assert found == brute_groups(rows)


def test_an_empty_table_gives_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b  c d", "y"), (1, "A b c d", "y"), (2, "q r s t", "z"), (None, "q r s t", "n"), (9, "other words stand here", None)], "doc_id long, text string, _id string")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 9]


@pytest.mark.parametrize("shards", [1, 30])
def test_the_tree_loses_no_link(shards):
    """Fingerprints in tight and loose balls: components of the forest equal those of all pairs within the radius."""
    rng = np.random.default_rng(shards)
    centers = rng.integers(0, 2**63, 60, dtype=np.uint64)
    nodes = {int(c) for c in centers}
    for c in centers:
        for _ in range(15):
            bits = rng.choice(64, int(rng.integers(1, 6)), replace=False)
            nodes.add(int(c) ^ sum(1 << int(b) for b in bits))
    fps = np.array(sorted(nodes), np.uint64)
    tree, _ = simhash.shell_tree(fps, 0 if shards == 1 else 3)
    pairs = [simhash.linked(own, near, 3) for _, own, near in simhash.routed(tree, fps, 3)]
    at = {int(f): i for i, f in enumerate(fps)}
    label = simhash.merged_labels(np.arange(len(fps)), np.array([at[int(x)] for a, _ in pairs for x in a]), np.array([at[int(x)] for _, b in pairs for x in b]))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert (label == simhash.merged_labels(np.arange(len(fps)), a, b)).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = dict(map(tuple, connected_components(edges).collect()))
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_the_trees_of_parts_lose_no_link_and_send_each_fingerprint_once():
    rng = np.random.default_rng(11)
    fps = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    near = fps.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, near]))
    found = set()
    for i in range(4):
        keys = simhash.part_of(fps, i, 4)
        tree, count = simhash.shell_tree(keys, 4)
        sent = list(simhash.routed(tree, fps, 0, keys))
        assert count > 9 and sum(len(own) for _, own, _ in sent) == len(fps) and not any(len(v) for _, _, v in sent)
        found |= {frozenset((int(x), int(y))) for _, own, _ in sent for x in own for y in own if x != y and int(x ^ y).bit_count() <= 3}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert found == {frozenset((int(fps[i]), int(fps[j]))) for i, j in zip(a, b) if i != j}


def test_many_shards_give_the_groups_of_one(spark, monkeypatch):
    rng = np.random.default_rng(12)
    fps = rng.integers(-(2**62), 2**62, 300)
    rows = [(int(f) ^ (1 << int(b)),) for f in fps for b in rng.integers(0, 60, 3)] + [(int(f),) for f in fps]
    nodes = spark.createDataFrame(sorted(set(rows)), "fp long")
    whole = {tuple(r) for r in connected_components(simhash.links(nodes)).collect()}
    monkeypatch.setattr(simhash, "SHARD_NODES", 20)
    assert {tuple(r) for r in connected_components(simhash.links(nodes)).collect()} == whole


def forest_of(pairs, fps):
    at = {int(f): i for i, f in enumerate(fps)}
    return simhash.merged_labels(np.arange(len(fps)), np.array([at[int(x)] for a, _ in pairs for x in a], int), np.array([at[int(x)] for _, b in pairs for x in b], int))


def sharing_a_part(n, seed):
    """Fingerprints with the same low 16 bits, every second of them within three bits of another."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**47, n // 2, dtype=np.uint64) << np.uint64(16) | np.uint64(0xBEEF)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(16, 64, len(base), dtype=np.uint64)
    return np.unique(np.concatenate([base, near]))


def test_a_shard_of_one_frequent_part_is_cut_again():
    fps = sharing_a_part(60_000, 21)
    cut_up = list(simhash.pieces(fps, np.empty(0, np.uint64), 3, 2 * simhash.SHARD_NODES))
    assert len(cut_up) >= 3 and max(len(o) + len(v) for o, v in cut_up) <= 2 * simhash.SHARD_NODES
    assert sorted(np.concatenate([o for o, _ in cut_up]).tolist()) == fps.tolist()  # each lives in one piece
    assert sum(len(v) for _, v in cut_up) > 0  # and visits others over their boundaries
    label = forest_of([simhash.linked(o, v, 3) for o, v in cut_up], fps)
    whole = forest_of([simhash.linked(fps, np.empty(0, np.uint64), 3)], fps)
    assert (label == whole).all() and len(set(label.tolist())) < 0.6 * len(fps)


def test_pieces_with_guests_lose_no_link():
    fps, guests = sharing_a_part(3_000, 22), sharing_a_part(900, 23)
    guests = np.unique(np.concatenate([guests[~np.isin(guests, fps)], fps[:300] ^ np.uint64(1 << 40)]))
    guests = guests[~np.isin(guests, fps)]
    every = np.concatenate([fps, guests])
    label = forest_of([simhash.linked(o, v, 3) for o, v in simhash.pieces(fps, guests, 3, 700)], every)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ every[None, :]) <= 3)
    assert (label == simhash.merged_labels(np.arange(len(every)), a, b)).all()


def test_a_ball_that_no_tree_divides_stays_one_piece():
    ball = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)], np.uint64)
    label = forest_of([simhash.linked(o, v, 3) for o, v in simhash.pieces(ball, np.empty(0, np.uint64), 3, 100)], ball)
    assert set(label.tolist()) == {0}


@pytest.mark.parametrize("kind", ["clustered", "part"])
def test_links_of_many_tasks_equal_all_pairs(spark, kind):
    if kind == "part":
        fps = sharing_a_part(2_400, 24)
    else:  # far balls: one tree over all bits with few visits
        rng = np.random.default_rng(25)
        centers = [0, (1 << 64) - 1, 0xFFFFFFFF]
        fps = np.unique(np.array([c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for c in centers for _ in range(500)], np.uint64))
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
    found = simhash.links(nodes, shard_nodes=150).collect()
    label = forest_of([(np.array([r["a"] for r in found], np.int64).view(np.uint64), np.array([r["b"] for r in found], np.int64).view(np.uint64))], fps)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert (label == simhash.merged_labels(np.arange(len(fps)), a, b)).all()
