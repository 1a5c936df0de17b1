"""Merkle manifests, importance resampling and chunk recipes against brute force and SQL."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_text_operators import words_of
from tidepanel.llm import chunk_dedup, importance, merkle
from tidepanel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = [
    (1, "a", "en", 3, "one\ntwo"), (2, "a", None, None, None), (3, None, "de", 0, ""), (4, None, "de", 5, "ünï\n\n"), (5, "", "en", 1, "x\n"), (5, "", "en", 1, "x\n"), (None, "a", "en", 2, "no id\n"), (None, "a", "en", 2, "none\n"),
    (6, "é", "en", 1, "only\n"), (7, "zz", "es", 1, "-"), (8, "zz", "-", 1, None), *[(i, "hot", "fr", i, f"row {i}\nend") for i in range(100, 190)], (9, "long", "en", 1, "word\n" * 400_000),
]


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest([one(r[k]) for k in range(5)])

    def climb(nodes):
        """The root, and each node's steps: the run that it is in and its place there."""
        steps, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
            for k, w in enumerate(where):
                steps[k].append((runs[w // 3], w % 3))
                where[k] = w // 3
            nodes = [digest(r) for r in runs]
        return nodes[0], steps

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, high = climb([low[s][0] for s in names])
    out = []
    for s, above in zip(names, high):
        for (_, _, own, r), below in zip(sorted(trees[s], key=lambda x: x[:3]), low[s][1]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf((*r[:4], r[4].replace("\n", ""))) if changed else own
            for run, at in below + above:
                now = digest([*run[:at], now, *run[at + 1 :]])
            proof = digest([d for run, at in below + above for d in run[:at] + run[at + 1 :]])
            out.append((r[0], own, low[s][0], root, proof, now, now == root))
    return sorted(out, key=str)


def test_manifest_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "clash", "x") for r in ROWS], COLUMNS + ", leaf string, at string").repartition(5)
    found = sorted((tuple(r) for r in merkle.tampering_report(docs).collect()), key=str)
    assert found == brute_manifest(ROWS)
    assert 0 < sum(r[-1] for r in found) < len(found)
    assert merkle.tampering_report(docs.limit(0)).count() == 0
    assert [r["root"] == r["leaf"] for r in merkle.tampering_report(docs.filter("doc_id = 9")).collect()] == [True]


def test_superblocks_of_several_reductions(spark):
    rows = [(i, "s" if i % 10 else f"s{i % 70}", "en", i, f"t{i}\n") for i in range(2_300)]  # more than one bucket of 3^7
    docs = spark.createDataFrame(rows, COLUMNS).repartition(7)
    assert sorted((tuple(r) for r in merkle.tampering_report(docs).collect()), key=str) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 26, 27, 28, 81, 82, 243])
def test_proofs_lead_to_the_root(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = math.ceil(round(math.log(n, 3), 9))
    proofs, top = merkle.collapsed(leaves, levels)
    assert all(merkle.folded(d, p) == top for d, p in zip(leaves, proofs))
    assert n == 1 or merkle.folded(leaves[-1], proofs[0]) != top


def test_facts_of_many_trees_meet_rows_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(ROWS, COLUMNS)
    assert sorted((tuple(r) for r in merkle.tampering_report(docs).collect()), key=str) == brute_manifest(ROWS)


def brute_draw(docs, items):
    def features(text):
        w = words_of(text)
        return len(w), collections.Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))

    own = [(i, *features(x)) for i, x in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in own:
        s.update(f)
    for x in items:
        t.update(features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in f.items())
        out.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_draw_equals_brute_force(spark):
    items = ["Alpha beta gamma. delta", None, "", "beta GAMMA ünï"]
    docs = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i % 60)) + " beta gamma" * (i % 5)) for i in range(300)]
    docs += [(500, None), (501, ""), (502, "?! .,"), (503, "Ünï-ünï x"), (7, docs[7][1]), (None, "alpha " * 40), (504, "same " * 30_000), (505, "İß \x00 a\x7fb `c` {d}")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, weight string, rank int").repartition(4)
    b = spark.createDataFrame([(x, 3) for x in items], "text string, doc_id int")
    assert sorted((tuple(r) for r in importance.resampled(d, b).collect()), key=str) == brute_draw(docs, items)
    assert importance.resampled(d.limit(0), b).count() == 0
    assert sorted((tuple(r) for r in importance.resampled(d, b.limit(0)).collect()), key=str) == brute_draw(docs, [])


def test_draw_on_the_smallest_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_feature_dictionary"](spark, SF).collect()), key=str) == brute_draw(docs, items)


def test_pieces_of_long_texts_have_the_runs_of_the_whole(monkeypatch):
    texts = ["a b c d e f g h " * 20, None, "", "x", "one-long-word" * 9, "ü " + "y" * 300 + " z q r", "  ", "p q"]

    def found():
        out = collections.Counter()
        for block in importance.pieces(texts):
            vocabulary, word, row, next_ = importance.tokens(block)
            names = [*vocabulary.to_pylist(), b""]
            key, at = importance.windows(word, row, next_, len(vocabulary))
            for k, r in zip(key.tolist(), at.tolist()):
                n = len(vocabulary) + 1
                window = [x for x in (names[k // n // n], names[k // n % n], names[k % n]) if x]
                for size in range(1, len(window) + 1):
                    out[block[r][0], b" ".join(window[:size])] += 1
        return out

    whole = found()
    assert whole.total() == sum(max(0, len(words_of(t)) - n) for t in texts for n in range(3))
    for size in (1, 7, 30, 64):
        monkeypatch.setattr(importance, "BLOCK", size)
        assert found() == whole


def test_packing_and_checksums_of_many_strings():
    rng = np.random.default_rng(5)
    words = [rng.bytes(int(n)) for n in rng.integers(0, 40, 500)] + [b"", b"x" * 5_000]
    assert importance.crc32(*importance.strings(pa.array(words, pa.binary()))).tolist() == [zlib.crc32(w) for w in words]
    assert len(importance.crc32(np.empty(0, np.uint32), np.empty(0, np.uint8))) == 0
    arrays = [rng.integers(0, 1 << 32, 100).astype(np.uint32), np.empty(0, np.uint32), np.arange(7, dtype=np.uint8), np.array([-(2**63), 5], np.int64).view(np.uint64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, importance.unpacked(importance.packed(*arrays))))


def brute_copies(docs):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[plain(t)].append(i)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        stays = ids.index(least)
        out += [(i, least, len(ids), k == stays, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def copies():
    long = "".join(f"sentence {i} of a long text.\n" for i in range(6_000))
    docs = [(1, None), (2, ""), (3, " "), (4, "\t\n"), (5, "a b"), (6, "a \t b"), (7, "a b "), (8, " a b"), (9, long), (10, long.replace("\n", "\r\n")), (11, long + "x"), (12, "x" + long), (13, long[:-1]), (5, "a b"), (6, "other"), (None, "a b"), (None, "nobody"), (None, "nobody")]
    return docs + [(14, "   "), (15, "  "), (16, "z" * 100_000), (17, "z" * 100_000), (18, "z" * 99_999), *[(100 + i, "hot copy") for i in range(400)]]


def test_recipes_equal_brute_force(spark):
    docs = copies()
    d = spark.createDataFrame([(*r, "x", b"y", 1) for r in docs], "doc_id long, text string, recipe string, id binary, salt int").repartition(4)
    assert sorted((tuple(r) for r in chunk_dedup.duplicate_groups(d).collect()), key=str) == brute_copies(docs)
    # Identifiers of one byte stand for several chunks each, so they are widened until they don't.
    assert sorted((tuple(r) for r in chunk_dedup.duplicate_groups(d, width=1).collect()), key=str) == brute_copies(docs)
    assert chunk_dedup.duplicate_groups(d.limit(0)).count() == 0
    kept = chunk_dedup.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in brute_copies(docs) if r[3])


def test_chunks_follow_the_content():
    gear = chunk_dedup.gears()
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 300_000, dtype=np.uint8).tobytes()
    chunks, counts = chunk_dedup.chunks_of([text, b"new " + text, b"", b"z" * 50_000], gear)
    assert counts[2] == 0 and b"".join(chunks[: counts[0]]) == text
    assert max(map(len, chunks)) <= chunk_dedup.MOST and len(set(chunks[: counts[0]]) & set(chunks[counts[0] : counts[0] + counts[1]])) > 0.9 * counts[0]
    flat = np.frombuffer(text, np.uint8)
    whole = chunk_dedup.cut_candidates(flat, gear)
    slow = [i + 1 for i in range(2_000) if sum(int(gear[flat[i - j]]) << j for j in range(min(chunk_dedup.GEAR, i + 1))) % (1 << 32) >> 32 - chunk_dedup.MEAN_BITS == 0]
    assert whole[whole <= 2_000].tolist() == slow


def test_cuts_do_not_depend_on_the_step(monkeypatch):
    gear, text = chunk_dedup.gears(), np.random.default_rng(4).integers(0, 256, 100_000, dtype=np.uint8)
    whole = chunk_dedup.cut_candidates(text, gear).tolist()
    monkeypatch.setattr(chunk_dedup, "STEP", 777)
    assert chunk_dedup.cut_candidates(text, gear).tolist() == whole and len(whole) > 20


@pytest.mark.parametrize("name", ["op11_superblocks", "op12_feature_dictionary", "op13_chunk_recipes"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted((tuple(r) for r in ours.select(*names).collect()), key=str) == sorted(theirs.fetchall(), key=str)
