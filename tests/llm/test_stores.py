"""Wavelet matrices, FLAC and Hilbert shards: round trips and brute force."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidepanel.llm import flac_media, hilbert, token_store

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000, 8 * token_store.SEGMENT - 1, 8 * token_store.SEGMENT, 300_000])
def test_wavelet_matrix_answers_like_an_array(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(np.array([0, 1, 2, 3, 500, 49407], np.uint32), n)
    m = token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(ids, 16).to_bytes())
    assert (m.ids() == ids).all()
    for token in (0, 2, 49407, 7, 1 << 20):
        assert m.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert m.count(token) == int((ids == token).sum())
        assert m.count(token, n // 3, n // 2) == int((ids[n // 3 : n // 2] == token).sum())
    if n:
        at = rng.integers(0, n, 50)
        assert (m.access(at) == ids[at]).all()


def test_store_equals_the_library(spark, tmp_path):
    rows = [(i * 3, f"text number {i} the cat <|endoftext|> ü " * (i % 7)) for i in range(200)] + [(5, None), (5, ""), (5, "twin"), (None, "no id"), (10_000, "long " * 30_000)]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, n int").repartition(6)
    folder = token_store.write_store(docs, PATH, end_id=2, shard_bytes=2_000, folder=str(tmp_path / "s"))
    store = token_store.read_store(spark, folder)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    encoded = {r: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    packed = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    found = sorted(map(tuple, token_store.documents_of(store).collect()), key=lambda r: r[1])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in found) == sorted((d is not None, d or 0, len(e), packed(e)) for (d, _), e in encoded.items())
    assert [r[0] for r in found] == [None, *sorted(d for d, _ in rows if d is not None)]
    assert [r[1] for r in found] == np.cumsum([0, *[r[2] for r in found][:-1]]).tolist()
    assert store.count() > 1
    total = sum(e.count(2) for e in encoded.values())
    assert token_store.token_counts(store, 2).groupBy().sum("n").first()[0] == total == token_store.token_places(store, 2).distinct().count()
    small = token_store.read_store(spark, token_store.write_store(docs, PATH, end_id=2, shard_ids=50))  # several shards in a range
    assert sorted(map(tuple, token_store.documents_of(small).collect()), key=lambda r: r[1]) == found
    assert small.count() > 10 and small.select("range").distinct().count() == 1
    empty = token_store.read_store(spark, token_store.write_store(docs.limit(0), PATH, end_id=2))
    assert token_store.documents_of(empty).count() == 0


def test_flac_keeps_every_byte(spark):
    texts = [None, "", "a", "x" * 576, "x" * 577, "ünï " * 3000, "\x00" * 600, "The same.", "The same.", "long " * 40_000]
    docs = spark.createDataFrame([(i, t, b"m", "f") for i, t in enumerate(texts)], "doc_id long, text string, media binary, feature string")
    rows = {r["doc_id"]: r for r in flac_media.media_digests(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert rows[7]["media_sha256"] == rows[8]["media_sha256"] and rows[7]["feature"] == rows[8]["feature"]
    assert flac_media.media_digests(docs.limit(0)).count() == 0


def test_flac_frames_are_verified():
    rng = np.random.default_rng(1)
    wave = (60 * np.sin(np.arange(576 * 4) / 9) + rng.normal(0, 2, 576 * 4) + 128).astype(np.uint8).tobytes()
    noise = rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes()
    for lpc in (None, ([30, -15], 4)):
        streams = flac_media.streams_of([wave, noise, b"\x80" * 576], lpc)
        assert [(s.view(np.uint8) ^ 0x80).tobytes() for s in flac_media.samples_of(streams)] == [wave, noise, b"\x80" * 576]
    for at in (65, 80, len(streams[0]) - 1):
        broken = bytearray(streams[0])
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac_media.samples_of([bytes(broken)])


def head(number, size=2, rate=4, depth=1, extra=b"", variable=0):
    own = bytes([0xFF, 0xF8 | variable, size << 4 | rate, depth << 1]) + flac_media.coded_number(number) + extra
    return own + bytes([int(flac_media.crc8(np.frombuffer(own, np.uint8), np.array([0]), np.array([len(own)]))[0])])


def framed(own, bits):
    own += int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    return own + int(flac_media.crc16(np.frombuffer(own, np.uint8), np.array([0]), np.array([len(own)]))[0]).to_bytes(2, "big")


def stream(samples, frames, most):
    info = most.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x81, 0, 0, 3]) + b"pad" + b"".join(frames)


def test_samples_that_look_like_heads_are_samples():
    rng = np.random.default_rng(5)
    for kind in ("plain", "predicted", "constant"):
        payload = rng.integers(0, 256, 576 * 3, dtype=np.uint8) if kind == "plain" else np.full(576 * 3, 200, np.uint8)
        if kind == "predicted":
            payload = (payload + rng.integers(0, 3, len(payload))).astype(np.uint8)
        for number in (0, 1, 2):
            for at in (3, 570, 600, 1500):
                look = np.frombuffer(head(number), np.uint8) ^ 0x80
                own = payload.copy()
                own[at : at + len(look)] = look
                found = flac_media.samples_of(flac_media.streams_of([own.tobytes(), payload.tobytes()]))
                assert [(s.view(np.uint8) ^ 0x80).tobytes() for s in found] == [own.tobytes(), payload.tobytes()], (kind, number, at)


def test_streams_of_other_writers_are_read():
    two = lambda value, width: format(value & (1 << width) - 1, f"0{width}b")
    zigzag = lambda r: r << 1 if r >= 0 else (-r << 1) - 1
    rice = lambda r, k: "0" * (zigzag(r) >> k) + "1" + (two(zigzag(r), k) if k else "")
    # Fixed order 1 with two partitions, the second one plain; then plain samples in a short last frame; depth 0 is the stream's own.
    a = [5, 6, 8, 7, 7, 9, 12, 11]
    left = np.diff(a).tolist()
    bits = two(0x12, 8) + two(5, 8) + "00" + two(1, 4) + two(1, 4) + "".join(rice(r, 1) for r in left[:3]) + two(15, 4) + two(4, 5) + "".join(two(r, 4) for r in left[3:])
    b = [-100, 3, 127]
    short = two(0x02, 8) + "".join(two(x, 8) for x in b)
    frames = [framed(head(0, 6, 0, 0, bytes([7])), bits), framed(head(1, 6, 0, 0, bytes([2])), short)]
    s = stream(a + b, frames, 8)
    assert flac_media.samples_of([s])[0].tolist() == a + b
    assert flac_media.samples_at(s, 6, 4).tolist() == (a + b)[6:10]
    # LPC with five-bit Rice parameters; then a subframe with two wasted bits; numbers of samples, as blocks differ.
    c = [10, 20, 35, 41, 60, 62]
    left = [c[i] - (3 * c[i - 1] - c[i - 2] >> 1) for i in range(2, 6)]
    lpc = two(0x42, 8) + two(10, 8) + two(20, 8) + two(2, 4) + two(1, 5) + two(3, 3) + two(-1, 3) + "01" + two(0, 4) + two(3, 5) + "".join(rice(r, 3) for r in left)
    d = [4, -8, 12, 16]
    waste = two(0x03, 8) + "01" + "".join(two(x >> 2, 6) for x in d)
    frames = [framed(head(0, 6, 12, 1, bytes([5, 8]), 1), lpc), framed(head(6, 7, 13, 1, bytes([0, 3, 0x1F, 0x40]), 1), waste)]
    s = stream(c + d, frames, 6)
    assert flac_media.samples_of([s])[0].tolist() == c + d
    for broken in (s[:-3], s[:-1] + bytes([s[-1] ^ 1]), s[:20]):
        with pytest.raises(ValueError):
            flac_media.samples_of([broken])


def test_pcm_blocks_can_be_sought(spark):
    df = spark.createDataFrame([(1, "abc " * 2000), (2, None)], "doc_id long, text string").select("doc_id", flac_media.payload_of(flac_media.F.col("text")).alias("payload"))
    rows = flac_media.pcm_blocks(flac_media.encode(df).drop("payload"), blocks=4).collect()
    own = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["sample_offset"])
    assert [r["sample_offset"] for r in own] == [i * 2304 for i in range(len(own))]
    s = flac_media.streams_of([bytes(range(256)) * 576])[0]
    assert len(flac_media.Info(s).points) == 4
    for at, n in ((0, 1), (575, 2), (64 * 576, 600), (100_000, 5), (147_000, 9_999)):
        assert (flac_media.samples_at(s, at, n).view(np.uint8) ^ 0x80).tobytes() == (bytes(range(256)) * 576)[at : at + n]
    pcm = b"".join(bytes(r["pcm"]) for r in own)
    assert pcm == ("abc " * 2000).encode() + b"\xff" * (-8000 % 576)


@pytest.mark.parametrize("dimensions,bits", [(2, 3), (3, 2)])
def test_neighbours_on_the_curve_touch(spark, dimensions, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions), -1).reshape(-1, dimensions)
    names = [f"c{i}" for i in range(dimensions)]
    df = spark.createDataFrame([tuple(map(int, c)) for c in cells], ", ".join(f"{n} long" for n in names))
    rows = sorted(hilbert.with_hilbert_index(df, names, "h", bits).collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(side**dimensions))
    assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_have_equal_counts_without_gaps(spark):
    rows = [(i if i % 9 else None, "x" * (i % 50) if i % 11 else None, i % 50 if i % 13 else None, ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 5}", "c") for i in range(1003)] + [(1, "same", 4, "en", "hot", "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string, source string, shard string").repartition(7)
    out = hilbert.shard_documents(docs).collect()
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(rows) and set(by_shard) == set(range(40))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    few = hilbert.shard_documents(docs.limit(7)).collect()
    assert len({r["shard"] for r in few}) == 7
    assert hilbert.shard_documents(docs.limit(0)).count() == 0


def test_ranges_let_readers_skip_shards(spark):
    docs = spark.createDataFrame([(i, "t", (i * 37) % 1000, f"l{i % 4}", f"s{i % 6}") for i in range(4000)], "doc_id long, text string, n_chars long, lang string, source string")
    ranges = hilbert.shard_ranges(hilbert.shard_documents(docs), ["n_chars"]).collect()
    read = sum(1 for r in ranges if r["min_n_chars"] <= 100 and r["max_n_chars"] >= 60)
    assert len(ranges) == 40 and read <= 20


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "a", 1, "en", "s", 7), (1, "b", 2, "de", "s", 7), (1, "b", 2, "de", "s", 7), (2, None, None, None, "t", 7)] + [(i, "x" * (i % 9), i % 9, f"l{i % 4}", f"s{i % 6}", 7) for i in range(3, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string, source string, slot int").repartition(5)
    ranges = hilbert.write_shards(docs, str(tmp_path / "w")).collect()
    back = spark.read.parquet(str(tmp_path / "w"))
    found = back.select("doc_id", "text", "n_chars", "lang", "source").collect()
    assert sorted(map(str, found)) == sorted(map(str, docs.select("doc_id", "text", "n_chars", "lang", "source").collect()))
    places = [(r["shard"], r["slot"]) for r in back.select("shard", "slot").collect()]
    assert len(set(places)) == len(rows) and sum(r["rows"] for r in ranges) == len(rows)
    shards_of = lambda v: {r["shard"] for r in back.filter(back["lang"].eqNullSafe(v)).collect()}
    df = spark.createDataFrame(ranges)
    for v in ("l1", "de", None):
        assert shards_of(v) <= {r["shard"] for r in df.filter(hilbert.may_hold("lang", v)).collect()}
    assert df.filter(hilbert.may_hold("lang", "l1")).count() < 40
    assert hilbert.write_shards(docs.limit(0), str(tmp_path / "e")).count() == 0


def test_pcm_of_long_streams_takes_little_time(spark):
    rng = np.random.default_rng(8)
    wave = (60 * np.sin(np.arange(576 * 35_000) / 9) + rng.normal(0, 2, 576 * 35_000) + 128).astype(np.uint8).tobytes()  # 20 MB
    stream = flac_media.streams_of([wave])[0]
    begun = time.process_time()
    info = flac_media.Info(stream)
    for first in (0, 1, 576 * 17_000 - 3, 576 * 35_000 - 5_000):
        found = flac_media.samples_at(stream, first, 5_000, info)
        assert (found.view(np.uint8) ^ 0x80).tobytes() == wave[first : first + 5_000]
    assert time.process_time() - begun < 5
    df = spark.createDataFrame([(1, bytearray(stream)), (2, None)], "id long, media binary")
    begun = time.time()
    rows = flac_media.pcm_blocks(df).collect()
    assert time.time() - begun < 60  # below 2 seconds a MB
    rows.sort(key=lambda r: r["sample_offset"])
    assert b"".join(bytes(r["pcm"]) for r in rows) == wave and {r["id"] for r in rows} == {1}
    assert [r["sample_offset"] for r in rows] == np.cumsum([0, *[r["n_samples"] for r in rows][:-1]]).tolist()
