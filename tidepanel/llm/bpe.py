"""BPE encoding and decoding by batched numpy merge rounds.

A vocabulary file of word-end BPE (tokens end with `</w>`; NFC, white space dropped, lower case, then a split into
contractions, letter runs, single digits and runs of other signs) is read by path on each worker. Texts are cut at
ASCII white space, which no token crosses. Chunks that a worker has not met yet are split into words, and all new words
are merged together: their symbols lie in one flat array; each round finds every adjacent pair by binary search over
the sorted pair keys, takes the lowest rank of each word, merges its occurrences from the left, and sets finished words
aside. Merging all occurrences of a word's lowest pair at once equals the one-by-one order, because a merge that
uses a new symbol always ranks after the merge that made it.

Scale: a map without shuffle. A worker keeps tables of about MAX_CHUNKS chunks and words (or `limit`); when one is full, the half met later goes.

Cases: null is the empty text, which has no ids and decodes to the empty text; texts of any length are encoded whole;
the strings of special tokens inside a text become those tokens, as the vocabulary file says.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import add_columns

MAX_CHUNKS = 250_000
LEARN_AT_ONCE = 20_000
NEVER = np.iinfo(np.int32).max
#: How the vocabulary splits text into words; the line end stands between chunks here.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+|\n")
SPACES = "\t\n\x0b\x0c\r"


def byte_signs() -> list[str]:
    """The visible character that stands for each byte: itself where it is printable Latin-1, else 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """The tables of one vocabulary file."""

    def __init__(self, path: str, limit: int | None = None):
        self.limit = limit or MAX_CHUNKS
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        signs = byte_signs()
        self.inner = np.array([ids[s] for s in signs], np.int64)
        self.final = np.array([ids[s + suffix] for s in signs], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(order.astype(np.int32), NEVER)
        self.merged = np.append(np.array([ids[a + b] for a, b in pairs], np.int64)[order], 0)
        self.token = [b""] * self.size
        for text, i in [*ids.items(), *self.special.items()]:
            self.token[i] = text.encode()
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks, self.words = _Table(), _Table()
        self.word_ids, self.word_at = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.chunk_ids, self.chunk_at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and each word's number of ids."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol, word = self.inner[flat], np.repeat(np.arange(len(raw)), size)
        last = np.cumsum(size) - 1
        symbol[last] = self.final[flat[last]]
        done_symbol, done_word = [], []
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            key = np.empty_like(symbol)
            key[:-1] = symbol[:-1] * self.size + symbol[1:]
            key[np.append(first[1:], len(symbol)) - 1] = -1  # no pair begins at a word's last symbol
            at = np.searchsorted(self.keys, key)
            rank = np.where(self.keys[at] == key, self.rank[at], NEVER)
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbol))))
            over = lowest == NEVER
            hit = np.flatnonzero((rank == lowest) & ~over)
            # In a run such as aaa the pairs overlap: every second one counts, from the left.
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            symbol[hit] = self.merged[at[hit]]
            done_symbol.append(symbol[over])
            done_word.append(word[over])
            over[hit + 1] = True
            symbol, word = symbol[~over], word[~over]
        if not done_symbol:
            return np.empty(0, np.uint32), np.zeros(len(raw), np.int64)
        word = np.concatenate(done_word)
        return np.concatenate(done_symbol)[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(raw))

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new chunks, one after another, and each chunk's number of ids."""
        marked = [i for i, c in enumerate(chunks) if "<" in c and self.marks.search(c)] if self.marks else []
        if marked:
            parts, at = [], 0
            for i in [*marked, len(chunks)]:
                if i > at:
                    parts.append(self.learn(chunks[at:i]))
                if i < len(chunks):
                    own = self._with_marks(chunks[i])
                    parts.append((own, np.array([len(own)])))
                at = i + 1
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        text = "\n".join(chunks)  # no chunk has this sign
        if not text.isascii():
            text = "\n".join(unicodedata.normalize("NFC", c) for c in chunks).replace("Σ", "σ")
        found = WORDS.findall(text.lower())
        index = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        if self.words.new:
            own = [w for w in self.words.new if w != "\n"]
            ids, size = self.merge(own) if own else (np.empty(0, np.uint32), np.empty(0, np.int64))
            if len(own) < len(self.words.new):  # the sign between chunks has no ids
                size = np.insert(size, self.words.new.index("\n"), 0)
            self.words.new = []
            self.word_at = np.append(self.word_at, self.word_at[-1] + np.cumsum(size))
            self.word_ids = np.append(self.word_ids, ids)
        size = self.word_at[index + 1] - self.word_at[index]
        between = np.flatnonzero(index == self.words.get("\n", -1))
        ends = np.append(0, np.cumsum(size))
        return gather(self.word_ids, self.word_at[index], size), np.diff(ends[np.append(between, len(index))], prepend=0)

    def _with_marks(self, chunk: str) -> np.ndarray:
        parts = self.marks.split(chunk)
        return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else self.learn([p])[0] for p in parts if p])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one after another, and each text's number of ids."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.chunks) > self.limit:
            self.chunks, self.chunk_ids, self.chunk_at = older_half(self.chunks, self.chunk_ids, self.chunk_at)
        if len(self.words) > self.limit:
            self.words, self.word_ids, self.word_at = older_half(self.words, self.word_ids, self.word_at)
        # Arrow cuts the texts and finds the different chunks among them; only those become Python strings.
        column = pa.array(texts, pa.string())
        for space in SPACES:
            column = pc.replace_substring(column, space, " ")
        cut = pc.split_pattern(column, " ")
        coded = cut.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = np.fromiter(map(self.chunks.__getitem__, different), np.int64, len(different))
        new, self.chunks.new = self.chunks.new, []
        for at in range(0, len(new), LEARN_AT_ONCE):
            ids, size = self.learn(new[at : at + LEARN_AT_ONCE])
            self.chunk_at = np.append(self.chunk_at, self.chunk_at[-1] + np.cumsum(size))
            self.chunk_ids = np.append(self.chunk_ids, ids)
        flat = index[coded.indices.to_numpy()]
        size = self.chunk_at[flat + 1] - self.chunk_at[flat]
        ends = np.append(0, np.cumsum(size))
        return gather(self.chunk_ids, self.chunk_at[flat], size), np.diff(ends[cut.offsets.to_numpy()])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids with a space between them: the vocabulary has no decoder that would undo the split."""
        return b" ".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Table(dict):
    """Numbers for keys as they come, and the keys that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


def older_half(table: _Table, ids: np.ndarray, at: np.ndarray) -> tuple[_Table, np.ndarray, np.ndarray]:
    """The half of a table that was met first: frequent keys are among it."""
    n = len(table) // 2
    kept = _Table()
    kept.update(zip(islice(table, n), range(n)))
    return kept, ids[: at[n]].copy(), at[: n + 1].copy()


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every range, one after another."""
    ends = np.cumsum(size)
    shift = np.repeat(start - (ends - size), size)
    return values[shift + np.arange(len(shift))]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `n_tokens` and `ids`: the ids as little-endian unsigned 32-bit integers."""
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField(ids, T.BinaryType())])

    def work(texts: list) -> list[pa.Array]:
        flat, n = vocabulary(path).encode([t or "" for t in texts])
        at = np.append(0, np.cumsum(n)).astype(np.int32) * 4
        packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(flat.astype("<u4"))])
        return [pa.array(n.astype(np.int64)), packed]

    return add_columns(docs, text, added, work, keep)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`encoded` (or its columns `keep`) with the text of its ids; null ids are no ids."""

    def work(packed: list) -> list[pa.Array]:
        v = vocabulary(path)
        return [pa.array([v.decode(np.frombuffer(p or b"", "<u4")) for p in packed], pa.string())]

    return add_columns(encoded, ids, T.StructType([T.StructField(text, T.StringType())]), work, keep)


def round_trip_digests(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the digests of its ids and of what they decode to."""
    encoded = encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, keep=["doc_id"])
    return decode(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
