"""FLAC media columns: binary payloads stored as 8-bit mono FLAC streams, read back, verified, sought in and cut into PCM blocks.

The writer takes payload bytes as samples (byte - 128), cuts frames of 576 samples and gives each frame the cheapest of a
constant, a fixed linear predictor of order 0 to 2 with Rice-coded residuals, or plain samples; a seek table has the place of every
SEEK-th frame. The reader takes any mono 8-bit stream: block sizes of every code, fixed or variable, a shorter last frame; constant,
plain, fixed (order 0 to 4) and LPC subframes, wasted bits; both kinds of Rice partitions with their escapes. It checks the
CRC-8 of each header, the CRC-16 of each frame, the running number, the count of samples and the MD5 of the stream.

All frames of a slice of rows are worked on together: one numpy step codes or decodes the i-th residual of every frame. For
that the frames' heads are looked for; where a stream's heads and checksums do not all fit, because samples look like a head or it is another
writer's stream, it is decoded frame by frame from its start instead, where each frame's end tells where the next one begins.

Scale: maps without shuffle; memory depends on SLICE, or on the one stream that is longer. `media_digests` writes the streams to
the shared folder and works on what it reads there.

Cases: null or empty text makes one frame of padding; a stream that fails a check raises ValueError with the reason; a null media
value decodes to null; the writer asks for payloads of whole blocks, which `payload_of` makes.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.shared import slices
from tidepanel.session import shared_dir

BLOCK = 576
SLICE = 1 << 20
SAMPLE_RATE = 8000
SEEK = 64  # frames from one seek point to the next
PCM_RUNS = 64  # runs of PCM that are decoded together
#: Fixed values of the format: predictors by order, and the code of a frame's head (sync, 576 samples, 8 kHz, mono, 8 bits).
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
HEAD = bytes([0xFF, 0xF8, 0x24, 0x02])


def _crc_table(poly: int, bits: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, value << 1 ^ poly, value << 1) & ((1 << bits) - 1)
    return value.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
ZEROS16 = np.array([16, *(16 - int(i).bit_length() for i in range(1, 1 << 16))], np.uint8)  # leading zeros


def _right_aligned(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The byte ranges as columns, with zeros in front of shorter ones; a checksum of 0 passes over those."""
    width = int((last - first).max())
    at = last[None, :] - width + np.arange(width)[:, None]
    return np.where(at >= first, data[np.maximum(at, 0)], 0)


def crc8(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(first), np.uint16)
    for row in _right_aligned(data, first, last):
        crc = CRC8[crc ^ row]
    return crc


def crc16(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(first), np.uint16)
    for row in _right_aligned(data, first, last):
        crc = (crc << 8) ^ CRC16[(crc >> 8) ^ row]
    return crc


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of the format."""
    if n < 0x80:
        return bytes([n])
    tail: list[int] = []
    while n >> (6 - len(tail)):  # what is left doesn't fit beside the marks of the leading byte
        tail.insert(0, 0x80 | n & 0x3F)
        n >>= 6
    return bytes([0xFF << (7 - len(tail)) & 0xFF | n, *tail])


def residuals(samples: np.ndarray, coefficients: list[int], shift: int = 0) -> np.ndarray:
    """What a linear predictor leaves of the samples (rows) after its first len(coefficients)."""
    order, n = len(coefficients), samples.shape[1]
    out = samples[:, order:].astype(np.int32)
    if order:
        out = out - (sum(c * samples[:, order - 1 - j : n - 1 - j].astype(np.int32) for j, c in enumerate(coefficients)) >> shift)
    return out


def frames_of(samples: np.ndarray, numbers: np.ndarray, lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """One frame for each row of samples. lpc: coefficients and shift of a predictor to use instead of the fixed ones."""
    n_frames, size = samples.shape
    if lpc and not all(-(1 << 14) <= c < 1 << 14 for c in lpc[0]):
        raise ValueError("a coefficient has 15 bits")
    if not n_frames:
        return []
    heads = [HEAD + coded_number(int(i)) for i in numbers]
    head = np.array([len(h) + 1 for h in heads])
    if lpc:
        kind, coefficients = np.full(n_frames, 3), [lpc]
    else:
        cost = np.stack([np.abs(residuals(samples, FIXED[o])).sum(1) for o in range(3)])
        kind, coefficients = cost.argmin(0), [(FIXED[o], 0) for o in range(3)]
    constant = (samples == samples[:, :1]).all(1)
    bytes_of, ready = np.zeros(n_frames, np.int64), {}
    plain = np.ones(n_frames, bool)
    for o in range(len(coefficients)):
        rows = np.flatnonzero((kind == (3 if lpc else o)) & ~constant)
        if not len(rows):
            continue
        left = residuals(samples[rows], *coefficients[o])
        code = (left << 1) ^ (left >> 31)
        k = np.clip(np.log2(np.maximum(code.mean(1), 1)).astype(int), 0, 14)
        low = np.maximum(k - 1, 0)
        quotients = lambda k: (code >> k[:, None]).sum(1) + code.shape[1] * (k + 1)  # noqa: E731, B023
        k = np.where(quotients(low) < quotients(k), low, k)
        bits = quotients(k) + 10 + 8 * len(coefficients[o][0]) + (9 + 15 * len(coefficients[o][0]) if lpc else 0)
        fits = (bits + 7) // 8 < size
        rows, code, k, bits = rows[fits], code[fits], k[fits], bits[fits]
        plain[rows] = False
        bytes_of[rows] = (bits + 7) // 8
        ready[o] = (rows, code, k)
    plain &= ~constant
    bytes_of[plain], bytes_of[constant] = size, 1
    total = head + 1 + bytes_of + 2
    ends = np.cumsum(total)
    start = ends - total
    bit = np.zeros(int(ends[-1]) * 8, np.uint8)
    for o, (rows, code, k) in ready.items():
        order = len(coefficients[o][0])
        first = (start[rows] + head[rows] + 1) * 8 + 8 * order
        if lpc:  # precision of 15 bits, shift, coefficients
            field = [(14, 4), (lpc[1], 5), *((c & 0x7FFF, 15) for c in lpc[0])]
            for value, width in field:
                for j in range(width):
                    bit[first + j] = value >> (width - 1 - j) & 1
                first = first + width
        for j in range(4):  # coding method 0, partition order 0, then the parameter
            bit[first + 6 + j] = k >> (3 - j) & 1
        for kk in np.unique(k):
            own = k == kk
            q = code[own] >> kk
            length = q + (1 + kk)
            mark = (first[own] + 10)[:, None] + np.cumsum(length, 1) - length + q
            bit[mark.ravel()] = 1
            for j in range(kk):
                bit[(mark + (1 + j)).ravel()] = ((code[own] >> (kk - 1 - j)) & 1).ravel()
    data = np.packbits(bit)
    body = start + head
    raw = samples.astype(np.int8).view(np.uint8)
    for o, (rows, _, _) in ready.items():
        order = len(coefficients[o][0])
        data[body[rows]] = (0x40 | (order - 1) << 1) if lpc else (0x10 | order << 1)
        for j in range(order):
            data[body[rows] + 1 + j] = raw[rows, j]
    rows = np.flatnonzero(plain)
    data[body[rows]] = 0x02
    data[(body[rows] + 1)[:, None] + np.arange(size)] = raw[rows]
    rows = np.flatnonzero(constant)
    data[body[rows] + 1] = raw[rows, 0]
    for i, h in enumerate(heads):
        data[start[i] : start[i] + len(h)] = np.frombuffer(h, np.uint8)
    data[body - 1] = crc8(data, start, body - 1)
    check = crc16(data, start, ends - 2)
    data[ends - 2], data[ends - 1] = check >> 8, check & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), ends.tolist())]


def streams_of(payloads: list[bytes], lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """A FLAC stream for each payload of whole blocks."""
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"a payload is a positive multiple of {BLOCK} bytes")
    count = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in count]) if count else np.empty(0, int)
    frames, out, at = frames_of(samples, numbers, lpc), [], 0
    for p, c in zip(payloads, count):
        own = frames[at : at + c]
        digest = hashlib.md5(samples[at : at + c].astype(np.int8).tobytes()).digest()
        at += c
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + digest
        before = np.cumsum([0, *sizes])
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(before[i]), BLOCK) for i in range(0, c, SEEK))
        out.append(b"fLaC" + bytes([0, 0, 0, len(info)]) + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


class _Bits:
    """Reads a field of every frame at once; `at` holds each frame's place in bits."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = np.append(data, np.zeros(16, np.uint8))
        self.words = np.ndarray((len(self.data) - 8,), ">u8", self.data, strides=(1,))
        self.at = at

    def window(self) -> np.ndarray:
        """The next 57 bits or more, from the highest bit down."""
        if (self.at >> 3 >= len(self.words)).any():
            raise ValueError("a frame runs past the end of its stream")
        return self.words[self.at >> 3].astype(np.uint64) << (self.at & 7).astype(np.uint64)

    def read(self, width) -> np.ndarray:
        out = (self.window() >> np.uint64(1)) >> (63 - np.asarray(width)).astype(np.uint64)
        self.at = self.at + width
        return out.astype(np.int64)

    def signed(self, width: int) -> np.ndarray:
        value = self.read(width)
        return np.where(value >> (width - 1) & 1, value - (1 << width), value)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """A unary quotient, then k bits; the sign is the lowest bit of the code."""
        window = self.window()
        zeros = ZEROS16[window >> np.uint64(48)].astype(np.int64)
        if (zeros == 16).any():
            zeros = np.zeros(len(self.at), np.int64)
            start = self.at
            more = np.ones(len(start), bool)
            while more.any():
                self.at = start + zeros
                step = ZEROS16[self.window() >> np.uint64(48)].astype(np.int64)
                zeros = np.where(more, zeros + step, zeros)
                more &= step == 16
            self.at = start + zeros + 1
            low = self.read(k)
        else:
            low = ((window << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
            self.at = self.at + zeros + 1 + k
        code = zeros << k | low
        return (code >> 1) ^ -(code & 1)


def _numbers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frame numbers coded at the places, and their bytes."""
    lead = data[at].astype(np.int64)
    ones = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 99, 2, 3, 4, 5, 6], 7)
    value = np.where(ones == 1, lead, lead & (0x7F >> np.minimum(ones, 7)))
    for j in range(1, 7):
        byte = data[np.minimum(at + j, len(data) - 1)].astype(np.int64)
        value = np.where(j < ones, value << 6 | byte & 0x3F, value)
        ones = np.where((j < ones) & (byte >> 6 != 2), 99, ones)
    return value, ones


@dataclass
class Run:
    """Some frames of a stream: where they begin, their count of samples and the number of the first."""

    first: int
    total: int
    base: int


class Info:
    """What stands before a stream's frames: the first frame's place, block sizes, count of samples, digest and seek points."""

    base = 0

    def __init__(self, stream: bytes):
        if stream[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        here, last, info, self.points = 4, False, b"", []
        while not last:
            if here + 4 > len(stream):
                raise ValueError("the stream ends inside its metadata")
            last, kind, n = stream[here] >> 7, stream[here] & 0x7F, int.from_bytes(stream[here + 1 : here + 4], "big")
            if kind == 0:
                info = stream[here + 4 : here + 4 + n]
            elif kind == 3:
                found = struct.iter_unpack(">QQH", stream[here + 4 : here + 4 + n // 18 * 18])
                self.points = [(sample, at) for sample, at, _ in found if sample < 1 << 64 - 1]
            here += 4 + n
        if len(info) < 34:
            raise ValueError("a stream without its description")
        packed = int.from_bytes(info[10:18], "big")
        if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
            raise ValueError("only mono streams of 8-bit samples")
        self.first, self.total, self.digest = here, packed & (1 << 36) - 1, info[18:34]
        self.least, self.most = struct.unpack(">HH", info[:4])


def samples_of(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, after all checks."""
    infos = [Info(s) for s in streams]
    out = _in_step(streams, infos)
    for i, (s, info) in enumerate(zip(streams, infos)):
        if out[i] is None:
            out[i] = np.concatenate([np.empty(0, np.int8), *(x for _, x in frames(s, info))])
        if info.total and len(out[i]) != info.total:
            raise ValueError("samples are missing")
        if info.digest != bytes(16) and hashlib.md5(out[i].tobytes()).digest() != info.digest:
            raise ValueError("the stream's digest is wrong")
    return out


def _in_step(streams: list[bytes], infos: list[Info]) -> list[np.ndarray | None]:
    """The samples of all streams that this writer's heads divide without doubt, decoded together; None for the others."""
    out: list[np.ndarray | None] = [None] * len(streams)
    data = np.frombuffer(b"".join(streams), np.uint8)
    if len(data) < 8:
        return out
    bound = np.cumsum([len(s) for s in streams])
    first = bound - [len(s) - i.first for s, i in zip(streams, infos)]
    # Frames begin where the head's code stands, its checksum holds and the frame number is the next one.
    sign = np.flatnonzero((data[:-4] == HEAD[0]) & (data[1:-3] == HEAD[1]) & (data[2:-2] == HEAD[2]) & (data[3:-1] == HEAD[3]))
    owner = np.searchsorted(bound, sign, "right")
    keep = sign >= first[owner]
    sign, owner = sign[keep], owner[keep]
    number, width = _numbers(data, sign + 4)
    keep = (width < 9) & (sign + 4 + width < bound[owner])
    sign, owner, number, width = sign[keep], owner[keep], number[keep], width[keep]
    keep = crc8(data, sign, sign + 4 + width) == data[sign + 4 + width] if len(sign) else np.empty(0, bool)
    sign, owner, number, width = sign[keep], owner[keep], number[keep], width[keep]
    count = np.bincount(owner, minlength=len(streams))
    whole = np.array([i.total % BLOCK == 0 and i.total // BLOCK for i in infos])
    base = np.array([i.base for i in infos])
    right = number == np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count) + base[owner]
    fits = (count == whole) & (whole > 0) & (np.bincount(owner, right, len(streams)) == count)
    own = fits[owner]
    sign, owner, width = sign[own], owner[own], width[own]
    if not len(sign):
        return out
    end = np.append(sign[1:], 0)
    tails = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    end[tails] = bound[owner[tails]]
    wrong = crc16(data, sign, end - 2) != data[end - 2].astype(np.uint16) << 8 | data[end - 1]
    fits &= np.bincount(owner, wrong, len(streams)) == 0
    own = fits[owner]
    sign, owner, width, end = sign[own], owner[own], width[own], end[own]
    if not len(sign):
        return out
    try:
        found, after = _decoded(data, sign + 5 + width, BLOCK)
        if (after != end - 2).any():
            raise ValueError("a frame's length is wrong")
    except ValueError:  # one of them is not what it looks like; each is decoded by itself
        return out
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for a, b in zip(starts, [*starts[1:], len(owner)]):
        out[int(owner[a])] = found[a:b].astype(np.int8).ravel()
    return out


def _decoded(data: np.ndarray, body: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The samples of subframes (rows) that begin at the places `body`, and the places after them."""
    out = np.empty((len(body), block), np.int32)
    after = np.empty(len(body), np.int64)
    kind = data[body].astype(np.int64)
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        bits = _Bits(data, (body[rows] + 1) * 8)
        depth, wasted = 8, 0
        if k & 1:
            if len(rows) > 1:
                raise ValueError("frames with wasted bits are decoded one by one")
            wasted = 1
            while not bits.read(1)[0]:
                wasted += 1
                if wasted > 7:
                    raise ValueError("a sample without bits")
            depth -= wasted
        if k >> 1 == 0:
            out[rows] = bits.signed(depth)[:, None]
        elif k >> 1 == 1:
            if wasted:
                out[rows] = np.stack([bits.signed(depth) for _ in range(block)], 1)
            else:
                at = (body[rows] + 1)[:, None] + np.arange(block)
                if at[:, -1].max() >= len(data):
                    raise ValueError("a frame runs past the end of its stream")
                out[rows] = data[at].view(np.int8)
                bits.at = bits.at + 8 * block
        elif k & 0x40 or 0x10 <= k <= 0x19:
            _predicted(bits, int(k), rows, block, out, depth)
        else:
            raise ValueError("a subframe of unknown kind")
        if wasted:
            out[rows] <<= wasted
        after[rows] = (bits.at + 7) // 8
    return out, after


#: Fixed values of the format: block sizes by code.
SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


def frames(stream: bytes, info: Info, at: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first sample, samples) of each frame from the place `at` on, decoded one after another."""
    data, at, done = np.frombuffer(stream, np.uint8), info.first if at is None else at, None
    near = 1 << 16  # bytes that a frame is looked for in; a longer one widens them
    while at < len(stream):
        if at + 6 > len(stream) or stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
            raise ValueError("frames are missing, or a head is damaged")
        variable, size, rate, depth = stream[at + 1] & 1, stream[at + 2] >> 4, stream[at + 2] & 15, stream[at + 3] >> 1
        if stream[at + 3] >> 4 or depth & 7 not in (0, 1) or stream[at + 3] & 1:
            raise ValueError("only mono streams of 8-bit samples")
        number, width = _numbers(data, np.array([at + 4]))
        here = at + 4 + int(width[0])
        extra = {6: 1, 7: 2}.get(size, 0)
        block = int.from_bytes(stream[here : here + extra], "big") + 1 if extra else SIZES.get(size, 0)
        here += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if width[0] > 7 or not block or rate == 15 or here >= len(stream) or crc8(data, np.array([at]), np.array([here]))[0] != stream[here]:
            raise ValueError("frames are missing, or a head is damaged")
        first = int(number[0]) * (1 if variable else info.most)
        if done is not None and first != done or done is None and at == info.first and first:
            raise ValueError("a frame's number is not the next one")
        while True:
            try:
                samples, after = _decoded(data[here + 1 : here + 1 + near], np.array([0]), block)
                break
            except (ValueError, IndexError):
                if here + 1 + near >= len(stream):
                    raise
                near *= 4
        end = here + 1 + int(after[0])
        if end + 2 > len(stream) or crc16(data, np.array([at]), np.array([end]))[0] != int.from_bytes(stream[end : end + 2], "big"):
            raise ValueError("a frame's checksum is wrong")
        yield first, samples[0].astype(np.int8)
        at, done = end + 2, first + block


def samples_at(stream: bytes, first: int, n: int, info: Info | None = None) -> np.ndarray:
    """Samples first to first + n - 1 (fewer at the end). Only the frames between the seek points around them are read, all in step."""
    info = info or Info(stream)
    starts = [p[0] for p in info.points]
    if info.points and info.total and starts == sorted(starts) and starts[0] == 0:
        i, j = bisect.bisect_right(starts, first) - 1, bisect.bisect_left(starts, min(first + n, info.total))
        begin, at = info.points[i]
        last, end = info.points[j] if j < len(starts) else (info.total, len(stream) - info.first)
        if begin % BLOCK == 0 and at <= end:
            found = _in_step([stream[info.first + at : info.first + end]], [Run(0, last - begin, begin // BLOCK)])[0]
            if found is not None:
                return found[first - begin : first - begin + n]
    start = max((p for p in info.points if p[0] <= first), default=(0, 0))
    parts, at = [np.empty(0, np.int8)], None
    for at, own in frames(stream, info, info.first + start[1]):
        if at >= first + n:
            break
        parts.append(own[max(0, first - at) : first + n - at])
    return np.concatenate(parts)


def _predicted(bits: _Bits, kind: int, rows: np.ndarray, block: int, out: np.ndarray, depth: int) -> None:
    order = (kind >> 1 & 31) + 1 if kind & 0x40 else kind >> 1 & 7
    if order > block:
        raise ValueError("a predictor longer than its block")
    now = np.empty((block, len(rows)), np.int32)
    for i in range(order):
        now[i] = bits.signed(depth)
    if kind & 0x40:
        precision, shift = bits.read(4) + 1, bits.signed(5)
        if (precision == 16).any() or (shift < 0).any():
            raise ValueError("a predictor of unknown kind")
        weights = []
        for _ in range(order):
            value = bits.read(precision)
            weights.append(np.where(value >> (precision - 1) & 1, value - (1 << precision), value))
    else:
        weights, shift = [np.full(len(rows), c) for c in FIXED[order]], np.zeros(len(rows), np.int64)
    method, partitions = bits.read(2), bits.read(4)
    if (method > 1).any():
        raise ValueError("a residual of unknown kind")
    for m, p in {*zip(method.tolist(), partitions.tolist())}:
        own = (partitions == p) & (method == m)
        part = _Bits(bits.data[:-16], bits.at[own])
        length = block >> p
        if block % (1 << p) or length < order:
            raise ValueError("partitions that do not divide the block")
        escape = 31 if m else 15
        for i in range(order, block):
            if i % length == 0 or i == order:
                k = part.read(4 + m)
                raw = int(part.read(5)[0]) if (k == escape).any() and len(k) == 1 else None
                if (k == escape).any() and raw is None:
                    raise ValueError("frames with plain residuals are decoded one by one")
            now[i, own] = part.rice(k) if raw is None else part.signed(raw) if raw else 0
        bits.at[own] = part.at
    if order:
        for i in range(order, block):
            now[i] += (sum(w * now[i - 1 - j] for j, w in enumerate(weights)) >> shift).astype(np.int32)
    out[rows] = now.T


def payload_of(text: Column, block: int = BLOCK) -> Column:
    """The UTF-8 bytes of a text (null: empty), filled up with bytes 255 to a positive multiple of the block."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return F.rpad(raw, (F.ceil(F.greatest(F.octet_length(raw), F.lit(1)) / block) * block).cast("int"), F.lit(b"\xff"))


def _mapped(df: DataFrame, column: str, added: T.StructType, work) -> DataFrame:
    """`df` with columns that `work` makes of the non-null values of a binary column; null gives nulls."""
    keep = [c for c in df.columns if c not in added.names]
    schema = T.StructType([*[df.schema[c] for c in keep], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            for a, b in slices(values, SLICE):
                part = values.slice(a, b - a)
                made = iter(work([v for v in part.to_pylist() if v is not None]))
                rows = [next(made) if ok else (None,) * len(added) for ok in part.is_valid().to_pylist()]
                new = [pa.array(list(c), t) for c, t in zip(zip(*rows), (_ARROW[f.dataType.typeName()] for f in added))]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in keep], *new], names=schema.names)

    return df.mapInArrow(run, schema)


_ARROW = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}


def encode(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """`df` with a column of FLAC streams for its payloads of whole blocks."""
    return _mapped(df, payload, T.StructType([T.StructField(media, T.BinaryType())]), lambda p: ((s,) for s in streams_of(p)))


def feature_of(samples: np.ndarray) -> str:
    """Whole numbers only, so that equal samples have equal features on every machine."""
    wide = samples.astype(np.int64)
    crossings = int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())
    return f"n={len(wide)};peak={int(np.abs(wide).max(initial=0))};sum={int(wide.sum())};energy={int((wide * wide).sum())};crossings={crossings}"


def decode(df: DataFrame, media: str = "media", payload: str = "decoded", feature: str = "feature") -> DataFrame:
    """`df` with the payload bytes that its streams hold, verified, and a feature string of their samples."""
    added = T.StructType([T.StructField(payload, T.BinaryType()), T.StructField(feature, T.StringType())])

    def work(streams: list[bytes]) -> Iterator[tuple]:
        for s in samples_of(streams):
            yield (s.view(np.uint8) ^ 0x80).tobytes(), feature_of(s)

    return _mapped(df, media, added, work)


def pcm_blocks(df: DataFrame, media: str = "media", blocks: int = SEEK) -> DataFrame:
    """One row per run of `blocks` * 576 samples: the other columns, `sample_offset`, `n_samples` and `pcm` (unsigned 8-bit, as in the payload).

    A stream is read PCM_RUNS runs at a time, from the seek point before them to the one behind, so its length bounds nothing but the number of
    rows. Null media gives no rows.
    """
    size = blocks * BLOCK
    rest = [c for c in df.columns if c != media]
    added = T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("pcm", T.BinaryType())])
    schema = T.StructType([*[df.schema[c] for c in rest], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(media))
            for i in range(len(batch)):
                stream = column[i].as_py()
                if stream is None:
                    continue
                info, other = Info(stream), [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in rest]
                for begin in range(0, info.total, size * PCM_RUNS):
                    bytes_ = (samples_at(stream, begin, size * PCM_RUNS, info).view(np.uint8) ^ 0x80).tobytes()
                    runs = [bytes_[k : k + size] for k in range(0, len(bytes_), size)]
                    same = [pa.concat_arrays([c] * len(runs)) for c in other]
                    offsets = begin + size * np.arange(len(runs))
                    yield pa.RecordBatch.from_arrays([*same, pa.array(offsets), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, pa.binary())], names=schema.names)

    return df.select(*rest, media).mapInArrow(run, schema)


def media_digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: sizes and digests of the payload as read back and of the stream that holds it, and the feature. The streams are written to the shared folder."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), payload_of(F.col(text)).alias("payload"))
    stored, folder = encode(own).drop("payload"), f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    stored.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(folder)
    read = decode(spark.read.schema(stored.schema).parquet(folder))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("decoded").cast("long").alias("payload_bytes"), F.sha2("decoded", 256).alias("payload_sha256"), F.crc32(F.expr("substring(decoded, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
