"""Media columns: FLAC.

Payload bytes become 8-bit samples of a FLAC stream (STREAMINFO with MD5, a seek point for each frame, fixed and linear predictors, Rice residuals, CRC-8 and
CRC-16). Frequent bytes get the samples nearest to zero by a fixed table, so that Rice codes of text are short. Frames of many rows are coded side by side: one numpy step
handles the same sample of all of them, FRAMES of them at a time, whatever the length of a row. Decoding checks every checksum and gives PCM blocks with their sample offsets.
Streams of other encoders (no seek table, several channels, up to 32 bits, wasted bits, escape-coded partitions) are read frame after frame by decode_stream().
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, stage_table, text_or_empty

BLOCK, UNIT, RATE_HZ = 1024, 64, 8000
LPC_ORDER, PRECISION = 8, 12
#: Samples of a PCM block in the decoded table.
PCM_BLOCK = 16 * BLOCK
SLICE_BYTES = 2_000_000
#: Frames that are in memory as numbers at once.
FRAMES = 2048
#: Bytes in the order of their samples 0, -1, 1, -2, 2, ...; those not named follow in ascending order.
FREQUENT = b" etaoinrshdlucmgpfbwyv.,\xc3k'\n\x00-0123456789TSIADCELMNPBRWFHGOVUJKYjxqz\xa9\xb3\xbc\xa4\xb6\"!?:;()"
POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])


def sample_tables() -> tuple[np.ndarray, np.ndarray]:
    """The sample of each byte, and the byte of each sample as an unsigned byte."""
    order = np.frombuffer(FREQUENT + bytes(b for b in range(256) if b not in FREQUENT), np.uint8)
    value = np.where(np.arange(256) % 2, -(np.arange(256) + 1) // 2, np.arange(256) // 2)
    sample, byte = np.zeros(256, np.int64), np.zeros(256, np.uint8)
    sample[order] = value
    byte[value & 255] = order
    return sample, byte


SAMPLE, BYTE = sample_tables()


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1
        out[b] = c & ((1 << bits) - 1)
    return out


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the ranges of flat, all at once."""
    order = np.argsort(-sizes, kind="stable")
    s, n = starts[order], sizes[order]
    c = np.zeros(len(s), np.uint32)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for j, m in enumerate(live):
        a = c[:m]
        c[:m] = ((a << 8) & 0xFFFF) ^ CRC16[(a >> 8) ^ flat[s[:m] + j]]
    out = np.empty_like(c)
    out[order] = c
    return out


@lru_cache(maxsize=100_000)
def frame_header(number: int, size: int) -> bytes:
    """Fixed block size, size - 1 in 16 bits, rate from STREAMINFO, one channel, 8 bits; the number coded as in UTF-8."""
    if number < 0x80:
        code = bytes([number])
    else:
        tail, left = [], number
        while left >= 1 << (6 - len(tail)):
            tail.append(0x80 | left & 0x3F)
            left >>= 6
        code = bytes([(0xFF << (7 - len(tail)) & 0xFF) | left, *reversed(tail)])
    head = b"\xff\xf8\x70\x02" + code + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def linear_predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized coefficients (frames x LPC_ORDER) and shifts, by autocorrelation and Levinson-Durbin."""
    f, n = x.shape
    y = x.astype(np.float64) * np.sin(np.pi * (np.arange(n) + 0.5) / n)
    auto = np.stack([np.einsum("ij,ij->i", y[:, : n - k], y[:, k:]) for k in range(LPC_ORDER + 1)], 1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-6
    a, err = np.zeros((f, LPC_ORDER)), auto[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (auto[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], auto[:, i:0:-1])) / err
        before = a[:, :i].copy()
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        a[:, i] = k
        err *= np.maximum(1 - k * k, 1e-12)
    top = np.ceil(np.log2(np.maximum(np.abs(a).max(1), 1e-9) + 1e-12))
    shift = np.clip(PRECISION - 1 - top, 0, 15).astype(np.int64)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int64), shift


def residuals(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    out = [(0, x, None, None), (1, np.diff(x, axis=1), None, None), (2, np.diff(x, 2, axis=1), None, None)]
    q, shift = linear_predictor(x)
    n = x.shape[1]
    told = np.zeros((len(x), n - LPC_ORDER), np.int64)
    for j in range(LPC_ORDER):
        told += q[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    return [*out, (LPC_ORDER + 100, x[:, LPC_ORDER:] - (told >> shift[:, None]), q, shift)]


def encode_frames(x: np.ndarray) -> list[bytes]:
    """The subframes, padded to whole bytes, of frames of one size; x: frames x size."""
    f, n = x.shape
    tries = residuals(x)
    means = np.stack([zigzag(r).mean(1) + 0.02 * (kind >= 100) * PRECISION for kind, r, _, _ in tries], 1)
    k_all = np.maximum(0, np.floor(np.log2(means + 1)))
    cost = np.stack([(1 + k_all[:, i] + means[:, i] / 2 ** k_all[:, i]) * r.shape[1] + 8 * (n - r.shape[1]) + (9 + LPC_ORDER * PRECISION if kind >= 100 else 0) for i, (kind, r, _, _) in enumerate(tries)], 1)
    best = cost.argmin(1)
    out: list[bytes] = [b""] * f
    flat = (x == x[:, :1]).all(1)
    for d in np.flatnonzero(flat):
        out[d] = bytes([0, int(x[d, 0]) & 255])
    for i, (kind, r, q, shift) in enumerate(tries):
        own = np.flatnonzero((best == i) & ~flat)
        if not len(own):
            continue
        u, order = zigzag(r[own]), kind % 100
        trial = np.clip(k_all[own, i][:, None] + np.array([-1, 0, 1]), 0, 14).astype(np.int64)
        exact = np.stack([(u >> trial[:, j : j + 1]).sum(1) + u.shape[1] * (1 + trial[:, j]) for j in range(3)], 1)
        k = trial[np.arange(len(own)), exact.argmin(1)]
        fields = [(np.full(len(own), (0x20 | order - 1) << 1 if kind >= 100 else (8 | order) << 1), 8)]
        fields += [(x[own, j] & 255, 8) for j in range(order)]
        if kind >= 100:
            fields += [(np.full(len(own), PRECISION - 1), 4), (shift[own], 5)] + [(q[own, j] & ((1 << PRECISION) - 1), PRECISION) for j in range(order)]
        fields += [(np.zeros(len(own), np.int64), 6), (k, 4)]
        head = sum(w for _, w in fields)
        quotient = u >> k[:, None]
        ends = np.cumsum(quotient + 1 + k[:, None], axis=1)
        sizes = (head + ends[:, -1] + 7) // 8
        base = (np.cumsum(sizes) - sizes) * 8
        bits = np.zeros(int(sizes.sum()) * 8, np.uint8)
        at = base.copy()
        for value, width in fields:
            for j in range(width):
                bits[at + j] = (value >> (width - 1 - j)) & 1
            at += width
        last = (base + head)[:, None] + ends
        bits[last - 1 - k[:, None]] = 1
        for j in range(int(k.max())):
            wide = k > j
            rows = slice(None) if wide.all() else wide
            bits[last[rows] - 1 - j] = (u[rows] >> j) & 1
        packed = np.packbits(bits).tobytes()
        stop = np.cumsum(sizes)
        for d, a, b in zip(own, stop - sizes, stop, strict=True):
            out[d] = packed[a:b]
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose size is a positive multiple of UNIT."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    first = np.cumsum(sizes) - sizes
    number = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(payloads)), number)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    begin, n = first[doc] + k * BLOCK, np.minimum(BLOCK, sizes[doc] - k * BLOCK)
    frames: list[bytes] = [b""] * len(doc)
    for at in range(0, len(doc), FRAMES):
        for size in np.unique(n[at : at + FRAMES]):
            own = at + np.flatnonzero(n[at : at + FRAMES] == size)
            for d, body in zip(own, encode_frames(SAMPLE[flat[begin[own, None] + np.arange(size)]]), strict=True):
                frames[d] = frame_header(int(k[d]), int(size)) + body
    lengths = np.array([len(x) for x in frames])
    joined = np.frombuffer(b"".join(frames), np.uint8)
    sums = crc16(joined, np.cumsum(lengths) - lengths, lengths)
    frames = [x + int(c).to_bytes(2, "big") for x, c in zip(frames, sums, strict=True)]
    lengths = lengths + 2
    out, at = [], 0
    for p, m in zip(payloads, number, strict=True):
        own, size = frames[at : at + m], lengths[at : at + m]
        points = np.zeros(m, POINT)
        points["sample"], points["offset"], points["n"] = np.arange(m) * BLOCK, np.cumsum(size) - size, n[at : at + m]
        signed = SAMPLE.astype(np.int8)[np.frombuffer(p, np.uint8)].tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
        info += ((RATE_HZ << 44) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek = points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
        at += m
    return out


class Bits:
    """Big-endian bit reading at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        wide = np.zeros(len(padded) - 7, np.uint64)
        for j in range(8):
            wide = (wide << np.uint64(8)) | padded[j : j + len(wide)]
        self.wide = wide

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 32 bits at each bit position."""
        return ((self.wide[at >> 3] >> (32 - (at & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def read(self, at: np.ndarray, width: int) -> np.ndarray:
        return self.window(at) >> (32 - width)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned codes and the positions behind them."""
        w = self.window(at)
        zeros = 32 - np.frexp(w.astype(np.float64))[1]
        if zeros.max() + 1 + k.max() <= 32:
            low = (w >> (31 - zeros - k)) & ((1 << k) - 1)
            return (zeros << k) | low, at + zeros + 1 + k
        quotient, at = zeros.astype(np.int64), at + zeros
        while len(long := np.flatnonzero(w == 0)):
            w[long] = self.window(at[long])
            more = 32 - np.frexp(w[long].astype(np.float64))[1]
            quotient[long] += more
            at = at.copy()
            at[long] += more
        low = np.where(k > 0, self.window(at + 1) >> (32 - np.maximum(k, 1)), 0)
        return (quotient << k) | low, at + 1 + k


def signed(v: np.ndarray, width: int) -> np.ndarray:
    return v - ((v >> (width - 1)) << width)


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def decode_group(bits: Bits, at: np.ndarray, n: np.ndarray, order: int, linear: bool) -> np.ndarray:
    """Samples x frames of subframes of one predictor order; n falls; at is behind the subframe header."""
    f, longest = len(at), int(n[0])
    s = np.zeros((longest, f), np.int64)
    for j in range(order):
        s[j] = signed(bits.read(at, 8), 8)
        at = at + 8
    if linear:
        precision, shift = bits.read(at, 4) + 1, bits.read(at + 4, 5)
        at = at + 9
        q = []
        for _ in range(order):
            v = bits.window(at) >> (32 - precision)
            q.append(v - ((v >> (precision - 1)) << precision))
            at = at + precision
    else:
        q, shift = [np.full(f, c) for c in FIXED[order]], np.zeros(f, np.int64)
    method, split = bits.read(at, 2), bits.read(at + 2, 4)
    width = np.where(method == 1, 5, 4)
    at, part = at + 6, n >> split
    if (method > 1).any():
        raise ValueError("an unknown residual coding")
    k, plain = np.zeros(f, np.int64), not split.any()
    live = np.searchsorted(-n, -np.arange(longest), side="left")
    for t in range(order, longest):
        m = live[t]
        if t == order or not plain:
            new = np.ones(m, bool) if t == order else t % part[:m] == 0
            if new.any():
                k[:m][new] = bits.window(at[:m][new]) >> (32 - width[:m][new])
                at[:m][new] += width[:m][new]
                if (k[:m] == (1 << width[:m]) - 1).any():
                    raise ValueError("escape-coded partitions aren't supported")
        u, at[:m] = bits.rice(at[:m], k[:m])
        r = (u >> 1) ^ -(u & 1)
        if order:
            told = q[0][:m] * s[t - 1, :m]
            for j in range(1, order):
                told = told + q[j][:m] * s[t - 1 - j, :m]
            r = r + (told >> shift[:m])
        s[t, :m] = r
    return s


def decode_frames(data: np.ndarray, begin: np.ndarray, ends: np.ndarray, n: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The samples, as unsigned bytes, of frames data[begin:ends] with n samples each; headers and CRC-16 are verified."""
    sums = crc16(data, begin, ends - begin - 2)
    if (sums != (data[ends - 2].astype(np.uint32) << 8 | data[ends - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    joined = data.tobytes()
    heads = np.empty(len(begin), np.int64)
    for j, (b, k, size) in enumerate(zip(begin.tolist(), number.tolist(), n.tolist(), strict=True)):
        head = frame_header(k, size)
        if not joined.startswith(head, b):
            raise ValueError("a frame header or its CRC-8 is wrong")
        heads[j] = len(head)
    bits, at = Bits(data), (begin + heads) * 8
    kind = (data[begin + heads] >> 1).astype(np.int64)
    where = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for value in np.unique(kind):
        own = np.flatnonzero(kind == value)
        own = own[np.argsort(-n[own], kind="stable")]
        if value in (0, 1):
            for d in own:
                p = begin[d] + heads[d] + 1
                out[where[d] : where[d] + n[d]] = data[p : p + (1 if value == 0 else n[d])]
        elif 8 <= value <= 12 or value >= 32:
            linear = value >= 32
            s = decode_group(bits, at[own] + 8, n[own], int(value - 31 if linear else value - 8), linear)
            steps = np.arange(s.shape[0])
            for size in np.unique(n[own]):
                same = np.flatnonzero(n[own] == size)
                out[where[own[same]][:, None] + steps[:size]] = s[:size, same].T & 255
        else:
            raise ValueError("a reserved subframe type")
    return out


def metadata(raw: bytes) -> tuple[bytes, np.ndarray, int]:
    """STREAMINFO, seek points and where the frames begin."""
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", np.zeros(0, POINT)
    while not last:
        if at + 4 > len(raw):
            raise ValueError("the metadata doesn't end")
        kind, size = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big")
        body, last, at = raw[at + 4 : at + 4 + size], kind >= 0x80, at + 4 + size
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points = np.frombuffer(body, POINT)
    return info, points, at


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream of encode(). Header, frame and stream checksums are verified; a wrong one raises ValueError."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    base, begin, n, ends, number, owner, infos = 0, [], [], [], [], [], []
    for d, raw in enumerate(streams):
        info, points, at = metadata(raw)
        infos.append((int.from_bytes(info[10:18], "big") & ((1 << 36) - 1), info[18:34]))
        offset = points["offset"].astype(np.int64)
        begin.append(base + at + offset)
        ends.append(base + at + np.append(offset[1:], len(raw) - at) if len(offset) else offset)
        n.append(points["n"].astype(np.int64))
        number.append(np.arange(len(points)))
        owner.append(np.full(len(points), d))
        base += len(raw)
    begin, ends, n, number, owner = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (begin, ends, n, number, owner))
    parts = [np.zeros(0, np.uint8)]
    for k in range(0, len(begin), FRAMES):
        own = slice(k, k + FRAMES)
        low = begin[k]
        parts.append(decode_frames(data[low : ends[own][-1]], begin[own] - low, ends[own] - low, n[own], number[own]))
    samples = np.concatenate(parts)
    total = np.bincount(owner, n, len(streams)).astype(np.int64) if len(n) else np.zeros(len(streams), np.int64)
    payloads = []
    for (size, md5), a, b in zip(infos, np.cumsum(total) - total, np.cumsum(total), strict=True):
        raw = samples[a:b]
        if size != b - a or hashlib.md5(raw.tobytes()).digest() != md5:
            raise ValueError("the samples aren't those of STREAMINFO")
        payloads.append(BYTE[raw].tobytes())
    return payloads


class Reader:
    """Bits of one stream, one number after the other."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at * 8

    def read(self, width: int) -> int:
        if not width:
            return 0
        first, last = self.at >> 3, (self.at + width + 7) >> 3
        if last > len(self.raw):
            raise ValueError("the stream ends inside a frame")
        self.at += width
        return (int.from_bytes(self.raw[first:last], "big") >> (last * 8 - self.at)) & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        v = self.read(width)
        return v - (1 << width) if width and v >> (width - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def subframe(r: Reader, size: int, bits: int) -> np.ndarray:
    if r.read(1):
        raise ValueError("a subframe's padding isn't zero")
    kind = r.read(6)
    wasted = r.unary() + 1 if r.read(1) else 0
    bits -= wasted
    if kind == 0:
        out = [r.signed(bits)] * size
    elif kind == 1:
        out = [r.signed(bits) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        out = [r.signed(bits) for _ in range(order)]
        if kind >= 32:
            precision, shift = r.read(4) + 1, r.signed(5)
            told = [r.signed(precision) for _ in range(order)]
        else:
            told, shift = FIXED[order], 0
        method, split = r.read(2), r.read(4)
        if method > 1:
            raise ValueError("an unknown residual coding")
        width = 4 + method
        for part in range(1 << split):
            k = r.read(width)
            plain = r.read(5) if k == (1 << width) - 1 else None
            for _ in range((size >> split) - (order if part == 0 else 0)):
                if plain is None:
                    u = r.unary() << k
                    u |= r.read(k)
                    v = (u >> 1) ^ -(u & 1)
                else:
                    v = r.signed(plain)
                out.append(v + (sum(c * x for c, x in zip(told, reversed(out[-order:]), strict=True)) >> shift if order else 0))
    else:
        raise ValueError("a reserved subframe type")
    return np.array(out, np.int64) << wasted


def decode_stream(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (frames x channels), rate and bits of a FLAC stream of any encoder, found by sync codes; seek tables aren't needed. CRC-8, CRC-16, sizes and the MD5 (where there is one) are verified."""
    info, _, at = metadata(raw)
    word = int.from_bytes(info[10:18], "big")
    rate, bits, total = word >> 44, ((word >> 36) & 31) + 1, word & ((1 << 36) - 1)
    data, blocks = np.frombuffer(raw, np.uint8), []
    while at < len(raw):
        r = Reader(raw, at)
        if r.read(14) != 0x3FFE or r.read(1):
            raise ValueError("no frame where one should begin")
        r.read(1)
        code, rates, way, depth = r.read(4), r.read(4), r.read(4), r.read(3)
        r.read(1)
        lead = r.read(8)
        for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length()) if lead >= 0x80 else 0):
            r.read(8)
        if lead >= 0xC0:
            r.at -= 8  # of the leading ones the first isn't a continuation byte
        size = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else r.read(8) + 1 if code == 6 else r.read(16) + 1 if code == 7 else 256 << (code - 8)
        if rates in (12, 13, 14):
            r.read(8 if rates == 12 else 16)
        head = r.at >> 3
        if r.read(8) != crc8(raw[at:head]):
            raise ValueError("a frame header's CRC-8 is wrong")
        own = bits if depth == 0 else (0, 8, 12, 0, 16, 20, 24, 32)[depth]
        channels = way + 1 if way < 8 else 2
        parts = [subframe(r, size, own + (way == 8 and c == 1 or way == 9 and c == 0 or way == 10 and c == 1)) for c in range(channels)]
        if way == 8:
            parts[1] = parts[0] - parts[1]
        elif way == 9:
            parts[0] = parts[0] + parts[1]
        elif way == 10:
            middle = parts[0] * 2 + (parts[1] & 1)
            parts = [(middle + parts[1]) >> 1, (middle - parts[1]) >> 1]
        end = (r.at + 7) >> 3
        if int(crc16(data, np.array([at]), np.array([end - at]))[0]) != int.from_bytes(raw[end : end + 2], "big"):
            raise ValueError("a frame's CRC-16 is wrong")
        blocks.append(np.stack(parts, 1))
        at = end + 2
    samples = np.concatenate([*blocks, np.zeros((0, blocks[0].shape[1] if blocks else 1), np.int64)])
    wide = (bits + 7) // 8
    told = samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :wide].tobytes()
    if total and total != len(samples) or any(info[18:34]) and hashlib.md5(told).digest() != info[18:34]:
        raise ValueError("the samples aren't those of STREAMINFO")
    return samples, rate, bits


def padded(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def features(payload: bytes) -> str:
    """Of the payload as samples of offset 128: count, sum, sum of squares, zero crossings, largest step between neighbours."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};step={int(np.abs(np.diff(x)).max())}"


def byte_slices(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows with about SLICE_BYTES in a column; a longer one by itself."""
    first, held = 0, 0
    for j, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
        held += n
        if held >= SLICE_BYTES or j == b.num_rows - 1:
            yield b.slice(first, j + 1 - first)
            first, held = j + 1, 0


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, with zeros up to a positive multiple of UNIT, as a FLAC stream.

    A null text is empty, a null id stays null, repeated rows each get a stream, equal texts equal ones; extra columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, "_t"):
                texts = part.column("_t").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(encode([padded(x) for x in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])
        give_back()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


PCM = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sample_offsets array<long>, pcm array<binary>"


def decode_column(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> the columns of PCM: checksums of the payload and of the stored stream, features, and PCM blocks of PCM_BLOCK bytes with the sample each begins with.

    A row for each row; a null stream raises, as every broken one does; an empty table gives an empty table.
    """
    names = [x.split()[0] for x in PCM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, "media"):
                streams = part.column("media").to_pylist()
                raw = decode(streams)
                cuts = [range(0, len(p), PCM_BLOCK) for p in raw]
                made = [pa.array(list(map(len, raw)), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in raw], pa.string()), pa.array([zlib.crc32(p[-UNIT:]) for p in raw], pa.int64())]
                made += [pa.array(list(map(len, streams)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in streams], pa.string()), pa.array(list(map(features, raw)), pa.string())]
                made += [pa.array([list(c) for c in cuts], pa.list_(pa.int64())), pa.array([[p[i : i + PCM_BLOCK] for i in c] for p, c in zip(raw, cuts, strict=True)], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *made], names=names)
        give_back()

    bounded_batches(media.sparkSession)
    return media.mapInArrow(run, PCM)


def read_samples(table: DataFrame, begin: int, end: int) -> DataFrame:
    """``doc_id, payload``: bytes begin to end of each row, from those PCM blocks alone that hold them."""
    wanted = F.filter(F.arrays_zip("sample_offsets", "pcm"), lambda x: (x["sample_offsets"] < end) & (x["sample_offsets"] + PCM_BLOCK > begin))
    joined = F.aggregate(wanted, F.lit(b""), lambda acc, x: F.concat(acc, x["pcm"]))
    skip = begin - begin // PCM_BLOCK * PCM_BLOCK
    return table.select("doc_id", F.substring(joined, F.lit(skip + 1), F.lit(end - begin)).alias("payload"))


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Write the texts as a media column of FLAC streams, read it back, and decode what was read into PCM blocks, their checksums and features; rules for nulls and the like as in encode_column()."""
    return decode_column(stage_table(encode_column(docs), "media"))
