"""FLAC media columns: lossless 8-bit mono streams, encoded and decoded with NumPy.

A payload's bytes are samples through a fixed table: the commoner a byte is in text,
the nearer its level is to zero, so that Rice codes of texts are short.  The encoder cuts them into blocks of
1,024 and keeps for each block the cheapest of constant, verbatim, fixed predictors
of order 0 to 2 and a quantised linear predictor of order 4, with Rice-coded
residuals.  A seek table has one point for each frame.

The decoder works on all frames of many streams at once, a frame to a lane: it
checks the header's CRC-8 and the frame's CRC-16, reads Rice codes (partitions and
escapes included) and undoes the predictor sample by sample, and checks the stream's
MD5.  Frames are found by the seek table, or, if that isn't complete, by sync codes
with a right CRC-8 and the next frame number.  `pcm_blocks` gives the samples as
rows with sample offsets.

Defined cases.  Null or empty text: 64 zero bytes.  Repeated rows give equal media.
A null doc_id is kept.  Null media, or what isn't a mono stream of 4 to 16 bits with
fixed block size, decodes to null samples; a stream with a wrong checksum to what
was read, with intact false.  Very long texts are streams of many frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, slices, table

BLOCK = 1024
RATE = 8000
LPC_ORDER, PRECISION, SHIFT = 4, 12, 9
SLICE = 2 << 20
# Fixed: bytes that texts are mostly made of, the commonest first; all others follow in order.
COMMON = b" etaoinsrhldcumfpgwybvkxjqz.,\n"
_RANKED = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)], dtype=np.uint8)
_RANK = np.argsort(_RANKED)
LEVEL = np.where(_RANK % 2, -(_RANK + 1) // 2, _RANK // 2).astype(np.int8)  # of a byte: 0, -1, 1, -2, ..
_BYTE = np.zeros(256, dtype=np.uint8)  # of a level, by its two's complement
_BYTE[LEVEL.view(np.uint8)] = np.arange(256)


def _table(poly: int, width: int) -> np.ndarray:
    out = []
    for v in range(256):
        r = v << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r >> (width - 1) & 1 else r << 1) & ((1 << width) - 1)
        out.append(r)
    return np.array(out, dtype=np.uint16)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()
_CLZ16 = np.array([16 - v.bit_length() for v in range(1 << 16)], dtype=np.int64)


def crc8(data: bytes) -> int:
    r = 0
    for b in data:
        r = _CRC8_LIST[r ^ b]
    return r


def crc16_lanes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, all ranges at once."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].astype(np.int64), lengths[order]
    crc = np.zeros(len(order), dtype=np.uint16)
    live = len(order)
    for i in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)) ^ data[at[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    parts = []
    while n >= 1 << (6 - len(parts)):
        parts.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> (len(parts) + 1)) & 0xFF | n, *reversed(parts)])


def read_number(data: bytes, at: int) -> tuple[int, int]:
    """(number, next position); -1 if it isn't one."""
    first = data[at] if at < len(data) else 0xFF
    if first < 0x80:
        return first, at + 1
    more = 8 - (first ^ 0xFF).bit_length() - 1
    if not 1 <= more <= 6 or at + more >= len(data):
        return -1, at
    n = first & (0x3F >> more)
    for b in data[at + 1 : at + 1 + more]:
        if b >> 6 != 2:
            return -1, at
        n = n << 6 | b & 0x3F
    return n, at + 1 + more


def _lpc(blocks: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each block, by Levinson's recursion."""
    x = blocks.astype(np.float64)
    r = np.stack([(x[:, : x.shape[1] - k] * x[:, k:]).sum(axis=1) for k in range(LPC_ORDER + 1)], axis=1)
    err = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top - 1, top).astype(np.int64)


def _residuals(blocks: np.ndarray, kind: int, coefficients: np.ndarray) -> np.ndarray:
    """Of a fixed predictor of order 0 to 2, or (3) of the linear one; warm-up
    samples count as residuals here and are left out later."""
    if kind == 0:
        return blocks
    out = blocks.copy()
    if kind == 1:
        out[:, 1:] -= blocks[:, :-1]
    elif kind == 2:
        out[:, 2:] -= 2 * blocks[:, 1:-1] - blocks[:, :-2]
    else:
        n = blocks.shape[1]
        guess = np.zeros((len(blocks), n - LPC_ORDER), dtype=np.int32)
        for j in range(LPC_ORDER):
            guess += coefficients[:, j : j + 1].astype(np.int32) * blocks[:, LPC_ORDER - 1 - j : n - 1 - j]
        out[:, LPC_ORDER:] -= guess >> SHIFT
    return out


def _zigzag(e: np.ndarray) -> np.ndarray:
    return ((e << 1) ^ (e >> 31)).astype(np.uint32)


ORDERS = (0, 1, 2, LPC_ORDER)


def encode_blocks(blocks: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of blocks of one size: blocks is [frame, sample], int32."""
    count, n = blocks.shape
    lpc = _lpc(blocks) if n > LPC_ORDER else np.zeros((count, LPC_ORDER), dtype=np.int64)
    best = np.full(count, 8 * n, dtype=np.int64)
    kind = np.full(count, -1)
    param = np.zeros(count, dtype=np.int64)
    chosen = np.zeros((count, n), dtype=np.uint32)
    for c, order in enumerate(ORDERS):
        if n <= order:
            continue
        u = _zigzag(_residuals(blocks, c, lpc))
        u[:, :order] = 0
        guess = np.log2(u.sum(axis=1, dtype=np.int64) / (n - order) + 1e-9) - 0.5
        base = np.clip(np.floor(guess), 0, 13).astype(np.int64)
        fixed = 8 * order + (PRECISION * order + 9 if c == 3 else 0) + 10
        for more in (0, 1):
            k = base + more
            cost = (u >> k[:, None].astype(np.uint32)).sum(axis=1, dtype=np.int64) + (n - order) * (1 + k) + fixed
            better = cost < best
            best[better], kind[better], param[better] = cost[better], c, k[better]
        now = kind == c
        chosen[now] = u[now]
    same = (blocks == blocks[:, :1]).all(axis=1)
    kind[same] = -2

    prefixes: list[tuple[int, int]] = []  # bits and how many
    code = {1024: (0b1010, b""), 256: (0b1000, b""), 512: (0b1001, b"")}.get(n) or ((0b0110, bytes([n - 1])) if n <= 256 else (0b0111, struct.pack(">H", n - 1)))
    first = blocks[:, :LPC_ORDER].tolist()
    for number, which, k, samples, taps in zip(numbers, kind.tolist(), param.tolist(), first, lpc.tolist(), strict=True):
        head = b"\xff\xf8" + bytes([code[0] << 4, 0b0000_001_0]) + coded_number(number) + code[1]
        head += bytes([crc8(head)])
        bits, size = int.from_bytes(head, "big"), 8 * len(head)

        def put(value: int, width: int) -> None:
            nonlocal bits, size
            bits, size = bits << width | value & ((1 << width) - 1), size + width

        put({-2: 0, -1: 1, 0: 8, 1: 9, 2: 10, 3: 32 + LPC_ORDER - 1}[which] << 1, 8)
        if which == -2:
            put(samples[0], 8)
        elif which >= 0:
            for s in samples[: ORDERS[which]]:
                put(s, 8)
            if which == 3:
                put(PRECISION - 1, 4)
                put(SHIFT, 5)
                for t in taps:
                    put(t, PRECISION)
            put(k, 10)  # Rice codes of 4-bit parameters, one partition
        prefixes.append((bits, size))

    sizes = np.array([s for _, s in prefixes], dtype=np.int64)
    rice, raw = kind >= 0, kind == -1
    body = np.where(raw, 8 * n, 0)
    order_of = np.array(ORDERS)[np.maximum(kind, 0)]
    q = np.zeros((count, n), dtype=np.int64)
    if rice.any():
        q[rice] = (chosen[rice] >> param[rice, None].astype(np.uint32)) + 1 + param[rice, None]
        q[rice[:, None] & (np.arange(n) < order_of[:, None])] = 0
        body = body + q.sum(axis=1)
    lengths = (sizes + body + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    bits = np.zeros(8 * int(starts[-1]), dtype=np.uint8)
    for (value, size), at in zip(prefixes, (8 * starts[:-1]).tolist(), strict=True):
        data = (value << (-size % 8)).to_bytes((size + 7) // 8, "big")
        bits[at : at + size] = np.unpackbits(np.frombuffer(data, np.uint8))[:size]
    if raw.any():
        each = np.unpackbits((blocks[raw] & 255).astype(np.uint8), axis=1)
        at = (8 * starts[:-1] + sizes)[raw]
        bits[at[:, None] + np.arange(8 * n)] = each
    if rice.any():
        end = ((8 * starts[:-1] + sizes)[rice, None] + np.cumsum(q[rice], axis=1)).ravel()
        k = np.repeat(param[rice], n)
        u = chosen[rice].ravel()
        coded = (np.arange(n)[None, :] >= order_of[rice, None]).ravel()
        end, k, u = end[coded], k[coded], u[coded]
        bits[end - k - 1] = 1
        for j in range(int(k.max())):
            some = k > j
            bits[end[some] - 1 - j] = u[some] >> np.uint32(j) & np.uint32(1)
    data = np.packbits(bits)
    crc = crc16_lanes(data, starts[:-1], lengths - 2)
    data[starts[1:] - 2], data[starts[1:] - 1] = crc >> 8, crc & 255
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; blocks of all payloads are coded together."""
    frames: list[dict[int, bytes]] = [{} for _ in payloads]
    groups: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for b in range(-(-len(p) // BLOCK)):
            groups.setdefault(min(BLOCK, len(p) - b * BLOCK), []).append((i, b))
    for n, members in groups.items():
        raw = b"".join(payloads[i][b * BLOCK : b * BLOCK + n] for i, b in members)
        blocks = LEVEL[np.frombuffer(raw, np.uint8)].reshape(len(members), n).astype(np.int32)
        for (i, b), frame in zip(members, encode_blocks(blocks, [b for _, b in members]), strict=True):
            frames[i][b] = frame
    out = []
    for p, mine in zip(payloads, frames, strict=True):
        parts = [mine[b] for b in range(len(mine))]
        sizes = [len(x) for x in parts] or [0]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        info += hashlib.md5(LEVEL[np.frombuffer(p, np.uint8)].tobytes()).digest()
        at, points = 0, []
        for b, x in enumerate(parts):
            points.append(struct.pack(">QQH", b * BLOCK, at, min(BLOCK, len(p) - b * BLOCK)))
            at += len(x)
        seek = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(parts))
    return out


@dataclass
class Stream:
    """What a decoder knows of a stream before it reads samples."""

    bits: int
    total: int
    block: int
    md5: bytes
    frames: list[tuple[int, int]]  # byte range of each frame


def opened(data: bytes) -> Stream | None:
    """Metadata and frame places, or None for what isn't supported."""
    if data[:4] != b"fLaC":
        return None
    at, info, points, last = 4, None, [], False
    while not last and at + 4 <= len(data):
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        last, body = bool(data[at] & 0x80), data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and size == 34:
            info = body
        elif kind == 3:
            points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size - 17, 18)]
    if info is None:
        return None
    block, packed = struct.unpack(">H", info[2:4])[0], int.from_bytes(info[10:18], "big")
    channels, bits, total = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    if channels != 1 or not 4 <= bits <= 16 or info[:2] != info[2:4] or not block:
        return None
    want = -(-total // block)
    points = [p for p in points if p[0] != 2**64 - 1]
    if [p[0] for p in points] == [i * block for i in range(want)]:
        starts = [at + p[1] for p in points]
    else:  # no complete seek table: sync codes, header checks and frame numbers
        starts, look = [], at
        while len(starts) < want and (look := data.find(b"\xff\xf8", look)) >= 0:
            head = header(data, look)
            if head and head[0] == len(starts):
                starts.append(look)
                look = head[2]
            else:
                look += 1
    return Stream(bits, total, block, info[18:34], list(zip(starts, [*starts[1:], len(data)], strict=True)))


def header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, samples, position after it) of a frame header with a right
    CRC-8, or None."""
    if data[at : at + 2] != b"\xff\xf8" or at + 6 > len(data):
        return None
    code = data[at + 2] >> 4
    number, end = read_number(data, at + 4)
    if number < 0 or not code:
        return None
    if code == 6 or code == 7:
        size = int.from_bytes(data[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8)
    rate = data[at + 2] & 15
    end += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if end >= len(data) or crc8(data[at:end]) != data[end]:
        return None
    return number, size, end + 1


def decode_streams(streams: list[bytes | None]) -> list[tuple[np.ndarray | None, bool]]:
    """(samples, intact) of each stream; all frames are decoded in lockstep."""
    metas = [opened(s) if s else None for s in streams]
    good = [m is not None for m in metas]
    # a header may claim any length: no more is held than the frames found can fill
    out: list[np.ndarray | None] = [np.zeros(min(m.total, len(m.frames) * m.block), dtype=np.int32) if m else None for m in metas]
    base = np.concatenate([[0], np.cumsum([len(s or b"") for s in streams])])
    joined = b"".join(s or b"" for s in streams)
    lanes = []  # stream, first sample, samples, bit position, depth, last byte
    first, last = [], []
    for i, m in enumerate(metas):
        if not m:
            continue
        at = 0
        good[i] &= len(m.frames) == -(-m.total // m.block)
        for number, (a, b) in enumerate(m.frames):
            head = header(streams[i], a)
            n = min(m.block, m.total - at)
            if not head or head[0] != number or head[1] != n or b - a < 4:
                good[i] = False
            else:
                lanes.append((i, at, n, 8 * (int(base[i]) + head[2]), m.bits))
                first.append(int(base[i]) + a)
                last.append(int(base[i]) + b)
            at += n
    if not lanes:
        return list(zip(out, good, strict=True))
    data = np.frombuffer(joined + bytes(16), np.uint8)
    first, last = np.array(first), np.array(last)
    said = data[last - 2].astype(np.int64) << 8 | data[last - 1]
    right = crc16_lanes(data, first, last - 2 - first) == said
    for k in np.flatnonzero(~right):
        good[lanes[k][0]] = False
    # only frames that passed their checks are read: nothing they say leads out of them
    lanes = sorted((x for x, r in zip(lanes, right, strict=True) if r), key=lambda x: -x[2])
    if lanes:
        for (i, at, n, _, _), samples in zip(lanes, _decode_lanes(data, lanes), strict=True):
            out[i][at : at + n] = samples[:n]
    for i, m in enumerate(metas):
        if m and good[i] and m.md5 != bytes(16):
            width = "<i1" if m.bits <= 8 else "<i2"
            good[i] = hashlib.md5(out[i].astype(width).tobytes()).digest() == m.md5
    return list(zip(out, good, strict=True))


def _decode_lanes(data: np.ndarray, lanes: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Samples of each lane.  Lanes come with the longest first."""
    wide = np.zeros(len(data) - 8, dtype=np.uint64)  # the eight bytes from each byte on
    for j in range(8):
        wide |= data[j : len(data) - 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    size = np.array([x[2] for x in lanes])
    pos = np.array([x[3] for x in lanes], dtype=np.int64)
    depth = np.array([x[4] for x in lanes], dtype=np.int64)
    count, most = len(lanes), int(size[0])

    def peek(at: np.ndarray) -> np.ndarray:
        return wide[at >> 3] << (at & 7).astype(np.uint64)

    def take(rows: np.ndarray, width: np.ndarray | int, signed: bool = False) -> np.ndarray:
        width = np.broadcast_to(width, rows.shape).astype(np.int64)
        v = np.where(width > 0, peek(pos[rows]) >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)
        pos[rows] += width
        return np.where(v >> np.maximum(width - 1, 0) & 1, v - (1 << width), v) * (width > 0) if signed else v

    every = np.arange(count)
    kind = take(every, 8) >> 1 & 63
    samples = np.zeros((count, most), dtype=np.int32)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    taps = np.zeros((count, max(1, int(order.max()))), dtype=np.int64)
    for p, c in enumerate([(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)]):
        taps[np.ix_(fixed & (order == p), range(len(c)))] = c
    for j in range(int(order.max())):
        rows = np.flatnonzero(order > j)
        samples[rows, j] = take(rows, depth[rows], True)
    shift = np.zeros(count, dtype=np.int64)
    if lpc.any():
        rows = np.flatnonzero(lpc)
        precision = take(rows, 4) + 1
        shift[rows] = take(rows, 5, True)
        for j in range(int(order[rows].max())):
            some = order[rows] > j
            taps[rows[some], j] = take(rows[some], precision[some], True)
    if (rows := np.flatnonzero(kind == 0)).size:
        samples[rows] = take(rows, depth[rows], True)[:, None]
    if (rows := np.flatnonzero(kind == 1)).size:
        for t in range(int(size[rows].max())):
            now = rows[size[rows] > t]
            samples[now, t] = take(now, depth[now], True)
    rows = np.flatnonzero(fixed | lpc)
    if not rows.size:
        return samples
    method, parts = take(rows, 2), take(rows, 4)
    width = np.where(method == 0, 4, 5)
    length = size[rows] >> parts
    k, escape = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
    due = np.zeros(len(rows), dtype=np.int64)  # sample at which the next partition begins
    p, taps, shift, order, size = pos[rows], taps[rows], shift[rows], order[rows], size[rows]
    x = samples[rows]
    tap = [np.ascontiguousarray(taps[:, j]) for j in range(taps.shape[1])]
    lags = [j for j in range(taps.shape[1])]
    earliest, next_due, live = int(order.min()), 0, len(rows)
    orders_differ = int(order.max())
    for t in range(earliest, most):
        while live and size[live - 1] <= t:
            live -= 1
        if t < orders_differ:
            act = np.flatnonzero(order[:live] <= t)
        else:
            act = slice(0, live)
        if t >= next_due or t < orders_differ:  # some lane begins a partition, or its first samples
            begin = np.flatnonzero((due[:live] <= t) & (order[:live] <= t))
            if begin.size:
                pos[rows[begin]] = p[begin]
                k[begin] = take(rows[begin], width[begin])
                raw = begin[k[begin] == (1 << width[begin]) - 1]
                escape[begin] = -1
                escape[raw] = take(rows[raw], 5)
                p[begin] = pos[rows[begin]]
                due[begin] = (t // length[begin] + 1) * length[begin]
            next_due = int(due[:live].min()) if live else most
        at = p[act]
        w = wide[at >> 3] << (at & 7).astype(np.uint64)
        zeros = _CLZ16[(w >> np.uint64(48)).astype(np.int64)]
        ka = k[act]
        if (zeros == 16).any() or (escape[act] >= 0).any():
            value = np.zeros(len(at), dtype=np.int64)
            raw = escape[act] >= 0
            plain, far = at.copy(), zeros == 16
            far &= ~raw
            zeros = np.where(raw, 0, zeros)
            while far.any():
                more = np.where(far, _CLZ16[(peek(plain + zeros) >> np.uint64(48)).astype(np.int64)], 0)
                zeros = zeros + more
                far = more == 16
            low = peek(plain + zeros + 1)
            u = zeros << ka | np.where(ka > 0, (low >> (64 - np.maximum(ka, 1)).astype(np.uint64)).astype(np.int64), 0)
            value = (u >> 1) ^ -(u & 1)
            wide_bits = np.maximum(escape[act], 0)
            v = np.where(wide_bits > 0, (w >> (64 - np.maximum(wide_bits, 1)).astype(np.uint64)).astype(np.int64), 0)
            v = np.where((wide_bits > 0) & (v >> np.maximum(wide_bits - 1, 0) & 1 == 1), v - (1 << wide_bits), v)
            value = np.where(raw, v, value)
            p[act] = at + np.where(raw, wide_bits, zeros + 1 + ka)
        else:
            z = zeros.astype(np.uint64)
            low = (w << z << np.uint64(1)) >> np.uint64(1) >> (63 - ka).astype(np.uint64)
            u = (zeros << ka) | low.astype(np.int64)
            value = (u >> 1) ^ -(u & 1)
            p[act] = at + zeros + 1 + ka
        guess = None
        for j in lags:
            if t > j:
                term = tap[j][act] * x[act, t - 1 - j]
                guess = term if guess is None else guess + term
        x[act, t] = value if guess is None else value + (guess >> shift[act])
    samples[rows] = x
    return samples


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64; their number."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def bytes_of(samples: np.ndarray) -> bytes:
    """The payload that 8-bit samples stand for."""
    return _BYTE[samples.astype(np.int8).view(np.uint8)].tobytes()


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            payloads = [payload_of(x) for x in batch.column("text").to_pylist()]
            media = encode_streams([p for p, _ in payloads])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in payloads], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature_of(samples: np.ndarray) -> str:
    """Peak, mean level, zero crossings and an eight-step histogram, in integers."""
    x = samples.astype(np.int64)
    level = int(np.abs(x).sum() * 1000 // max(1, len(x)))
    crossings = int((np.diff(np.signbit(samples)) != 0).sum())
    steps = np.bincount(np.clip((x + 128) >> 5, 0, 7), minlength=8)
    return f"peak={int(np.abs(x).max(initial=0))};level={level};crossings={crossings};steps={','.join(map(str, steps.tolist()))}"


def described(media: DataFrame) -> DataFrame:
    """Reads each stream back: digests of payload and media, checks and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, intact boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            media = batch.column("media").to_pylist()
            rows = []
            for doc, n, m, (samples, intact) in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), media, decode_streams(media), strict=True):
                if samples is None:
                    rows.append((doc, n, None, None, None, len(m or b""), None if m is None else hashlib.sha256(m).hexdigest(), None, False))
                    continue
                payload = bytes_of(samples)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(samples), intact))
            text, long = pa.string(), pa.int64()
            types = [long, long, long, text, long, long, text, text, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.mapInArrow(run, schema)


def pcm_blocks(media: DataFrame, samples_each: int = 4096) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm, intact): decoded samples as
    little-endian 16-bit PCM, a block to a row, so a range of samples is found by
    its offset alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            rows = []
            for doc, (samples, intact) in zip(batch.column("doc_id").to_pylist(), decode_streams(batch.column("media").to_pylist()), strict=True):
                for b in range(0 if samples is None else -(-len(samples) // samples_each)):
                    part = samples[b * samples_each : (b + 1) * samples_each]
                    rows.append((doc, b, b * samples_each, len(part), part.astype("<i2").tobytes(), intact))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "block", "sample_offset", "n_samples", "pcm", "intact"])

    return media.mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, pcm binary, intact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams are written to the shared folder; all columns come from what is read
    back from there."""
    media = Stage(spark, "flac").write(encoded(table(spark, sf_dir, "documents")), "media", "uncompressed")
    return described(media)
