import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import flac as A


def payloads():
    rng = random.Random(4)
    out = [A.payload_of(t)[0] for t in ("", None, "a", "é" * 50, "x" * 5000, "hello world " * 400, "ab" * 100_000)]
    out += [bytes(rng.randrange(256) for _ in range(64 * k)) for k in (1, 3, 16, 17, 40)]
    wave = (128 + 100 * np.sin(np.arange(64 * 90) / 9)).astype(np.uint8).tobytes()
    return [*out, wave, bytes([0, 255] * 640), bytes([7] * 1024 + [9] * 1024)]


def test_round_trip():
    ps = payloads()
    streams = A.encode_streams(ps)
    for p, (samples, intact) in zip(ps, A.decode_streams(streams), strict=True):
        assert intact and A.bytes_of(samples) == p
    assert A.encode_streams(ps[:2]) == streams[:2] and streams[0] == streams[1]


def test_every_kind_of_subframe_is_used():
    kinds = set()
    for s in A.encode_streams(payloads()):
        for a, _ in A.opened(s).frames:
            kinds.add(s[A.header(s, a)[2]] >> 1)
    assert {0, 1} < kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)


def test_broken_bytes_are_noticed():
    (stream,) = A.encode_streams([A.payload_of("some words to be stored " * 90)[0]])
    for at in range(4, len(stream), 97):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        samples, intact = A.decode_streams([bytes(bad)])[0]
        right = samples is not None and intact
        # only a seek point or a field that says nothing about samples may change unnoticed
        assert not right or 4 <= at < A.opened(stream).frames[0][0]
    assert A.decode_streams([b"", b"junk", None, stream[:-40]])[:3] == [(None, False)] * 3
    assert not A.decode_streams([stream[:-40]])[0][1]


def test_frames_are_found_without_a_seek_table():
    p = A.payload_of("no seek table in here " * 400)[0]
    (stream,) = A.encode_streams([p])
    info, first = stream[8:42], A.opened(stream).frames[0][0]
    bare = b"fLaC\x80\x00\x00\x22" + info + stream[first:]
    samples, intact = A.decode_streams([bare])[0]
    assert intact and A.bytes_of(samples) == p


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v & ((1 << n) - 1), f"0{n}b")

    def rice(self, e, k):
        u = e * 2 if e >= 0 else -e * 2 - 1
        self.bits += "0" * (u >> k) + "1"
        if k:
            self.put(u, k)


def crc16(data):
    r = 0
    for b in data:
        r = (r << 8 & 0xFFFF) ^ int(A._CRC16[(r >> 8) ^ b])
    return r


def hand_made(samples, orders=2, partition=2, escape=1, bits=16):
    """A 16-bit stream whose residuals have partitions, one of them unencoded."""
    n, b = len(samples), Bits()
    b.put(8 + orders, 7)
    b.put(0, 1)
    for s in samples[:orders]:
        b.put(s, bits)
    b.put(0, 2)
    b.put(partition, 4)
    e = [samples[i] - 2 * samples[i - 1] + samples[i - 2] for i in range(2, n)]
    size, at = n >> partition, 0
    for p in range(1 << partition):
        now = e[at : at + size - (orders if p == 0 else 0)]
        at += len(now)
        if p == escape:
            b.put(15, 4)
            b.put(17, 5)
            for x in now:
                b.put(x, 17)
        else:
            b.put(p, 4)
            for x in now:
                b.rice(x, p)
    body = int(b.bits + "0" * (-len(b.bits) % 8), 2).to_bytes((len(b.bits) + 7) // 8, "big")
    head = b"\xff\xf8" + bytes([7 << 4, 4 << 1]) + A.coded_number(0) + (n - 1).to_bytes(2, "big")
    frame = head + bytes([A.crc8(head)]) + body
    frame += crc16(frame).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (bits - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(np.array(samples, "<i2").tobytes()).digest()
    return b"fLaC\x80\x00\x00\x22" + info + frame


def test_partitions_escapes_and_long_codes():
    rng = random.Random(8)
    samples = [0, 3]
    for _ in range(62):
        samples.append(max(-30000, min(30000, samples[-1] + rng.choice([-60, -2, 0, 1, 40]))))
    got, intact = A.decode_streams([hand_made(samples)])[0]
    assert intact and got.tolist() == samples


def test_numbers_of_frames():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**31 - 1):
        data = A.coded_number(n)
        assert A.read_number(data, 0) == (n, len(data))


def test_contract_columns_and_blocks(spark, odd_docs, no_docs):
    rows = A.described(A.encoded(odd_docs)).collect()
    texts = [r.text for r in odd_docs.collect()]
    assert len(rows) == 7
    for text, r in zip(texts, rows, strict=True):
        p, n = A.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and r.intact
        assert len(p) % 64 == 0 and p
    assert A.described(A.encoded(no_docs)).count() == 0
    blocks = A.pcm_blocks(A.encoded(odd_docs.where("doc_id = 3").limit(1)), 1000).orderBy("block").collect()
    pcm = np.concatenate([np.frombuffer(b.pcm, "<i2") for b in blocks])
    assert [b.sample_offset for b in blocks] == list(range(0, len(pcm), 1000))
    assert A.bytes_of(pcm) == A.payload_of(texts[2])[0]


@pytest.mark.parametrize("bad", [b"fLaC", b"fLaC\x80\x00\x00\x22" + bytes(34)])
def test_empty_metadata(bad):
    assert A.decode_streams([bad])[0][0] is None
