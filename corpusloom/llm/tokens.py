"""Token ids of whole texts by the tokenizers library, with a pre-token cache.

A byte-level BPE tokenizer without a normalizer splits a text by one pattern and
encodes each part by itself, so the ids of a part can be kept and joined.  The
cache is used only where that holds: the tokenizer file must say so, and the text
must be plain Latin-1 without control characters or special-token strings.  Every
other text goes through the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import islice

import numpy as np

_PLAIN = bytes(b for b in [9, 10, 13, *range(32, 127), *range(161, 256)] if b != 173)
# The published split pattern of byte-level BPE, with \p{L} and \p{N} spelt out for Latin-1.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """encode(texts) -> for each text its ids as little-endian u32 bytes."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.most, self.known = most, {}
        self.split = None
        splits_by_itself = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if splits_by_itself and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"):
            self.split = _SPLIT
            size = self.tokenizer.get_vocab_size()
            self.blank_first = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts.  Parts of a blank and letters are encoded as one text, which
        the tokenizer splits before each blank, so that a part's ids begin where an
        id's string begins with a blank; the others are encoded one by one."""
        spaced = [w for w in parts if w[0] == " " and w[1:].isalpha()]
        rest = [w for w in parts if not (w[0] == " " and w[1:].isalpha())]
        out = dict(zip(rest, self._whole(rest), strict=True)) if rest else {}
        for i in range(0, len(spaced), 50_000):
            some = spaced[i : i + 50_000]
            (e,) = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            starts, ids = np.flatnonzero(self.blank_first[ids]), ids.tobytes()
            if len(starts) == len(some):
                bounds = [*(4 * starts).tolist(), len(ids)]
                out.update((w, ids[a:b]) for w, a, b in zip(some, bounds, bounds[1:], strict=False))
            else:
                out.update(zip(some, self._whole(some), strict=True))
        return out

    def _cachable(self, text: str) -> bool:
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            return False
        return plain and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return self._whole(texts)
        out: list[bytes | None] = [None] * len(texts)
        parts, rest = [], []
        for i, text in enumerate(texts):
            if self._cachable(text):
                parts.append((i, self.split(text)))
            else:
                rest.append(i)
        known = self.known
        new = set().union(*(words for _, words in parts)).difference(known)
        fresh = self._parts(list(new))
        known.update(fresh)
        take = known.__getitem__
        for i, words in parts:
            out[i] = b"".join(map(take, words))
        for w in islice(fresh, max(0, len(known) - self.most)):  # what came first stays: it is the most frequent
            del known[w]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _zeros() -> np.ndarray:
    """[j, b, v]: what 2^j zero bytes after it make of byte b of a CRC-32, valued v."""
    poly = 0xEDB88320
    rows = np.array([poly, *(1 << i for i in range(31))], dtype=np.uint64)  # one zero bit

    def square(m):
        return np.array([apply(m, int(x)) for x in m], dtype=np.uint64)

    def apply(m, v):
        r = 0
        for i in range(32):
            if v >> i & 1:
                r ^= int(m[i])
        return r

    m = rows
    for _ in range(3):
        m = square(m)
    out = np.zeros((40, 4, 256), dtype=np.uint32)
    for j in range(40):
        for b in range(4):
            for v in range(256):
                r = 0
                for i in range(8):
                    if v >> i & 1:
                        r ^= int(m[8 * b + i])
                out[j, b, v] = r
        m = square(m)
    return out


_ZEROS: list[np.ndarray] = []


def crc_after(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part of a CRC-32 that comes from what stands n_bytes before its end."""
    if not _ZEROS:
        _ZEROS.append(_zeros())
    crc, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for j in range(int(n.max(initial=0)).bit_length()):
        t = _ZEROS[0][j]
        moved = t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]
        crc = np.where(n >> j & 1, moved, crc)
    return crc


def crc_joined(crcs: np.ndarray, n_bytes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of parts; run i has the parts from starts[i] on."""
    total = np.add.reduceat(n_bytes, starts) if len(starts) else np.zeros(0, np.int64)
    ends = np.cumsum(n_bytes)
    run = np.repeat(np.arange(len(starts)), np.diff([*starts, len(crcs)]))
    begun = np.concatenate([[0], ends])[starts] if len(starts) else total
    after = (begun + total)[run] - ends
    return np.bitwise_xor.reduceat(crc_after(crcs, after), starts) if len(starts) else np.zeros(0, np.uint32)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
