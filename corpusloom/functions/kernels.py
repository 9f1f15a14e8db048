"""Array kernels for what one document needs in sequence: hashes, tokens, blocks."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

BASIS, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
POLY = np.uint64(911382323)
CHILD = 50_000
# Token kinds, and keywords in the order of their numbers from 100 on.
IDENT, NUMBER, STRING, KEYWORD, PUNCT = 1, 2, 3, 100, 10_000
KEYWORDS = (
    "if else for while do switch case break continue return try catch finally throw fn function class struct enum impl trait "
    "const let var static public private protected async await"
).split()


def fnv_many(rows: list[np.ndarray], width: int) -> np.ndarray:
    """FNV-1a 64 of each row of values; each value is `width` little-endian bytes.
    All rows advance together, the longest first; the last few go on one by one.
    Zero bytes only multiply, so those above a value's last are one factor."""
    out = np.full(len(rows), BASIS, dtype=np.uint64)
    size = np.array([len(r) for r in rows], dtype=np.int64)
    if not size.sum():
        return out
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate(rows).astype(np.uint64)
    used = min(width, max(1, (int(flat.max()).bit_length() + 7) // 8))
    prime, mask = int(PRIME), (1 << 64) - 1
    rest = pow(prime, width - used + 1, 1 << 64)
    factors = [PRIME] * (used - 1) + [np.uint64(rest)]
    at, left = (np.cumsum(size) - size)[order], size[order]
    live, h, i = len(rows), np.full(len(rows), BASIS, dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            while live and left[live - 1] <= i:
                live -= 1
            if live < 48:
                break
            v, now = flat[at[:live] + i], h[:live]
            for b, factor in enumerate(factors):
                now = (now ^ (v if used == 1 else v >> np.uint64(8 * b) & np.uint64(255))) * factor
            h[:live] = now
            i += 1
    for r in range(live):
        x = int(h[r])
        for v in flat[at[r] + i : at[r] + left[r]].tolist():
            for b in range(used - 1):
                x = (x ^ (v >> 8 * b & 255)) * prime & mask
            x = (x ^ v >> 8 * (used - 1)) * rest & mask
        h[r] = x
    out[order] = h
    return out


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def seeds(n: int) -> np.ndarray:
    """The first n values of the generator that numbers MinHash functions."""
    out, s = [], np.array([0x123456789ABCDEF0], dtype=np.uint64)
    for _ in range(n):
        s = splitmix(s)
        out.append(s[0])
    return np.array(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.array([1] + [base] * n, dtype=np.uint64))


SLAB = 1 << 15  # k-grams and windows worked on together: their arrays stay in cache
_UP, _DOWN = _powers(int(POLY), SLAB + 256), _powers(pow(int(POLY), -1, 1 << 64), SLAB + 256)


def poly_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k-gram: differences of running sums in which a symbol
    is divided by the power of its place, times that power again."""
    n = len(symbols) - k + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    if n <= 0:
        return out
    with np.errstate(over="ignore"):
        if k <= 4 or k > 256:
            s = symbols.astype(np.uint64) + np.uint64(1)
            for j in range(k):
                out = out * POLY + s[j : j + n]
            return out
        for a in range(0, n, SLAB):
            m = min(SLAB, n - a)
            s = symbols[a : a + m + k - 1].astype(np.uint64) + np.uint64(1)
            total = np.zeros(len(s) + 1, dtype=np.uint64)
            np.cumsum(s * _DOWN[: len(s)], out=total[1:])
            out[a : a + m] = (total[k:] - total[:-k]) * _UP[k - 1 : k - 1 + m]
    return out


def least_right(h: np.ndarray, w: int) -> np.ndarray:
    """For each full window of w values the place of its least one, the right-most of
    equals; places of windows twice as long come from those of two halves."""
    at, size = np.arange(len(h)), 1
    n = len(h) - w + 1
    while size < w:
        step = min(size, w - size)
        left, right = at[:-step], at[step:]
        at = np.where(h[left] < h[right], left, right)
        size += step
    return at[:n]


def winnowed(symbols: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): the right-most least hash of every full window of w
    k-grams, each position once."""
    h = poly_hashes(symbols, k)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - w + 1
    places = np.concatenate([a + least_right(h[a : a + SLAB + w - 1], w) for a in range(0, n, SLAB)])
    at = places[np.concatenate([[True], places[1:] != places[:-1]])]
    return at, h[at]


# Classes of bytes: 0 none, 1 a letter or _, 2 a digit, 3 a full stop, 4 others.
_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[list(b" \t\r\f\n")] = 0
_CLASS[list(b"_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[ord(".")] = 3
_QUOTED = 5
_OPENING = re.compile(rb"[\"'#]|/[/*]")
_WIDE = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _first_eight(word: bytes) -> int:
    return int.from_bytes(word[:8].ljust(8, b"\0"), "little")


_WORDS = np.array(sorted(_first_eight(w.encode()) for w in KEYWORDS), dtype=np.uint64)
_WORD_OF = {_first_eight(w.encode()): w for w in KEYWORDS}
_WORD_TOKEN = np.array([KEYWORD + KEYWORDS.index(_WORD_OF[int(x)]) for x in _WORDS])
_WORD_LEN = np.array([len(_WORD_OF[int(x)]) for x in _WORDS])
# A word's number from its first eight bytes: a multiplier under which no two collide.
_SHIFT = np.uint64(52)


def _spread() -> tuple[np.uint64, np.ndarray]:
    with np.errstate(over="ignore"):
        for m in seeds(1000) | np.uint64(1):
            slot = (_WORDS * m) >> _SHIFT
            if len(np.unique(slot)) == len(_WORDS):
                table = np.zeros(1 << 12, dtype=np.uint8)
                table[slot] = np.arange(len(_WORDS))
                return m, table
    raise AssertionError("no multiplier tells the keywords apart")


_SPREAD, _SLOTS = _spread()
# The token that begins with a byte, if that isn't in a string, a number or a keyword.
_TOKEN = np.where(_CLASS == 1, IDENT, np.where(_CLASS == 2, NUMBER, PUNCT + np.arange(256))).astype(np.uint32)


def _without_quotes(data: bytes, kinds: np.ndarray) -> list[int]:
    """Takes comments and strings of `data` out of its classes, in place; a string
    leaves one mark where it begins.  Returns the places of line ends that don't
    count, since a backslash stands before them in a string."""
    silent: list[int] = []
    n, at, fresh = len(data), 0, True  # fresh: only blanks since the line or a comment of lines began
    while m := _OPENING.search(data, at):
        p, end = m.start(), m.end()
        before = data[at:p]
        cut = before.rfind(b"\n")
        began = not before[cut + 1 :].strip(b" \t\r\f") and (fresh or cut >= 0)
        what = m.group()
        if what == b"//" or (what == b"#" and began):
            end = data.find(b"\n", end)
            end, fresh = (n if end < 0 else end), False
            kinds[p:end] = 0
        elif what == b"#":
            fresh = False
        elif what == b"/*":
            close = data.find(b"*/", end)
            stop = close if close >= 0 else max(end, n - 1)  # an open comment leaves the last byte
            fresh = data.find(b"\n", end, stop) >= 0
            end = close + 2 if close >= 0 else stop
            kinds[p:end] = 0
        else:
            quote, i = what[0], end
            while i < n and data[i] != quote:
                if data[i] == 0x5C:
                    if i + 1 < n and data[i + 1] == 0x0A:
                        silent.append(i + 1)
                    i += 2  # whatever it is, a line end included, isn't looked at
                else:
                    i += 1
            end, fresh = min(i + 1, n), False
            kinds[p:end] = 0
            kinds[p] = _QUOTED
        at = end
    return silent


def _numbers(kinds: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digits that belong to words, bytes of numbers).  Of digits and full stops in a
    row, digits behind a letter are the word's up to the first full stop; from the
    first other digit on all are a number."""
    own, number = np.zeros(len(kinds), dtype=bool), np.zeros(len(kinds), dtype=bool)
    at = np.flatnonzero((kinds == 2) | (kinds == 3))
    digit = kinds[at] == 2
    first = np.concatenate([[True], at[1:] != at[:-1] + 1])
    heads = np.flatnonzero(first)
    row = np.cumsum(first) - 1
    behind = (letter[np.maximum(at[heads] - 1, 0)] & (at[heads] > 0))[row]
    stops = np.cumsum(~digit)
    of_word = digit & behind & (stops == (stops - ~digit)[heads][row])
    own[at[of_word]] = True
    digit &= ~of_word
    seen = np.cumsum(digit)
    number[at[digit | (seen > (seen - digit)[heads][row])]] = True
    return own, number


class TokenPlaces(NamedTuple):
    """Tokens of texts read as one with line ends between them: their places, the
    places of line ends that count, and where each text and its tokens end."""

    tokens: np.ndarray
    at: np.ndarray
    newlines: np.ndarray
    heads: np.ndarray
    cuts: np.ndarray


def token_places(texts: list[bytes]) -> TokenPlaces:
    """Only comments and strings are looked for one by one."""
    data = b"\n".join(texts) + b"\n" + bytes(9)
    size = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(size)
    heads = ends - size
    raw = np.frombuffer(data, np.uint8)[: int(ends[-1])]
    kinds = _CLASS[raw]
    silent: list[int] = []
    for text, head in zip(texts, heads.tolist(), strict=True):
        if _OPENING.search(text):
            silent += [head + i for i in _without_quotes(text, kinds[head : head + len(text)])]
    letter = kinds == 1
    word, begins = letter, kinds >= 3  # full stops, others and strings
    if (kinds == 2).any():
        own, number = _numbers(kinds, letter)
        word = letter | own
        begins &= ~number
        begins[1:] |= number[1:] & ~number[:-1]
        begins[0] |= number[0]
    over = word[1:] & ~word[:-1]
    begins[1:] |= over
    begins[0] |= word[0]
    at = np.flatnonzero(begins)
    token = _TOKEN[raw[at]]
    if silent or b'"' in data or b"'" in data:
        token[kinds[at] == _QUOTED] = STRING
    if word is not letter:
        token[number[at]] = NUMBER
    names = np.flatnonzero(token == IDENT)
    if len(names):
        heads_ = at[names]
        length = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - heads_  # the last byte is a line end
        eight = np.ndarray((len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))[heads_] & _WIDE[np.minimum(length, 8)]
        i = _SLOTS[(eight * _SPREAD) >> _SHIFT]
        same = np.flatnonzero((_WORDS[i] == eight) & (_WORD_LEN[i] == length))
        for j in same[length[same] > 8].tolist():
            if data[heads_[j] : heads_[j] + length[j]].decode("latin-1") not in KEYWORDS:
                same = same[same != j]
        token[names[same]] = _WORD_TOKEN[i[same]]
    counted = raw == 0x0A
    counted[silent] = False
    return TokenPlaces(token, at, np.flatnonzero(counted), heads, np.searchsorted(at, ends[:-1]))


def tokens_many(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(token, line) arrays of each text's bytes."""
    if not texts:
        return []
    token, at, newlines, heads, cuts = token_places(texts)
    # tokens between one line end and the next have one line
    ends = np.searchsorted(at, newlines)
    line = np.repeat(np.arange(1, len(newlines) + 2), np.diff(np.concatenate([[0], ends, [len(at)]])))
    base = np.repeat(np.searchsorted(newlines, heads), np.diff(np.concatenate([[0], cuts, [len(at)]])))
    return list(zip(np.split(token, cuts), np.split((line - base).astype(np.int32), cuts), strict=True))


def tokens_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(token, line) arrays of a text's bytes."""
    return tokens_many([data])[0]


def blocks_of(tokens: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start token, end token, depth, parent) of each brace block in the order of
    its opening; depth counts the blocks open around it; an open block ends where
    it starts; a stray closing brace is nothing."""
    out: list[list[int]] = []
    stack: list[int] = []
    braces = np.flatnonzero((tokens == PUNCT + 123) | (tokens == PUNCT + 125))
    for at in braces.tolist():
        if tokens[at] == PUNCT + 123:
            out.append([at, at, len(stack), stack[-1] if stack else -1])
            stack.append(len(out) - 1)
        elif stack:
            out[stack.pop()][1] = at
    return [tuple(b) for b in out]


def poly_many(rows: list[np.ndarray]) -> np.ndarray:
    """Polynomial hash of each whole row of 64-bit values, all rows at once."""
    out = np.zeros(len(rows), dtype=np.uint64)
    size = np.array([len(r) for r in rows])
    if not size.sum():
        return out
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate(rows).astype(np.uint64) + np.uint64(1)
    at, left = (np.cumsum(size) - size)[order], size[order]
    h, live = np.zeros(len(rows), dtype=np.uint64), len(rows)
    with np.errstate(over="ignore"):
        for i in range(int(left[0])):
            while live and left[live - 1] <= i:
                live -= 1
            h[:live] = h[:live] * POLY + flat[at[:live] + i]
    out[order] = h
    return out


def subtree_signatures(files: list[tuple[np.ndarray, list[tuple[int, int, int, int]]]]) -> list[list[tuple[int, int, int] | None]]:
    """(hash, second hash, length) of each block of each file, given as tokens and
    blocks.  A child stands as a marker and its hash of eight bytes; None for empty
    and open blocks.  Blocks of one depth are hashed together, the deepest first."""
    out: list[list[tuple[int, int, int] | None]] = [[None] * len(blocks) for _, blocks in files]
    children: list[list[list[int]]] = [[[] for _ in blocks] for _, blocks in files]
    levels: dict[int, list[tuple[int, int]]] = {}
    for f, (_, blocks) in enumerate(files):
        for i, (start, end, depth, parent) in enumerate(blocks):
            if parent >= 0:
                children[f][parent].append(i)
            if end > start + 1:
                levels.setdefault(depth, []).append((f, i))
    marker = np.array([CHILD], dtype="<u4")
    for depth in sorted(levels, reverse=True):
        coded, values = [], []
        for f, i in levels[depth]:
            tokens, blocks = files[f]
            at, end = blocks[i][0] + 1, blocks[i][1]
            raw, own = [], []
            for c in children[f][i]:
                part = tokens[at : blocks[c][0]].astype("<u4")
                child = np.array([out[f][c][0] if out[f][c] else 0], dtype="<u8")
                raw += [part.view(np.uint8), marker.view(np.uint8), child.view(np.uint8)]
                own += [part, marker, child]
                at = blocks[c][1] + 1
            part = tokens[at:end].astype("<u4")
            coded.append(np.concatenate([*raw, part.view(np.uint8)]))
            values.append(np.concatenate([x.astype(np.uint64) for x in [*own, part]]))
        for (f, i), h1, h2, v in zip(levels[depth], fnv_many(coded, 1).tolist(), poly_many(values).tolist(), values, strict=True):
            out[f][i] = (h1, h2, len(v))
    return out


def shingle_bases(tokens: np.ndarray, size: int = 5) -> np.ndarray:
    """FNV of each window of `size` tokens, four bytes a token."""
    n = len(tokens) - size + 1
    h = np.full(max(0, n), BASIS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size if n > 0 else 0):
            v = tokens[j : j + n].astype(np.uint64)
            for b in range(4):
                h = (h ^ (v >> np.uint64(8 * b) & np.uint64(255))) * PRIME
    return h


def _range_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last] of each range, wrapping."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[last] - total[first]


def minhash_ranges(bases: np.ndarray, first: np.ndarray, last: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """[range, number]: MinHash slots of the shingles bases[first:last]; ranges may
    lie within each other, so a shingle is hashed once however many blocks hold it."""
    ends = np.stack([first, last], axis=1).ravel()
    low, bases = np.uint64(0xFFFFFFFF), np.append(bases, np.uint64(0))
    return np.stack([np.minimum.reduceat(splitmix(bases ^ s) & low, ends)[::2] for s in numbers], axis=1)


_LANES = np.array([sum((x >> b & 1) << 16 * b for b in range(4)) for x in range(16)], dtype=np.uint64)


def simhash_ranges(bases: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """SimHash of the shingles bases[first:last] of each range; a bit is set if more
    than half of them have it.  Four bits are counted in one word of 16-bit lanes, in
    pieces that can't overflow a lane."""
    h = splitmix(bases)
    size = last - first
    pieces = [(i, a, min(a + 65_535, e)) for i, (s, e) in enumerate(zip(first.tolist(), last.tolist(), strict=True)) for a in range(s, e, 65_535)]
    owner, begin, end = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64),) * 3
    out = np.zeros(len(first), dtype=np.uint64)
    for j in range(16):
        summed = _range_sums(_LANES[(h >> np.uint64(4 * j) & np.uint64(15)).astype(np.intp)], begin, end)
        for b in range(4):
            ones = np.zeros(len(first), dtype=np.int64)
            np.add.at(ones, owner, (summed >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64))
            out |= (2 * ones > size).astype(np.uint64) << np.uint64(4 * j + b)
    return out


def minhash(tokens: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    bases = shingle_bases(tokens)
    return minhash_ranges(bases, np.array([0]), np.array([len(bases)]), numbers)[0]


def simhash(tokens: np.ndarray) -> int:
    bases = shingle_bases(tokens)
    return int(simhash_ranges(bases, np.array([0]), np.array([len(bases)]))[0])
