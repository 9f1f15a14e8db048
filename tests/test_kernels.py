import random

import numpy as np

from corpusloom.functions import kernels as K
from corpusloom.functions import text
from corpusloom.operators import prepare, spans


def hexed(x):
    return f"{int(x):016x}"


def test_vectors():
    abc = np.frombuffer(b"abc", np.uint8)
    assert [hexed(h) for h in K.fnv_many([abc, abc[:0]], 1)] == ["e71fa2190541574b", "cbf29ce484222325"]
    assert hexed(K.fnv_many([abc], 4)[0]) == "4444a5a82eb653f5"
    assert hexed(K.splitmix(np.zeros(1, np.uint64))[0]) == "e220a8397b1dcdaf"
    assert [hexed(K.seeds(32)[i]) for i in (0, 1, 31)] == ["161922c645ce50e8", "e75a816c550d9d2e", "e2c67153ea52ed1b"]
    t, _ = K.tokens_of(b"fn twice(n) { return n * 2 + n; }")
    assert t.tolist() == [114, 1, 10040, 1, 10041, 10123, 109, 1, 10042, 2, 10043, 1, 10059, 10125]
    (block,) = K.blocks_of(t)
    inner = t[block[0] + 1 : block[1]]
    mask, poly = (1 << 64) - 1, 0
    for x in inner.tolist():
        poly = (poly * 911382323 + x + 1) & mask
    assert K.subtree_signatures([(t, [block])])[0][0] == (int(K.fnv_many([inner], 4)[0]), poly, len(inner))

    def fnv(values):
        h = 0xCBF29CE484222325
        for v in values:
            for b in int(v).to_bytes(4, "little"):
                h = (h ^ b) * 0x100000001B3 & mask
        return h

    def mixed(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    shingles = [fnv(inner[i : i + 5]) for i in range(len(inner) - 4)]
    assert [int(x) for x in K.shingle_bases(inner)] == shingles
    assert K.minhash(inner, K.seeds(32)).tolist() == [min(mixed(x ^ int(s)) & 0xFFFFFFFF for x in shingles) for s in K.seeds(32)]
    assert K.simhash(inner) == sum((2 * sum(mixed(x) >> b & 1 for x in shingles) > len(shingles)) << b for b in range(64))


def test_hash_of_wide_and_many_rows():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 1 << rng.choice([7, 14, 31]), rng.integers(0, 40)).astype(np.uint32) for _ in range(120)]
    for width in (4, 8):
        want = []
        for r in rows:
            h = 0xCBF29CE484222325
            for v in r.tolist():
                for b in v.to_bytes(width, "little"):
                    h = (h ^ b) * 0x100000001B3 % 2**64
            want.append(h)
        assert K.fnv_many(rows, width).tolist() == want


def test_texts_read_at_once_and_alone():
    rng = random.Random(8)
    parts = ["a", "if", "x9", "1", ".", "1.2", "\n", " ", '"', "'", "#", "//", "/*", "*/", "\\", "\\\n", "é", "{", "}", "protected", "protectes", "\t", "12ab", "a.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))).encode() for _ in range(400)]
    for text, (t, n) in zip(texts, K.tokens_many(texts), strict=True):
        alone = K.tokens_of(text)
        assert t.tolist() == alone[0].tolist() and n.tolist() == alone[1].tolist()


def test_numbers_and_lines_beside_words():
    """Digits, full stops and words side by side, against a reading byte by byte."""

    def plain(text):
        out, i, line = [], 0, 1
        while i < len(text):
            c, start = text[i], i
            i += 1
            if c == "\n":
                line += 1
            elif c.isalpha() or c == "_":
                while i < len(text) and (text[i].isalnum() or text[i] == "_"):
                    i += 1
                word = text[start:i]
                out.append((100 + K.KEYWORDS.index(word) if word in K.KEYWORDS else 1, line))
            elif c.isdigit():
                while i < len(text) and (text[i].isdigit() or text[i] == "."):
                    i += 1
                out.append((2, line))
            elif c != " ":
                out.append((10_000 + ord(c), line))
        return out

    pick = random.Random(11)
    parts = ["a", "x7", "_", "0", "42", "\n", " ", "+", "{", "if", "continue", "continued", "protected", "protectex", "1.5", ";"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(400)]
    read = prepare.read_tokens([t.encode() for t in texts])
    for text, symbols, (t, n) in zip(texts, read, K.tokens_many([t.encode() for t in texts]), strict=True):
        assert list(zip(t.tolist(), n.tolist(), strict=True)) == plain(text)
        assert symbols.values.tolist() == t.tolist() and symbols.lines(np.arange(len(t))).tolist() == n.tolist()


def test_token_rules():
    kinds = lambda b: K.tokens_of(b)[0].tolist()
    assert kinds(b"a // b\nc") == [1, 1]
    assert kinds(b"# x\n  # y\nz # w") == [1, 10035, 1]
    assert kinds(b"/* a\n*/ # x\nb") == [1]
    assert kinds(b"/* a */ # x") == [10035, 1]
    assert kinds(b"/* open x") == [1]  # the last byte of an open comment is read
    assert kinds(b"1e5 0xFF 1.2.3") == [2, 1, 2, 1, 2]
    assert kinds(b"'it\\'s' \"open") == [3, 3]
    assert kinds("é\x0b".encode()) == [10195, 10169, 10011]  # a vertical tab is no blank
    t, lines = K.tokens_of(b'let a = "x\ny";\nlet b = 1;\n')
    assert lines[3] == 1 and lines[4] == 2 and lines[5] == 3
    assert K.tokens_of(b'"a\\\nb"\nc')[1].tolist() == [1, 2]  # an escaped line end isn't counted


def test_winnowing_windows():
    assert len(K.winnowed(np.full(320, 97), 25, 26)[0]) == 271
    assert len(K.winnowed(np.arange(8), 2, 8)[0]) == 0
    assert len(K.winnowed(np.arange(9), 2, 8)[0]) == 1
    rng = random.Random(3)
    for _ in range(30):
        s = np.array([rng.randrange(3) for _ in range(rng.randrange(60))], dtype=np.uint32)
        h = K.poly_hashes(s, 3).tolist()
        want = sorted({max(i for i in range(a, a + 5) if h[i] == min(h[a : a + 5])) for a in range(len(h) - 4)})
        assert K.winnowed(s, 3, 5)[0].tolist() == want


def test_blocks_against_a_stack():
    rng = random.Random(5)
    for _ in range(200):
        body = "".join(rng.choice("{}ab") for _ in range(rng.randrange(30))).encode()
        t, _ = K.tokens_of(b" ".join(bytes([b]) for b in body))
        stack, want = [], {}
        for i, x in enumerate(t.tolist()):
            if x == 10123:
                want[i] = [i, len(stack)]
                stack.append(i)
            elif x == 10125 and stack:
                want[stack.pop()][0] = i
        assert [(s, e, d) for s, e, d, _ in K.blocks_of(t)] == [(s, *want[s]) for s in sorted(want)]


def test_subtrees_are_equal_where_blocks_are():
    rng = random.Random(6)
    by_text, by_tree = {}, {}
    for _ in range(300):
        body = "".join(rng.choice("{{}}ab") for _ in range(14)).encode()
        t, _ = K.tokens_of(b" ".join(bytes([b]) for b in body))
        found = K.blocks_of(t)
        for b, sig in zip(found, K.subtree_signatures([(t, found)])[0], strict=True):
            if sig:
                inner = tuple(t[b[0] + 1 : b[1]].tolist())
                assert by_text.setdefault(inner, sig) == sig
                assert by_tree.setdefault(sig, inner) == inner
                assert sig[2] <= len(inner)


def test_runs_are_all_maximal_matches():
    rng = random.Random(7)
    for _ in range(100):
        a, b = (np.array([rng.randrange(2) for _ in range(rng.randrange(5, 40))], dtype=np.uint32) for _ in "ab")
        m, want = 4, set()
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= m:
                        want.add((i, j, n))
        p = spans.SpanParams.exact(m)
        (pa_, ha), (pb_, hb) = K.winnowed(a, p.k, p.w), K.winnowed(b, p.k, p.w)
        starts = [(int(y) - int(x), int(x)) for x, h in zip(pa_, ha, strict=True) for y, g in zip(pb_, hb, strict=True) if h == g]
        assert set(spans.runs(a, b, starts, m, False)) == want


def test_previews():
    assert [text.cut_bytes("你好abc", n) for n in (1, 3, 4)] == ["", "你", "你"]
    assert text.line_preview("\n\nab\r\n\ncd", 1, 5) == "ab\n\ncd"
    assert text.line_preview("x" * 300, 1, 1) == "x" * 120
