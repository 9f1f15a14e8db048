import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import packing, token_store, tokens
from corpusloom.llm.common import Stage

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(PATH, most=50)


def ids_of(enc, text):
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=60) | st.text("ab c'tslld123 .!\n\t\xa0é", max_size=60), max_size=4))
def test_cache_gives_what_the_library_gives(texts):
    enc = tokens.encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids_of(enc, t) for t in texts]


def test_special_strings_and_full_cache(enc):
    texts = ["a <|endoftext|> b", "", "hello  world", "naïve café 12", "tab\tand\nline \x1c", "日本 text"] * 3 + [f"word{i} other" for i in range(200)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [ids_of(enc, t) for t in texts]
    assert len(enc.known) <= 50


def test_joined_checksums():
    parts = [b"abc", b"", b"x" * 1000, b"defg" * 77]
    got = tokens.crc_joined(np.array([zlib.crc32(p) for p in parts]), np.array(list(map(len, parts))), np.array([0, 3]))
    assert got.tolist() == [zlib.crc32(b"".join(parts[:3])), zlib.crc32(parts[3])]


def expected(enc, docs, end):
    """Rows in ascending doc_id order."""
    start = 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = np.array([*ids_of(enc, t or ""), end], "<u4").tobytes()
        yield d, start, len(raw) // 4, zlib.crc32(raw), raw
        start += len(raw) // 4


def test_store_round_trip(spark, enc):
    shared = "the same long passage of words in several documents " * 80
    docs = [(i, f"document {i} {shared}") for i in range(6)] + [(50, None), (40, ""), (30, "short é 你好"), (45, shared * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    store = token_store.TokenStore.write(spark, frame, Stage(spark, "t").path("s"))
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.verify().collect() if r.intact}
    want = list(expected(enc, docs, 2))
    assert got == {w[:4] for w in want}
    whole = {r.doc_id: r.ids for r in store.documents(frame).collect()}
    assert all(whole[d] == np.frombuffer(raw, "<u4").tolist() for d, *_, raw in want)
    keys = [bytes(r.key) for r in store.chunks().collect()]
    assert len(keys) == len(set(keys)) < store.read("recipes").select(F.sum(F.octet_length("digests") / 16)).first()[0]


def test_store_notices_changes(spark):
    frame = spark.createDataFrame([(1, "some words " * 50), (2, "other words " * 50)], "doc_id long, text string")
    stage = Stage(spark, "t")
    store = token_store.TokenStore.write(spark, frame, stage.path("s"))
    entries = store.read("entries").collect()
    r = next(x for x in entries if x.kind == 0)
    bad = [x.asDict() | ({"data": bytearray(r.data[:-2]) + b"\1\1"} if x.key == r.key else {}) for x in entries]
    spark.createDataFrame(bad, store.read("entries").schema).write.mode("overwrite").parquet(stage.path("t/entries"))
    for name in ("recipes", "manifest"):
        store.read(name).write.mode("overwrite").parquet(stage.path(f"t/{name}"))
    assert sorted(r.intact for r in token_store.TokenStore(spark, stage.path("t")).verify().collect()) == [False, True]


def test_odd_documents_in_the_store(spark, odd_docs, no_docs, enc):
    store = token_store.TokenStore.write(spark, odd_docs, Stage(spark, "t").path("s"))
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.verify().where("intact").collect()), key=lambda r: r[2])
    want = [(d is not None, d, *rest[:3]) for d, *rest in expected(enc, [(r.doc_id, r.text) for r in odd_docs.collect()], 2)]
    assert got == want
    assert token_store.TokenStore.write(spark, no_docs, Stage(spark, "t").path("s")).verify().count() == 0


def test_cuts_depend_on_the_stream_alone():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50_000, 5000).astype(np.uint32), rng.integers(0, 50_000, 30).astype(np.uint32)
    one, two = token_store.cut_points(np.concatenate([b, a]), [30, 5030])
    assert one == [30] and [x - 30 for x in two] == token_store.cut_points(a, [5000])[0]
    sizes = np.diff([0, *token_store.cut_points(a, [5000])[0]])
    assert sizes.sum() == 5000 and sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()


def best(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(0, 60))
def test_subset_sum_is_the_closest(lengths, room):
    counts = np.bincount(lengths, minlength=61)
    used = packing.closest(counts, room)
    assert sum(k * x for x, k in used.items()) == best(lengths, room)
    assert all(k <= counts[x] for x, k in used.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packed_lengths_lie_apart(lengths):
    sequence, offset = packing.minimum_bin_slack(np.array(lengths, dtype=np.int64), 64)
    filled = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths, strict=True)):
        assert filled.get(s, 0) == o
        filled[s] = o + n
    assert all(n <= 64 for n in filled.values()) and len(filled) <= 2 * -(-sum(lengths) // 64)


def test_pieces_rebuild_documents(spark, odd_docs, no_docs, enc):
    rows = packing.pack(spark, odd_docs).collect()
    assert packing.pack(spark, no_docs).count() == 0
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in {(r.doc_id, r.text) for r in odd_docs.collect()}:
        ids = np.array([*ids_of(enc, t or ""), 1], "<u4")
        pieces = sorted({(r.start, r.length, r.ids_crc32) for r in by_doc[d]})
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in pieces)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_little_padding(spark, sf_dir):
    out = packing.query(spark, sf_dir).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert out.n > 0.99 * 2048 * (out.s - 1)
