import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import components, jaccard_join as J
from corpusloom.llm.common import Stage


def brute(docs, threshold=0.8):
    """{doc: (class, links)} from all pairs of texts."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None
    texts = dict(docs)
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if x is None or y is None:
                near = x is y and (texts[a] or "").strip() == (texts[b] or "").strip() != ""
            else:
                near = len(x & y) >= threshold * len(x | y) - 1e-9
            if near:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (find(d), links[d]) for d in names}


def near_texts(n, seed, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        now = list(base)
        for _ in range(rng.randrange(3)):
            now[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(now)


def test_against_brute_force(spark):
    texts = [t for s in range(12) for t in near_texts(6, s)] + ["a b c", "A b, c!", "!!", " !! ", "", None, "one", "one two three four five"]
    docs = list(enumerate(texts, 1))
    out = J.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links) for r in out.collect()} == brute(docs)


def test_large_group_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    docs = list(enumerate(near_texts(60, 99), 1)) + [(1000 + i, "copy of " + "one text " * 9) for i in range(40)]
    out = J.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links) for r in out.collect()} == brute(docs)


def test_shuffled_addresses_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    docs = [(i, t) for i, t in enumerate(near_texts(8, 5))]
    out = J.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links) for r in out.collect()} == brute(docs)


def test_depth_is_shortened_to_the_target():
    assert J.adapted_depth(0.8, 0.999, 18, 8) == 5
    assert J.adapted_depth(0.8, 0.9, 18, 8) == 8
    assert J.recall(0.8, 5, 18) >= 0.999 > J.recall(0.8, 6, 18)


def test_recall_at_the_threshold():
    """Pairs built at Jaccard 0.8 share a node about as often as they should."""
    rng, forest, found = np.random.default_rng(1), J.Forest(18, 5), 0
    for _ in range(200):
        u = rng.integers(0, 2**63, 180).astype(np.uint64) * np.uint64(2)
        a, b = u[:162], np.concatenate([u[:144], u[162:180]])  # 144 of 180
        names = forest.prefixes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        found += (names[0] == names[1]).any()
    assert found >= 195


def test_odd_documents(spark, odd_docs, no_docs):
    out = {(r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(spark, odd_docs).collect()}
    assert (1, 1, 0) in out and (2, 2, 0) in out and (5, 5, 0) in out and (3, 3, 1) in out and (None, None, 0) in out
    assert J.near_duplicates(spark, odd_docs).count() == 7
    assert J.near_duplicates(spark, no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(frame, Stage(spark, "t"), "c").collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}
    assert got == want


def test_clean_documents_stay_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = J.query(spark, sf_dir)
    assert out.count() == docs.count()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in out.collect()} == want
    groups = defaultdict(int)
    for c, _ in want.values():
        groups[c] += 1
    assert out.where(F.col("n_links") > 0).count() == sum(n for n in groups.values() if n > 1)
