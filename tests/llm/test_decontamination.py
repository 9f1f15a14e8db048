import random
import re

from corpusloom.llm import decontamination as D


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefg')}{rng.randrange(60)}" for _ in range(n)]


def item(i):
    w = words(30, i)
    return " ".join(w[:24]) + ". " + " ".join(w[24:]) + "."


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_index_finds_what_all_pairs_find():
    items = [(i, item(i)) for i in range(70)]
    shard = D.Shard(items)
    docs = [words(400, 1000 + i) for i in range(20)]
    for i in range(20):
        docs[i][37 * i % 300 : 37 * i % 300] = re.findall(r"\w+", items[i * 3][1])
        docs[i] += re.findall(r"\w+", items[69 - i][1])[: 5 + i]
    got = {(d, c, i): round(s, 9) for d, c, i, s in shard.candidates(docs, 0.5)}
    want = {}
    for d, doc in enumerate(docs):
        for c in range(-(-len(doc) // shard.stride)):
            held = {shard.vocabulary.get(w) for w in doc[c * shard.stride : (c + 2) * shard.stride]}
            for i, impacts in enumerate(shard.impacts):
                score = sum(x for t, x in impacts.items() if t in held)
                if score >= 0.5:
                    want[d, c, i] = round(score, 9)
    assert got == want and want


def test_leaks_are_found_and_clean_documents_left(spark):
    items = [(i, item(i)) for i in range(40)]
    docs = [(1, " ".join(words(500, 77)) + "\n" + items[3][1].upper() + "\n" + " ".join(words(90, 78))), (2, " ".join(words(800, 79))), (3, items[5][1].split(".")[0]), (4, items[7][1])]
    found = D.contaminated(*frames(spark, docs, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 3), (4, 7)}  # the question alone is no leak


def test_shards_give_the_same(spark):
    items = [(i, item(i)) for i in range(25)]
    docs = [(i, " ".join(words(200, 300 + i)) + " " + items[i][1]) for i in range(25)]
    one = D.contaminated(*frames(spark, docs, items)).orderBy("doc_id", "item_id").collect()
    many = D.contaminated(*frames(spark, docs, items), shard_items=4).orderBy("doc_id", "item_id").collect()
    assert [(r.doc_id, r.item_id) for r in one] == [(r.doc_id, r.item_id) for r in many] == [(i, i) for i in range(25)]


def test_query_against_shingles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    own = {d.doc_id: grams(d.text) for d in docs}
    want = {(d, i.item_id) for i in items for g in [grams(i.text)] for d in own if len(g & own[d]) >= 0.6 * len(g)}
    assert {(r.doc_id, r.item_id) for r in D.query(spark, sf_dir).collect()} == want and want


def test_odd_inputs(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "one sentence of seven words in all"), (4, "one sentence of seven words in all"), (None, "hé 你好 x y")], "item_id long, text string")
    assert D.contaminated(no_docs, items).count() == 0
    assert D.contaminated(odd_docs, items.limit(3)).count() == 0
    assert {r.item_id for r in D.contaminated(odd_docs, items).collect()} <= {None}
    twice = spark.createDataFrame([(9, "so: one sentence of seven words in all.")], "doc_id long, text string")
    assert [r.item_id for r in D.contaminated(twice, items).collect()] == [4, 4]
