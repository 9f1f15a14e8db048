import random
import zlib

from pyspark.sql import functions as F

from corpusloom.llm import toxicity as T

COMMON = [f"word{i}" for i in range(300)]


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(COMMON) for _ in range(rng.randrange(30, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilest", "rotten", "grumba" + rng.choice("abcdef")])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_on_made_documents(spark):
    docs, labels = corpus(spark)
    out = T.scored(docs, T.fit(docs, labels)).join(labels, "doc_id").where(T.held_out(docs.doc_id)).collect()
    wrong = sum(r.predicted != r.toxic for r in out)
    assert len(out) > 80 and wrong <= 0.05 * len(out)


def test_held_out_accuracy_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = T.query(spark, sf_dir).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    assert sum(r.predicted != r.toxic for r in rows) <= 0.15 * len(rows)
    ordinary, toxic = ([r.score for r in rows if r.toxic == c] for c in (0, 1))
    above = sum((t > o) + (t == o) / 2 for t in toxic for o in ordinary) / (len(toxic) * len(ordinary))
    assert above >= 0.85


def test_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(spark, 200)
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, turned)
    assert a.forms == b.forms and a.weights.tolist() == b.weights.tolist()


def test_held_out_remainder(spark):
    rows = spark.range(50).select("id", T.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_scores_do_not_depend_on_other_columns(spark):
    docs, labels = corpus(spark, 200)
    model = T.fit(docs, labels)
    a = {r.doc_id: r.score for r in T.scored(docs, model).collect()}
    b = {r.doc_id - 1000: r.score for r in T.scored(docs.withColumn("doc_id", F.col("doc_id") + 1000), model).collect()}
    assert a == b


def test_odd_documents(spark, odd_docs, no_docs):
    docs, labels = corpus(spark, 200)
    model = T.fit(docs, labels)
    rows = T.scored(odd_docs, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert T.scored(no_docs, model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit(docs, nothing).score("x") == 0.0 and T.fit(no_docs, labels).score(None) == 0.0
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    assert T.fit(docs, one).score("anything") == 1.0


def test_rare_words_decide_nothing(spark):
    docs, labels = corpus(spark, 300)
    model = T.fit(docs, labels)
    assert model.ratio("zzzzzzzz") == 0.0
    assert model.ratio("vilest") > 2 and model.ratio("grumbazzz") > 1


def test_every_pair_that_occurs_twice_is_kept(spark):
    rng = random.Random(5)
    words = ["w" + "".join(rng.choices("abcdefghij", k=3)) for _ in range(60_000)]
    held = set(zip(words, words[1:], strict=False))
    assert len(held) > 50_000
    docs = spark.createDataFrame([(i, " ".join(words) if i < 12 else "something short") for i in range(24)], "doc_id long, text string")
    model = T.fit(docs, docs.select("doc_id", (F.col("doc_id") >= 12).cast("int").alias("toxic")))
    assert {(v, w) for v, after in model.pairs.items() for w in after} >= held


def test_shared_counts_are_exact(spark):
    """For two words with the same crc32 in 18 bits, too."""
    rng, seen = random.Random(2), {}
    for _ in range(10_000):
        w = "".join(rng.choices("klmnopqrst", k=7))
        if (other := seen.setdefault(zlib.crc32(w.encode()) & (1 << 18) - 1, w)) != w:
            break
    assert other != w
    docs = spark.createDataFrame([(f"{other} {other} abcdefgh x{i}",) for i in range(7)] + [(f"{w} abcdef",), (None,)], "text string").repartition(3)
    counts, total = T.shared_counts(docs, "text", [{other, w, "unseen"}, {"abcdef"}, {"abcd"}])
    six, four = (sum(x[:k] == "abcdef"[:k] for x in (other,)) * 7 + (w[:k] == "abcdef"[:k]) + 8 for k in (6, 4))
    assert counts == [{other: 7, w: 1}, {"abcdef": six}, {"abcd": four}] and total == 7 * 3 + 2
