import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup as L

BLANKS = " \t\n\x0b\f\r"


def brute(docs):
    key = lambda s: s.strip(BLANKS).translate(str.maketrans(L.UPPER, L.LOWER))
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 5 and d != max(held[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_against_brute_force(spark):
    common = "Shared Line that is certainly longer than forty code points é"
    docs = [(i, f"own line {i}\n  {common.upper() if i % 2 else common}\t\nshort\nshort") for i in range(9)]
    docs += [(20, "only here but also more than forty code points long, yes"), (21, None), (22, ""), (23, "\n")]
    docs = [(d, t.replace("É", "é") if t else t) for d, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {
        r[0]: (r[1], r[2], r[3]) for r in L.dedup_lines(spark, frame).select("doc_id", "__n_lines", "__n_dropped", "text").collect()
    }
    assert got == brute(docs)


def test_runs_are_levelled_and_fresh_keys_anti_joined(spark):
    line = "{} a line that has more than forty code points in all of it".format
    batches = [[(1, line("a")), (2, line("b"))], [(3, line("a")), (4, line("c"))], [(5, line("b")), (6, line("d"))], [(7, line("a"))]]
    runs, fresh = L.LineRuns(spark, fanout=2), []
    for b in batches:
        fresh.append(runs.ingest(spark.createDataFrame(b, "doc_id long, text string")).count())
    assert fresh == [2, 1, 1, 0]
    assert sum(map(len, runs.levels)) < 4  # compacted on the way
    assert sorted(r.n_docs for r in runs.counts().collect()) == [1, 1, 2, 3]


def test_query_and_sql_agree(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(L.SQL).df().sort_values("doc_id").values.tolist()
    assert L.query(spark, sf_dir).toPandas().sort_values("doc_id").values.tolist() == want


def test_odd_documents(spark, odd_docs, no_docs):
    out = L.dedup_lines(spark, odd_docs)
    assert set(odd_docs.columns) < set(out.columns) and out.count() == 7
    assert out.where("doc_id = 1").select("__n_lines", "text").first()[:] == (1, "")
    assert out.agg(F.sum("__n_dropped")).first()[0] == 0  # rows of one doc_id are no five documents
    assert L.dedup_lines(spark, no_docs).count() == 0


def test_main_path_has_no_python(spark, sf_dir):
    plan = L.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_kept_digest(spark):
    frame = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    text = L.dedup_lines(spark, frame).first().text
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(b"a\nb").hexdigest()


@pytest.mark.parametrize("n", [4, 5])
def test_five_documents_are_the_threshold(spark, n):
    line = "exactly the same line of text, longer than forty points"
    frame = spark.createDataFrame([(i, line) for i in range(n)], "doc_id long, text string")
    kept = [r.doc_id for r in L.dedup_lines(spark, frame).where("text <> ''").collect()]
    assert sorted(kept) == (list(range(4)) if n == 4 else [4])
