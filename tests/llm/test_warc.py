import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import warc as W
from corpusloom.llm.common import Stage

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(pages):
    """Rows by the contract, from the table alone."""
    out = []
    for p, _, h in pages:
        body = (h or "").encode()
        same = [q for q, _, g in pages if (g or "").encode() == body and q is not None] if len(body) >= 1000 else []
        later = p is not None and same and max(same) > p
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if later else "response", max(same) if later else None))
    return sorted(out, key=repr)


def through(spark, pages, parts=3):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts, "page_id")
    path = Stage(spark, "t").path("w")
    W.write(frame, path)
    rows = W.read(spark, path).collect()
    assert all(r.intact for r in rows)
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=repr)


def test_round_trip_with_records_inside_payloads(spark):
    big = "<p>é" * 600
    pages = [(1, "http://a/b c\r\nX: y", big), (2, None, big), (3, "http://x", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "")]
    pages += [(10, "u", FAKE), (11, "u", "x" * 2000 + FAKE * 3), (12, "u", "WARC/1.1\r\n" * 50), (13, "u", "\r\n\r\n" + FAKE), (14, "u", FAKE.rstrip()), (9, "u", "x" * 2000 + FAKE * 3)]
    pages += [(None, "u", big), (20, "u", "ends with\r\n\r\n"), (21, "u", "a\nb\rc\x00d"), (22, "u", "WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 99999999\r\n\r\n")]
    assert through(spark, pages) == brute(pages)
    assert through(spark, pages, 1) == brute(pages)


def test_small_splits_read_the_same(spark):
    pages = [(i, f"http://h/{i}", (f"page {i} " + FAKE) * (i % 7) + "z" * (i * 53 % 3000)) for i in range(120)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert through(spark, pages, 2) == brute(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pointer_jumping():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        succ = np.array([int(rng.integers(i, n)) for i in range(n)])
        want, at = {0}, 0
        while succ[at] != at:
            at = int(succ[at])
            want.add(at)
        assert set(np.flatnonzero(W.reachable(succ, 0))) == want


def test_empty_and_repeated_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = Stage(spark, "t").path("w")
    W.write(empty, path)
    assert W.read(spark, path).count() == 0
    twice = [(1, "u", "y" * 1500), (1, "u", "y" * 1500), (0, "u", "y" * 1500)]
    assert [r[3:] for r in through(spark, twice)] == [("revisit", 1), ("response", None), ("response", None)]


def test_one_page_id_with_several_contents(spark):
    a, b, c, d = ("abcd"[i] * (1500 + i) for i in range(4))
    # page 5: a copy of 9's, a content of its own, and a copy of another holder's; page 9 itself has two contents that others share
    pages = [(5, "u", a), (5, "u", b), (5, "u", c), (7, "u", c), (9, "u", a), (9, "u", d), (8, "u", d), (5, "u", "short")]
    assert through(spark, pages) == brute(pages)
    assert len(through(spark, pages, 1)) == len(pages)


def test_query_and_sql_agree(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(W.SQL).fetchall()}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in W.query(spark, sf_dir).select("*", F.lit(1)).collect()}
    assert got == want
