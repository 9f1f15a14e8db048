"""Repeated spans without a cap: held against all pairs of places."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusloom.functions import kernels
from corpusloom.operators import prepare, spans
from corpusloom.plans import queries


def all_pairs(files, repos, params):
    """(file, start, length) of maximal common stretches of all pairs of places."""
    at = {}
    for f, v in enumerate(files):
        for p, h in zip(*(x.tolist() for x in kernels.winnowed(v, params.k, params.w)), strict=True):
            at.setdefault(h, []).append((f, p))
    found = set()
    for places in at.values():
        for n, (f, p) in enumerate(places):
            for g, q in places[:n]:
                a, b, before, behind = files[f], files[g], 0, 0
                while before < min(p, q) and a[p - before - 1] == b[q - before - 1]:
                    before += 1
                while behind < min(len(a) - p, len(b) - q) and a[p + behind] == b[q + behind]:
                    behind += 1
                size = before + behind
                if size >= params.min_len and (f != g or abs(p - q) >= size) and not (params.cross_repo_only and repos[f] == repos[g]):
                    found |= {(f, p - before, size), (g, q - before, size)}
    return found


def random_files(rng):
    files = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 40)).astype(np.uint32) for _ in range(rng.integers(2, 8))]
    for _ in range(4):
        source, i = files[rng.integers(len(files))], rng.integers(0, 20)
        k = rng.integers(len(files))
        files[k] = np.concatenate([files[k][: rng.integers(0, 20)], source[i : i + rng.integers(0, 40)], files[k][: rng.integers(0, 9)]])
    return files


@pytest.mark.parametrize("k, w, least", [(2, 8, 2), (2, 3, 4), (1, 2, 2)])
@pytest.mark.parametrize("cross", [False, True])
def test_maximal_stretches_against_all_pairs(k, w, least, cross):
    rng, params = np.random.default_rng(k + w), spans.SpanParams(least, k, w, cross, None)
    for _ in range(30):
        files = random_files(rng)
        repos = rng.integers(0, 3, len(files))
        found = [kernels.winnowed(v, k, w) for v in files]
        file, pos, h = np.repeat(np.arange(len(files)), [len(p) for p, _ in found]), *(np.concatenate([f[i] for f in found]) for i in range(2))
        ends = np.cumsum([len(v) for v in files])
        begin, end = (ends - [len(v) for v in files])[file], ends[file]
        of = np.unique(h, return_inverse=True)[1]
        row, a, size, rest = spans.maximal(of, np.concatenate(files), begin + pos, begin, end, file, repos[file], pos, 0, 1000, params)
        assert not len(rest)
        assert set(zip(file[row].tolist(), (pos[row] - a).tolist(), size.tolist(), strict=True)) == all_pairs(files, repos, params)


def corpus_of(spark, texts):
    return prepare.numbered(spark.createDataFrame([(i % 2, f"r{i % 2}", f"{i:04}", bytearray(t.encode())) for i, t in enumerate(texts)], "repo_id int, repo_label string, path string, content binary"))


@pytest.mark.parametrize("cross", [False, True])
def test_long_and_crowded_texts_against_all_pairs(spark, cross):
    """Stretches longer than what is carried at first, copies, and more places of a
    fingerprint than the cap that other queries have."""
    rng = np.random.default_rng(5)
    words = [f"{i} a line that has its own number" for i in range(400)]
    shared = words[:150]
    texts = [shared[: rng.integers(60, 150)] + [f"{i} own {j}" for j in range(3)] for i in range(40)] + [["own 1", *shared], shared, shared, shared[:64], ["x"] * 70, ["x"] * 40]
    texts += [[f"head {i}"] * (i % 3) + words[300:309] + [f"tail {i}"] for i in range(560)]
    texts = ["\n".join(t) for t in texts]
    docs, params = corpus_of(spark, texts), spans.SpanParams(2, 2, 8, cross, None)
    names = {r.file_id: int(r.path) for r in docs.select("file_id", "path").collect()}
    got = {(names[r.file_id], r.start, r.len) for r in spans.occurrences(docs, "line", params).collect()}
    files = [s.values for s in prepare.read_lines([t.encode() for t in texts])]
    assert got == all_pairs(files, [i % 2 for i in range(len(files))], params)


@pytest.mark.parametrize("kind, least", [("char", 20), ("token", 12)])
def test_other_symbols_without_a_cap(spark, kind, least):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in "ab1+" for b in "xy(7"]
    stock = [" ".join(rng.choice(words, 60)) for _ in range(4)]
    texts = ["\n".join([*rng.choice(words, 5), *rng.choice(stock, 2)]) for _ in range(14)]
    docs, params = corpus_of(spark, texts), spans.SpanParams.exact(least, max_bucket=None)
    names = {r.file_id: int(r.path) for r in docs.select("file_id", "path").collect()}
    got = {(names[r.file_id], r.start, r.len) for r in spans.occurrences(docs, kind, params).collect()}
    files = [s.values for s in prepare.READERS[kind]([t.encode() for t in texts])]
    assert got == all_pairs(files, [0] * len(files), params) != set()


def test_line_span_groups_counts_all_places(spark, tmp_path):
    """700 documents hold the same ten lines, more than a capped bucket would keep."""
    lines = [f"shared line {i} of a longer text" for i in range(10)]
    texts = ["\n".join([f"own {i}", *lines, f"end {i}"]) for i in range(700)]
    columns = {"doc_id": pa.array(range(700), pa.int64()), "text": texts, "lang": ["en"] * 700, "source": [f"src{i % 7}" for i in range(700)], "n_chars": [len(t) for t in texts]}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    (g,) = queries.line_span_groups(spark, str(tmp_path)).collect()
    assert (g.normalized_len, g.n_members, g.n_repos, g.first_path, g.first_line) == (10, 700, 7, "00000000", 2)


def test_repeated_fingerprints_over_batches(spark):
    rng = np.random.default_rng(2)
    h = [*rng.integers(0, 60, 80).tolist(), *[99] * 30]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(int(x), 0, i, i) for i, x in enumerate(h)], "hash long, repo_id int, file_id long, pos int")
        got = sorted(r.pos for r in spans.repeated(rows).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [i for i, x in enumerate(h) if h.count(x) > 1]
