import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import blocks, budgets, files, prepare, spans
from corpusloom.options import InvalidOption, ScanOptions
from corpusloom.plans import report, sinks
from corpusloom.sources import tree

SNIPPET = "Seven_grey_herons_crossed_the_weir_at_0540_and_nobody_counted_them"


def fnv(values, width=4):
    h = 0xCBF29CE484222325
    for v in values:
        for b in int(v).to_bytes(width, "little"):
            h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def corpus(spark, *rows):
    """Rows (root, path, text or bytes)."""
    data = [(r, f"root{r}", p, bytearray(t.encode() if isinstance(t, str) else t)) for r, p, t in rows]
    return spark.createDataFrame(data, "repo_id int, repo_label string, path string, content binary")


def spans_of(spark, rows, params, kind="char"):
    return spans.span_groups(prepare.numbered(corpus(spark, *rows)), kind, params).orderBy("hash").collect()


def test_files_equal_but_for_blanks(spark):
    c = corpus(spark, (0, "a.txt", "a b\nc"), (0, "b.txt", "ab\tc"), (0, "c.txt", "different"), (0, "v.txt", "ab\x0bc"))
    (g,) = files.nested(c).collect()
    assert (g.hash, g.normalized_len, [f.path for f in g.files]) == ("e71fa2190541574b", 3, ["a.txt", "b.txt"])


def test_cross_root_groups_hold_members_of_one_root(spark):
    rows = [(0, "a.txt", "a b\nc"), (0, "b.txt", "ab\tc"), (1, "c.txt", "ab c"), (1, "d.txt", "x"), (0, "e.txt", "y"), (0, "f.txt", "y")]
    (g,) = files.nested(corpus(spark, *rows), True).collect()
    assert len(g.files) == 3


def test_empty_files_are_a_group(spark):
    (g,) = files.nested(corpus(spark, (0, "a", ""), (0, "b", " \n"))).collect()
    assert (g.hash, g.normalized_len) == ("cbf29ce484222325", 0)


def test_code_span_with_its_place(spark):
    rows = [(0, "A", f"first, then:\n({SNIPPET}) ends\n"), (1, "B", f"another\n\n[{SNIPPET}]; stops\n")]
    (g,) = spans_of(spark, rows, spans.SpanParams.exact(50))
    assert (g.hash, g.normalized_len, g.n_members) == (fnv(SNIPPET.encode()), len(SNIPPET), 2)
    assert [(o.start_line, o.end_line) for o in g.occurrences] == [(2, 2), (3, 3)]


def test_overlapping_repeats_of_one_file_are_dropped(spark):
    assert spans_of(spark, [(0, "A", "a" * 90)], spans.SpanParams.exact(50)) == []


def test_bucket_cap_counts_and_keeps_results(spark):
    docs = prepare.numbered(corpus(spark, (0, "A", "a" * 320), (1, "B", "a" * 320)))
    prints = spans.fingerprints(docs, "char", spans.SpanParams.exact(50))
    assert spans.truncated(prints, 512).first().dropped == 30
    kept = spans.buckets(prints, 512)
    assert kept.count() == 512
    assert {r["count"] for r in kept.groupBy("repo_id").count().collect()} == {256}


def test_line_spans_need_nine_lines(spark):
    lines = [f"line number {i} of a longer text" for i in range(12)]
    for n, want in ((8, 0), (9, 1)):
        rows = [(0, "A", "\n".join(lines[:n])), (0, "B", "\n\n".join(lines[:n]))]
        found = spans_of(spark, rows, spans.LINES, "line")
        assert len(found) == want
    assert found[0].normalized_len == 9 and [(o.start_line, o.end_line) for o in found[0].occurrences] == [(1, 9), (1, 17)]


@pytest.mark.parametrize("n", [100, 200])
def test_line_spans_go_on_beside_cut_buckets(spark, n):
    shared, own = ([f"{w} line number {i} of a longer text" for i in range(m)] for w, m in (("shared", n), ("own", 30)))
    ids = prepare.numbered(corpus(spark, *[(0, p, "") for p in "ABCDE"])).select("file_id", "path").collect()
    *_, a, b = [r.path for r in sorted(ids)]  # a cap of two keeps the shared lines of other files
    rows = [(0, p, "\n".join(shared + own if p in (a, b) else shared)) for p in "ABCDE"]
    found = spans_of(spark, rows, spans.SpanParams(2, 2, 8, max_bucket=2), "line")
    assert sorted((g.normalized_len, {o.path for o in g.occurrences} == {a, b}) for g in found) == [(n, False), (n + 30, True)]


def test_lines_are_shuffled_as_symbols(spark):
    texts = {"A": "".join(f"{i} a line of many words, which is longer than its symbol {i}\n" * 2 + "\n" * (i % 3) for i in range(50)), "B": "one", "C": " \n-\n"}
    rows = spans._packed(prepare.numbered(corpus(spark, *[(0, p, t) for p, t in texts.items()])), "line", "path").toArrow().to_pydict()
    for path, size, body in zip(rows["path"], rows["size"], rows["body"], strict=True):
        (got,), (want,) = spans._unpacked("line", pa.array([size]), pa.array([body])), prepare.read_lines([texts[path].encode()])
        at = np.arange(len(want.values))
        assert [x.tolist() for x in (got.values, got.lines(at), got.sizes)] == [x.tolist() for x in (want.values, want.lines(at), want.sizes)]
        assert size == 12 * len(at)


def test_bytes_in_common_beyond_255():
    rows = [b"x" * 300 + b"y" * 212, b"x" * 512, b"x" * 300, b"z" * 512]
    words, size = spans._words(pa.array(rows, pa.binary()))
    assert spans._common(words, size, np.array([0, 1, 0, 1]), np.array([1, 1, 2, 3])).tolist() == [300, 512, 300, 0]


def test_renamed_function_is_found_five_times(spark):
    c = corpus(spark, (0, "a.rs", "one --\nfn twice(n) { return n * 2 + n; }\n"), (1, "b.rs", "two ++\nfn other(k) { return k * 2 + k; }\n"))
    r = report.generate(c, ScanOptions(cross_repo_only=True, min_match_len=5, min_token_len=5, similarity_threshold=0.9))
    p = lambda x: 10_000 + ord(x)
    inner = [109, 1, p("*"), 2, p("+"), 1, p(";")]
    token = r.token_span_duplicates.first()
    assert (token.hash, token.normalized_len) == (fnv([114, 1, p("("), 1, p(")"), p("{"), *inner, p("}")]), 14)
    block = r.block_duplicates.first()
    assert (block.hash, block.normalized_len) == (fnv(inner), 7)
    assert r.ast_subtree_duplicates.count() == 1
    m, s = r.similar_blocks_minhash.first(), r.similar_blocks_simhash.first()
    assert (m.score, m.distance, s.score, s.distance) == (1.0, None, 1.0, 0)
    assert (m.a.path, m.b.path, m.a.start_line) == ("a.rs", "b.rs", 2)
    assert r.line_span_duplicates.count() == 0
    assert {g.preview: g.hash for g in r.code_span_duplicates.collect()} == {"return": fnv(b"return")}


def test_similar_blocks_against_all_pairs(spark, sf_dir):
    from corpusloom.plans import queries

    signed = blocks.signed_blocks(queries._identified_code(spark, sf_dir)).cache()
    rows = signed.collect()
    place = lambda r: (r.file_id, r.block)
    m = lambda a, b: sum(x == y for x, y in zip(a.minhash, b.minhash, strict=True)) / 32 >= 0.85
    s = lambda most: lambda a, b: bin((a.simhash ^ b.simhash) & (1 << 64) - 1).count("1") <= most
    bands = lambda a, b: any((a.simhash ^ b.simhash) >> 16 * i & 0xFFFF == 0 for i in range(4))
    wide = lambda a, b: s(7)(a, b) and bands(a, b)
    loose = lambda a, b: (lambda e: sum(e) >= 16 and any(all(e[4 * i : 4 * i + 4]) for i in range(8)))([x == y for x, y in zip(a.minhash, b.minhash, strict=True)])
    for like, by in ((m, blocks.Likeness.minhash(0.85)), (loose, blocks.Likeness.minhash(0.5)), (s(3), blocks.Likeness.simhash(3)), (wide, blocks.Likeness.simhash(7))):
        want = {place(a): sum(like(a, b) for b in rows if b is not a) for a in rows}
        assert {place(r): r.n_links for r in blocks.links(signed, by).collect()} == want
        assert blocks._pairs(signed, by, False).count() * 2 == sum(want.values()) > 0


def test_crowded_keys_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 4)
    rows = [(i, 0, 0, 1, 1, i % 40) for i in range(60)]  # 40 values of 6 bits: all share the upper keys
    signed = spark.createDataFrame(rows, blocks.SIGNED + ", simhash long")
    want = {r[0]: sum(bin(r[5] ^ q[5]).count("1") <= 3 for q in rows) - 1 for r in rows}
    assert {r.file_id: r.n_links for r in blocks.links(signed, blocks.Likeness.simhash(3)).collect()} == want


def test_budgets(spark):
    rows = [(0, "a", 5, 1), (0, "b", 9, 1), (0, "c", 4, 1), (1, "a", 3, 1), (1, "b", 1, 1)]
    f = spark.createDataFrame(rows, "repo_id int, path string, size long, n_chars long")
    paths = lambda d: [(r.repo_id, r.path) for r in d.orderBy("repo_id", "path").collect()]
    assert paths(budgets.greedy_bytes(f, "size", 10)) == [(0, "a"), (0, "c"), (1, "b")]
    assert paths(budgets.until_over(f, "size", 14)) == [(0, "a"), (0, "b")]
    assert paths(budgets.first_files(f, 2)) == [(0, "a"), (0, "b")]


def test_counters(spark):
    c = corpus(spark, (0, "a", "same"), (0, "b", "nul \0 inside"), (0, "c", "x" * 100), (0, "d", "same"))
    kept, stats = report.scanned(c, ScanOptions(max_file_size=50, max_files=3))
    row = stats.first()
    assert (row.candidate_files, row.scanned_files, row.skipped_binary, row.skipped_too_large, row.skipped_budget_max_files) == (4, 3, 1, 1, 1)
    assert kept.count() == 2 and report.fatal(stats)


def test_a_scan_stops_for_good(spark):
    c = corpus(spark, *[(0, f"f{i}", "abc") for i in range(6)]).cache()
    count = lambda **o: (lambda k, s: (k.count(), s.first().asDict()))(*report.scanned(c, ScanOptions(**o), report=True))
    n, s = count(max_files=2)
    assert (n, s["candidate_files"], s["scanned_files"], s["skipped_budget_max_files"]) == (2, 2, 2, 1)
    n, s = count(max_normalized_chars=7)  # the third file is read and stops the scan
    assert (n, s["candidate_files"], s["scanned_files"], s["skipped_budget_max_normalized_chars"]) == (2, 3, 3, 1)
    n, s = count(max_files=1, max_total_bytes=3)
    assert (n, s["scanned_files"], s["skipped_budget_max_total_bytes"], s["skipped_budget_max_files"]) == (1, 1, 0, 1)
    n, s = count(max_total_bytes=7)
    assert (n, s["candidate_files"], s["skipped_budget_max_total_bytes"]) == (2, 6, 4)
    n, s = count(max_tokens=4)
    assert (n, s["candidate_files"], s["skipped_budget_max_tokens"]) == (4, 5, 1)
    n, s = count(max_files=0)
    assert (n, s["candidate_files"], s["skipped_budget_max_files"]) == (0, 0, 1)
    n, s = count(max_files=6)  # recorded even if nothing was left
    assert (n, s["skipped_budget_max_files"]) == (6, 1)


def test_empty_report_has_the_columns_of_a_full_one(spark):
    c = corpus(spark, (0, "a", SNIPPET), (0, "b", SNIPPET))
    full, none = report.generate(c, ScanOptions()), report.generate(c, ScanOptions(max_report_items=0))
    for s in report.SECTIONS:
        assert none.sections[s].count() == 0
        assert [(f.name, f.dataType.simpleString()) for f in full.sections[s].schema] == [(f.name, f.dataType.simpleString()) for f in none.sections[s].schema]


@pytest.mark.parametrize("bad", [{"min_match_len": 0}, {"similarity_threshold": 2.0}, {"similarity_threshold": 2.0, "max_report_items": 0}, {"simhash_max_distance": 65}, {"min_token_len": 0}])
def test_bad_options(spark, bad):
    with pytest.raises(InvalidOption):
        report.generate(corpus(spark, (0, "a", "x")), ScanOptions(**bad))


def test_repartitioned_input_gives_the_same(spark):
    rows = [(i % 3, f"f{i}", f"{SNIPPET}{i}" * 2) for i in range(12)]
    one = spans_of(spark, rows, spans.SpanParams.exact(50))
    docs = prepare.numbered(corpus(spark, *rows).repartition(7))
    two = spans.span_groups(docs, "char", spans.SpanParams.exact(50)).orderBy("hash").collect()
    assert [(g.hash, g.occurrences) for g in one] == [(g.hash, g.occurrences) for g in two]


def write(root, **names):
    for name, body in names.items():
        path = root / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


def test_tree_ignore_files(spark, tmp_path):
    write(tmp_path, a_txt="same content", ignored_txt="same content", sub__hidden_txt="same content", target__b_txt="same content")
    (tmp_path / ".gitignore").write_text("ignored.txt\n/sub/*\n!sub/kept.txt\n")
    write(tmp_path, sub__kept_txt="other")
    paths = lambda o: sorted(p for p, _, _ in tree.listed(str(tmp_path), o).files)
    assert paths(ScanOptions()) == [".gitignore", "a.txt", "sub/kept.txt"]
    assert paths(ScanOptions(respect_gitignore=False)) == [".gitignore", "a.txt", "ignored.txt", "sub/hidden.txt", "sub/kept.txt"]


def test_tree_links_stay_inside(tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "root").mkdir()
    (tmp_path / "out" / "b.txt").write_text("same")
    (tmp_path / "root" / "a.txt").write_text("same")
    os.symlink(tmp_path / "out", tmp_path / "root" / "ext")
    os.symlink("a.txt", tmp_path / "root" / "link.txt")
    found = tree.listed(str(tmp_path / "root"), ScanOptions(follow_symlinks=True))
    assert [p for p, _, _ in found.files] == ["a.txt", "link.txt"] and found.counters["skipped_outside_root"] == 1
    assert [p for p, _, _ in tree.listed(str(tmp_path / "root"), ScanOptions()).files] == ["a.txt"]


def test_safe_paths():
    assert [tree.is_safe(p) for p in ("a.txt", "dir/file.txt", "", "../a.txt", "a/../b.txt", "./a.txt", "/etc/passwd")] == [True, True, False, False, False, False, False]


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path, r1__a_txt="a b\nc", r1__b_txt="ab\tc", r2__c_txt="ab c", r2__d_txt="different")
    roots = [str(tmp_path / "r1"), str(tmp_path / "r2")]
    assert cli.run(["--json", "--stats", "--cross-repo-only", *roots], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert [len(g["files"]) for g in said["groups"]] == [3] and said["scanStats"]["candidateFiles"] == 4
    assert cli.run(["--strict", "--max-files", "1", *roots], spark) == 1
    assert cli.run(["/no/such/root"], spark) == 1
    with pytest.raises(SystemExit) as e:
        cli.run(["--report", "--code-spans", *roots], spark)
    assert e.value.code == 2
    capsys.readouterr()
    assert cli.run(["--report", "--json", *roots], spark) == 0
    assert set(json.loads(capsys.readouterr().out)) == {sinks.camel(s) for s in report.SECTIONS}
    assert cli.run([*roots], spark) == 0
    assert "files=3" in capsys.readouterr().out


def test_text_functions(spark):
    from corpusloom.functions import text

    row = spark.createDataFrame([("a + b\n_c\n123",)], "t string").select(text.code_chars(F.col("t")).alias("c"), text.code_lines(F.col("t")).alias("l")).first()
    assert (row.c, row.l) == ("ab_c123", [1, 1, 2, 2, 3, 3, 3])
