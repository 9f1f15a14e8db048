import re

import corpus_pipeline as P
from corpusloom.llm.common import Stage


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]


def test_stages_against_brute_force(spark, sf_dir):
    from tests.llm.test_jaccard_join import brute as near
    from tests.llm.test_line_dedup import brute as lines

    docs, stage = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stage(spark, "t")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, step in P.STAGES:
        out = step(spark, docs, sf_dir)
        if name == "packing":
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == set(before)
            break
        assert out.columns == P.COLUMNS
        docs = stage.write(out, name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert 0.8 * len(before) <= len(kept[name]) < len(before) and all(before[d] == t for d, t in kept[name].items())
        elif name == "line_dedup":
            assert kept[name] == {d: t for d, (_, _, t) in lines(list(before.items())).items()}
        elif name == "jaccard_join":
            classes = near(list(before.items()))
            assert set(kept[name]) == {d for d in before if classes[d][0] == d}
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
            leaks = {d for d, t in before.items() if any(f" {plain(i)} " in f" {plain(t)} " for i in items)}
            assert set(kept[name]) == set(before) - leaks
        before = kept[name]


def test_odd_documents_pass_through(spark, odd_docs, no_docs, sf_dir):
    for start, want in ((odd_docs.select(*P.COLUMNS), 7), (no_docs.select(*P.COLUMNS), 0)):
        docs, stage = start, Stage(spark, "t")
        for name, step in P.STAGES:
            docs = stage.write(step(spark, docs, sf_dir), name)
        assert docs.select("doc_id", "start", "length").count() >= want


def test_rows_without_an_id_and_with_one_id_are_judged_by_their_texts(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    copy = " ".join(f"word{i} of a long passage" for i in range(40))
    other = " ".join(f"thing{i} in an unrelated text" for i in range(40))
    rows = [(1, copy), (1, copy), (2, other), (2, copy), (None, copy), (None, item), (3, item), (3, other + " more"), (4, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    assert found(P.drop_leaks(spark, docs, sf_dir)) == sorted(((d, t) for d, t in rows if t != item), key=repr)
    once = [(1, copy), (2, other), (3, item), (4, None), (None, "")]
    assert found(P.drop_near_copies(spark, docs, sf_dir)) == sorted(once, key=repr)
