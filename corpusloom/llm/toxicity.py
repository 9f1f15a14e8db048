"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, give each word a likelihood.
Each is a chain of absolutely discounted levels: a word after its predecessor, the
word, its first six and its first four letters.  A level's discounted mass goes to
the next; below the last stand backoff counts that both models share, taken over
all documents: in how many of them does a form occur (the continuation count, with
documents as contexts).  Where neither class knows an expression the shared counts
cancel, so a rare word decides nothing by itself, and an unseen word is judged by
the beginning it shares with known ones.

A text is scored by length-normalised log-likelihood differences: the mean over
the whole text, the largest mean over windows of 32 words, and the means over the
1, 3 and 6 distinct words that speak most for toxic text.  A logistic curve, fitted on labelled rows that the models haven't seen, turns them into a
probability.

What is bounded: the classifier learns from at most `toxic_docs` and
`ordinary_docs` labelled rows (those with the smallest hash of doc_id), and the
model keeps forms that occur twice in them.  The shared counts are taken over every
document, exactly, for each form that the model keeps and those it backs off to.

Defined cases.  Null or empty text, or one without letters: the score of a text
whose differences are all 0.  Rows with one doc_id are scored each for itself.
Null doc_id: scored, never learnt from.  Without both classes among the labels the
score is the share of toxic labels (0 if there are none).  Null labels are left
out; with several labels of one doc_id the largest counts.  Columns that aren't
named are passed on; names in use are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

WORD, SIX, FOUR, PAIR = 0, 1, 2, 3
WINDOW, TOP = 32, (1, 3, 6)
_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def asked(kept: pd.DataFrame) -> list[set[str]]:
    """By level, the forms that are kept and those they back off to."""
    of = lambda level: set(kept[kept.level == level].form)
    words = of(WORD)
    sixes = of(SIX) | {w[:6] for w in words}
    return [words, sixes, of(FOUR) | {w[:4] for w in sixes}]


@dataclass
class Model:
    """Log-likelihood differences of forms, and the curve that makes a score."""

    forms: list[dict[str, float]]  # by level: class-conditional log ratio of a form
    pairs: dict[str, dict[str, float]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(TOP) + 3))
    prior: float | None = None
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def ratio(self, word: str) -> float:
        for level, form in ((WORD, word), (SIX, word[:6]), (FOUR, word[:4])):
            if (x := self.forms[level].get(form)) is not None:
                return x
        return 0.0

    def ratios(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 300_000:  # before anything is looked up: all words of a text stay in it
            memo.clear()
        got = list(map(memo.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = memo[words[i]] = self.ratio(words[i])
        if self.pairs:
            behind = words[1:]
            got[1:] = [r if after is None or (x := after.get(w)) is None else x for after, w, r in zip(map(self.pairs.get, words), behind, got[1:], strict=False)]
        return np.array(got)

    def features(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        out = np.zeros(len(TOP) + 3)
        out[-1] = 1
        if words:
            r = self.ratios(words)
            total = np.concatenate([[0.0], np.cumsum(r)])
            w = min(WINDOW, len(r))
            out[0] = (total[w:] - total[:-w]).max() / w
            out[1] = total[-1] / len(r)
            most = sorted(map(self.memo.get, set(words)), reverse=True)[: max(TOP)]
            out[2 : 2 + len(TOP)] = [sum(most[:k]) / k for k in TOP]
        return out

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def shared_counts(docs: DataFrame, text: str, forms: list[set[str]]) -> tuple[list[dict[str, int]], int]:
    """By level, how many documents hold each of `forms`, over all documents, and the
    sum over all words.  Each task adds up its own documents before anything is
    shuffled; forms that the model doesn't ask for only enter the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter(), Counter(), Counter()]
        (words, sixes, fours), (by_word, by_six, by_four) = forms, held
        total = 0
        for batch in slices(batches, "text", 16 << 20, 1 << 14):
            seen: Counter = Counter()
            for x in batch.column("text").to_pylist():
                seen.update(set(words_of(x)))
            for word, n in seen.items():
                if word in words:
                    by_word[word] += n
                if (six := word[:6]) in sixes:
                    by_six[six] += n
                if (four := word[:4]) in fours:
                    by_four[four] += n
            total += seen.total()
        rows = [(level, form, n) for level in (WORD, SIX, FOUR) for form, n in held[level].items()] + [(FOUR, None, total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int8(), pa.string(), pa.int64()), strict=True)], ["level", "form", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "level byte, form string, n long").groupBy("level", "form").agg(F.sum("n").alias("n")).toArrow()
    out: list[dict[str, int]] = [{}, {}, {}]
    total = 0
    for level, form, n in zip(*(rows.column(c).to_pylist() for c in ("level", "form", "n")), strict=True):
        if form is None:
            total = n
        else:
            out[level][form] = n
    return out, total


def class_counts(sample: DataFrame) -> DataFrame:
    """Forms of the sample with the number of documents by class that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            counts: list[Counter] = [Counter(), Counter()]
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                c = counts[toxic]
                c.update({(WORD, w) for w in words})
                c.update({(SIX, w[:6]) for w in words})
                c.update({(FOUR, w[:4]) for w in words})
                c.update({(PAIR, f"{a} {b}") for a, b in zip(words, words[1:], strict=False)})
            forms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in forms], pa.int8()), pa.array([x[1] for x in forms]), pa.array([counts[0][x] for x in forms], pa.int64()), pa.array([counts[1][x] for x in forms], pa.int64())],
                ["level", "form", "ordinary", "toxic"],
            )

    return sample.select("toxic", "text").mapInArrow(run, "level byte, form string, ordinary long, toxic long").groupBy("level", "form").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def chained(kept: pd.DataFrame, pair_rows: pa.Table, totals: pd.DataFrame, shared: list[dict[str, int]], everything: float, discounts: tuple[float, ...]) -> tuple[list[dict[str, float]], dict[str, dict[str, float]]]:
    """Log ratios of the forms that are kept, level by level from the shared counts.
    Pairs are the most; they stay in Arrow, and their words are those of the words'
    own table, so that each is one object in memory and one in the pickled model."""
    size = {(r.level, c): max(1.0, getattr(r, c)) for r in totals.itertuples() for c in ("ordinary", "toxic")}
    kinds = {(r.level, c): getattr(r, f"{c}_kinds") for r in totals.itertuples() for c in ("ordinary", "toxic")}
    everything = max(1.0, everything)
    prob: dict[str, list[dict[str, float]]] = {c: [{}, {}, {}] for c in ("ordinary", "toxic")}
    lam = {}
    for level in (WORD, SIX, FOUR):
        # The mass that backs off is pooled, so that an unseen form speaks for neither class.
        a = sum(discounts[1] * kinds.get((level, c), 0) for c in ("ordinary", "toxic")) / sum(size.get((level, c), 1.0) for c in ("ordinary", "toxic"))
        lam[level] = min(1.0, max(a, 1e-6))

    def parent(c: str, level: int, form: str) -> float:
        s = lambda k, f: max(0.5, shared[k].get(f, 0))
        if level == FOUR:
            return s(FOUR, form) / everything
        up = form[:4] if level == SIX else form[:6]
        known = prob[c][level + 1].get(up)
        known = lam[level + 1] * parent(c, level + 1, up) if known is None else known
        return known * min(1.0, s(level, form) / s(level + 1, up))

    # What one document more in the smaller class would add: less than that is no evidence.
    rare = {level: 1 / min(size.get((level, c), 1.0) for c in ("ordinary", "toxic")) for level in (WORD, SIX, FOUR)}
    out: list[dict[str, float]] = [{}, {}, {}]
    for level in (FOUR, SIX, WORD):
        rows = kept[kept.level == level]
        for form, o, t in zip(rows.form, rows.ordinary, rows.toxic, strict=True):
            for c, n in (("ordinary", o), ("toxic", t)):
                prob[c][level][form] = max(n - discounts[min(int(n), 3)], 0.0) / size[level, c] + lam[level] * parent(c, level, form)
            out[level][form] = float(np.log((prob["toxic"][level][form] + rare[level]) / (prob["ordinary"][level][form] + rare[level])))
    pairs: dict[str, dict[str, float]] = {}
    words = kept[kept.level == WORD].set_index("form")
    before = {c: words[c].to_dict() for c in ("ordinary", "toxic")}
    names = {w: w for w in prob["toxic"][WORD]}
    for batch in pair_rows.to_batches(max_chunksize=20_000):
        for form, o, t in zip(*(batch.column(c).to_pylist() for c in ("form", "ordinary", "toxic")), strict=True):
            v, w = form.split(" ")
            if w not in prob["toxic"][WORD]:
                continue
            p = {}
            for c, n in (("ordinary", o), ("toxic", t)):
                context = max(1.0, before[c].get(v, 0))
                p[c] = (max(n - discounts[min(int(n), 3)], 0.0) + discounts[1] * context * prob[c][WORD][w] + 1) / (context + 1)
            pairs.setdefault(names.setdefault(v, v), {})[names[w]] = float(np.log(p["toxic"] / p["ordinary"]))
    return out, pairs


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; the last column is the constant."""
    w = np.zeros(x.shape[1])
    keep = l2 * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + keep
        step = np.linalg.solve(h, x.T @ (p - y) + keep @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    toxic_docs: int = 4000,
    ordinary_docs: int = 8000,
    discounts: tuple[float, ...] = (0.0, 0.75, 1.2, 1.5),
    doc_id: str = "doc_id",
    text: str = "text",
) -> Model:
    """Learn from labelled documents that aren't held out."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marked = marked.groupBy(F.col(doc_id).alias("doc")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.join(docs.select(F.col(doc_id).alias("doc")).distinct(), "doc", "left_semi")
    picked = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc"), "doc").limit(n) for c, n in ((1, toxic_docs), (0, ordinary_docs))]
    ids = picked[0].unionByName(picked[1]).toPandas()
    n = ids.toxic.value_counts()
    if len(n) < 2:
        return Model([{}, {}, {}], {}, prior=float(ids.toxic.mean()) if len(ids) else 0.0)
    # At most toxic_docs + ordinary_docs pairs of numbers: a bound of 200 KB at the defaults.
    ids = docs.sparkSession.createDataFrame(ids.astype({"doc": "int64", "toxic": "int32"}))
    sample = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(ids), "doc")
    part = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc")), F.lit(4))
    counts = class_counts(sample.where(part != 0)).persist()
    try:
        kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("ordinary", "toxic")]
        totals = counts.groupBy("level").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), *kinds).toPandas()
        twice = counts.where("ordinary + toxic >= 2")
        kept = twice.where(F.col("level") != PAIR).toArrow().to_pandas().sort_values(["level", "form"])
        pair_rows = twice.where(F.col("level") == PAIR).select("form", "ordinary", "toxic").toArrow()
    finally:
        counts.unpersist()
    model = Model(*chained(kept, pair_rows, totals, *shared_counts(docs, text, asked(kept)), discounts))
    del kept, pair_rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = [model.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.where(part == 0).select("toxic", "text").mapInArrow(features, "toxic int, x array<double>").toPandas()
    rows = rows.assign(x=[tuple(v) for v in rows["x"]]).sort_values(["toxic", "x"])
    if rows.toxic.nunique() < 2:
        model.weights = np.array([0.0, 0.0, 0.5, 0.5, 0.5, -4.0])
    else:
        y = rows.toxic.to_numpy(dtype=float)
        model.weights = logistic(np.array(rows["x"].tolist()), y)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` with score (double) and predicted (int)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(x) for x in batch], dtype=float)

    out = docs.withColumn("score", run(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
