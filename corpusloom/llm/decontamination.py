"""Benchmark decontamination with a BM25 index and block-max WAND.

The test items are the indexed side and every training passage is a query.  An
item's impacts are divided by what its own text would score, so the score of a
passage is the weighted share of the item that it holds, and one threshold serves
all items.  A document is read in strides; a passage is two strides, so an item no
longer than a stride lies whole in some passage.  Pruning goes from coarse to fine:
the sum over a passage's terms of the largest impact within a group of blocks, then
within a block of items, bounds every score in it (for terms of many items, also by
the most that one item has of them); only blocks whose bound reaches
the threshold are scored exactly.  What is retrieved is verified: the item's
question (all but its last sentence) and answer (its last sentence) must both
overlap with the passage in word n-grams.

The index is cut into shards of at most `shard_items` items and `shard_words`
words, of similar length, so what each task receives has a bound whatever the
benchmark's size; documents aren't shuffled.

Defined cases.  Null, empty or wordless items and texts match nothing.  Repeated
items give a row each with their item_id; documents with one doc_id are judged
row by row.  Items of one sentence end in an answer of a fifth of their words.
Very long texts are read whole.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_words = re.compile(r"\w+").findall
_sentences = re.compile(r"[^.!?\n]+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last."""
    parts = [w for s in _sentences(text) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    n = max(1, len(words) // 5)
    return words[:-n], words[-n:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Shard:
    """Items of a bounded number of words with their impacts and block bounds."""

    K1, B, BLOCK, GROUPS, COMMON = 1.2, 0.75, 16, 16, 0.02

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        counts = [Counter(words_of(t)) for _, t in items]
        self.stride = max(64, max(sum(c.values()) for c in counts))
        df = Counter(w for c in counts for w in c)
        mean = sum(sum(c.values()) for c in counts) / len(counts)
        self.vocabulary = {w: i for i, w in enumerate(sorted(df))}
        idf = {w: math.log(1 + (len(counts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        blocks = math.ceil(len(items) / self.BLOCK)
        self.bounds = np.zeros((len(df), blocks), dtype=np.float32)
        self.impacts: list[dict[int, float]] = []
        for i, c in enumerate(counts):
            norm = self.K1 * (1 - self.B + self.B * sum(c.values()) / mean)
            raw = {self.vocabulary[w]: idf[w] * n * (self.K1 + 1) / (n + norm) for w, n in c.items()}
            own = sum(raw.values())
            self.impacts.append({t: x / own for t, x in raw.items()})
            for t, x in self.impacts[-1].items():
                self.bounds[t, i // self.BLOCK] = max(self.bounds[t, i // self.BLOCK], x)
        self.width = width = math.ceil(blocks / self.GROUPS)
        coarse = np.stack([self.bounds[:, a : a + width].max(axis=1) for a in range(0, blocks, width)], axis=1)
        # Terms of many items bound little by their sum of maxima, which no single item
        # has: what they give together is also bounded by the most that one item has.
        self.common = np.array([df[w] > max(1, self.COMMON * len(items)) for w in sorted(df)])
        most = [sum(x for t, x in impacts.items() if self.common[t]) for impacts in self.impacts]
        self.most = np.array([max(most[a : a + self.BLOCK]) for a in range(0, len(items), self.BLOCK)])
        self.coarse_most = np.array([self.most[a : a + width].max() for a in range(0, blocks, width)])
        self.coarse = np.concatenate([np.where(self.common[:, None], coarse, 0), np.where(self.common[:, None], 0, coarse)], axis=1)
        self.parts = [question_answer(t) for _, t in items]

    def candidates(self, docs: list[list[str]], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, first stride of the passage, item, score) of every passage and
        item whose score reaches the threshold."""
        v, stride = len(self.vocabulary), self.stride
        lengths = np.array([len(d) for d in docs])
        strides = np.maximum(1, -(-lengths // stride))
        base = np.concatenate([[0], np.cumsum(strides)])
        total = int(base[-1])
        terms = np.array([t for d in docs for t in map(self.vocabulary.get, d, repeat(-1))], dtype=np.int64)
        inside = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chunk = np.repeat(base[:-1], lengths) + inside // stride
        known = terms >= 0
        keys = np.unique(chunk[known] * v + terms[known])
        if not len(keys):
            return
        chunk, terms = keys // v, keys % v
        heads = np.searchsorted(chunk, np.arange(total + 1))
        here = np.flatnonzero(np.diff(heads))
        coarse = np.zeros((total + 1, self.coarse.shape[1]), dtype=np.float32)
        coarse[here] = np.add.reduceat(self.coarse[terms], heads[here], axis=0)
        doc_of = np.repeat(np.arange(len(docs)), strides)
        pairs = coarse[:-1].copy()
        pairs[:-1] += np.where((doc_of[1:] == doc_of[:-1])[:, None], coarse[1:-1], 0)
        groups = len(self.coarse_most)
        pairs = np.minimum(pairs[:, :groups], self.coarse_most) + pairs[:, groups:]
        for c in np.flatnonzero((pairs >= threshold - 1e-5).any(axis=1)).tolist():
            last = c + 1 if c + 1 < total and doc_of[c + 1] == doc_of[c] else c
            mine = terms[heads[c] : heads[last + 1]]
            distinct = np.unique(mine) if last > c else mine
            held, often = None, self.common[distinct]
            for g in np.flatnonzero(pairs[c] >= threshold - 1e-5).tolist():
                fine = self.bounds[distinct, g * self.width : (g + 1) * self.width]
                bound = np.minimum(fine[often].sum(axis=0), self.most[g * self.width : (g + 1) * self.width]) + fine[~often].sum(axis=0)
                for b in np.flatnonzero(bound >= threshold - 1e-5).tolist():
                    first = (g * self.width + b) * self.BLOCK
                    for i in range(first, min(first + self.BLOCK, len(self.items))):
                        if held is None:
                            held = set(distinct.tolist())
                        score = sum(x for t, x in self.impacts[i].items() if t in held)
                        if score >= threshold:
                            yield int(doc_of[c]), int(c - base[doc_of[c]]), i, score

    def overlaps(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's 5-grams and the answer's 3-grams in a passage."""
        out = []
        for words, n in zip(self.parts[item], (5, 3), strict=True):
            want = grams(words, n) if words else set()
            size = len(next(iter(want))) if want else 1
            have = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
            out.append(len(want & have) / len(want) if want else 1.0)
        return out[0], out[1]


def shards_of(benchmark: DataFrame, item_id: str, text: str, shard_items: int, shard_words: int) -> Iterator[Shard]:
    """Shards in the order of item length; one item at a time comes to the driver."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    held, words = [], 0
    for r in rows.orderBy(F.length("t"), "i", "t").toLocalIterator():
        n = len(words_of(r.t))
        if not n:
            continue
        if held and (len(held) >= shard_items or words + n > shard_words):
            yield Shard(held)
            held, words = [], 0
        held.append((r.i, r.t))
        words += n
    if held:
        yield Shard(held)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.6,
    question: float = 0.6,
    answer: float = 0.5,
    shard_items: int = 4096,
    shard_words: int = 200_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each document and test item that it holds: HIT's columns, from
    the passage with the largest overlap."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def scan(shard: Shard):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                words = [words_of(x) for x in batch.column("text").to_pylist()]
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for d, c, i, score in shard.candidates(words, threshold):
                    q, a = shard.overlaps(i, words[d][c * shard.stride : (c + 2) * shard.stride])
                    if q >= question and a >= answer and (q + a, score) > (sum(best.get((d, i), (0, 0, 0))[1:]), best.get((d, i), (0, 0, 0))[0]):
                        best[d, i] = (score, q, a)
                ids = batch.column("doc_id")
                found = sorted(best.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d].as_py() for (d, _), _ in found], pa.int64()),
                        pa.array([shard.items[i][0] for (_, i), _ in found], pa.int64()),
                        *[pa.array([x[k] for _, x in found], pa.float64()) for k in range(3)],
                    ],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        return run

    found = [rows.mapInArrow(scan(s), HIT) for s in shards_of(benchmark, "item_id", "text", shard_items, shard_words)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HIT)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.6,
    question: float = 0.6,
    answer: float = 0.5,
    shard_items: int = 4096,
    shard_words: int = 200_000,
    text: str = "text",
) -> DataFrame:
    """The rows of `docs`, all columns as they are, that hold no test item.  A row is
    judged by its own text where it lies: ids may be null or repeat."""

    def scan(shard: Shard):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                words = [words_of(x) for x in batch.column(text).to_pylist()]
                good = [True] * batch.num_rows
                for d, c, i, _ in shard.candidates(words, threshold):
                    if good[d]:
                        q, a = shard.overlaps(i, words[d][c * shard.stride : (c + 2) * shard.stride])
                        good[d] = q < question or a < answer
                yield batch.filter(pa.array(good))

        return run

    for shard in shards_of(benchmark, "item_id", "text", shard_items, shard_words):
        docs = docs.mapInArrow(scan(shard), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
