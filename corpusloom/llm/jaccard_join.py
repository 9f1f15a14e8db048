"""Near-duplicate documents: Jaccard join of word 5-grams with a MinHash LSH forest.

Each of `trees` trees orders the documents by a signature of its own, a sequence of
MinHash labels; documents that share a prefix are a node of its prefix trie.  The
matched prefix starts at `deepest` labels and is shortened until a pair at the
threshold is found, by chance of the hashes, with the target recall.  (A node of a
shorter prefix holds those of the longer, so only the last depth is looked up.)

Documents with equal word sequences are collapsed before that.  Nodes are never
expanded into pairs: they give star edges, whose components (clusters) say which
texts have to meet.  A cluster's texts are split into blocks of bounded size; two
blocks meet in one task, which compares exact shingle sets of all pairs that share
a node and returns, for each text, its number of links and one edge towards its
group.  The components of those edges are the classes.

Shingles are 64-bit hashes of five successive words (\\w+, lower-cased); a text of
one to four words is one shingle.

Defined cases.  Null, empty and wordless texts have no shingles: those that equal
each other as stripped texts are copies, and null or blank ones are linked with
nothing.  Repeated rows are copies of each other.  Null doc_ids are allowed; a
class without any doc_id has class_id null.  Ties don't matter: class_id is the
smallest doc_id of the class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, slices, table
from .components import components

SHINGLE = 5
BLOCK = 256
BROADCAST_ROWS = 500_000
_words = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0xD6E8FEB86659FD93, i, 2**64) for i in range(SHINGLE)], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def recall(similarity: float, depth: int, trees: int) -> float:
    """Chance that a pair shares a prefix of `depth` labels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def adapted_depth(threshold: float, target: float, trees: int, deepest: int) -> int:
    """The longest prefix that reaches the target recall at the threshold."""
    depth = deepest
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


class Shingler:
    """Shingle hashes of several texts at once; word hashes are kept."""

    def __init__(self, most: int = 400_000):
        self.known: dict[str, int] = {}
        self.most = most

    def _hashes(self, words: list[str]) -> list[int]:
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > self.most:
                self.known.clear()
                got = [None] * len(words)
            for i, x in enumerate(got):
                if x is None:
                    w = words[i]
                    got[i] = self.known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return got

    def shingles(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts): those of text i are hashes[starts[i]:starts[i + 1]], in
        the order of the text, with repeats."""
        flat: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, words in enumerate(texts):
            if words:
                got = self._hashes(words)
                if len(got) < SHINGLE:
                    got = got + [0] * (SHINGLE - len(got))
                flat += got
                counts[i] = len(got)
        w = np.array(flat, dtype=np.uint64)
        n = max(0, len(w) - SHINGLE + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(SHINGLE):
            h += w[j : j + n] * _POWERS[j]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        ends = np.cumsum(counts)
        inside = np.ones(n, dtype=bool)
        for j in range(1, SHINGLE):  # shingles that would run into the next text
            at = ends - j
            inside[at[(at >= 0) & (at < n) & (counts > 0)]] = False
        sizes = np.where(counts > 0, counts - SHINGLE + 1, 0)
        return h[inside], np.concatenate([[0], np.cumsum(sizes)])


class Forest:
    """MinHash labels of all trees."""

    def __init__(self, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = rng.integers(0, 2**31, trees * depth).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, trees * depth).astype(np.uint32)

    def prefixes(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """[text, tree]: a 64-bit name of the prefix; texts without shingles give 0."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        full = np.flatnonzero(np.diff(starts) > 0)
        out = np.zeros((len(starts) - 1, self.trees), dtype=np.uint64)
        if not len(full):
            return out
        heads = starts[:-1][full]
        for t in range(self.trees):
            name = np.full(len(full), t + 1, dtype=np.uint64)
            for d in range(self.depth):
                k = t * self.depth + d
                label = np.minimum.reduceat(x * self.a[k] + self.b[k], heads)
                name = (name ^ label.astype(np.uint64)) * _MIX
                name ^= name >> np.uint64(31)
            out[full, t] = name
        return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def signed(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, h1, h2, key, names): one row per document.  `key` names its word
    sequence (null: a blank text), `names` its prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            words = [words_of(x) for x in texts]
            names = forest.prefixes(*shingler.shingles(words))
            keys = []
            for text, w in zip(texts, words, strict=True):
                said = " ".join(w) if w else (text or "").strip()
                keys.append(hashlib.blake2b((b"w" if w else b"t") + said.encode("utf-8", "surrogatepass"), digest_size=16).digest() if said else None)
            sent = [r.tobytes() if w else None for r, w in zip(names, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(keys, pa.binary()), pa.array(sent, pa.binary())], ["doc_id", "h1", "h2", "key", "names"])

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long, key binary, names binary")


def with_shingles(rows: DataFrame) -> DataFrame:
    """Replaces `text` by its distinct shingle hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text"):
            hashes, starts = shingler.shingles([words_of(x) for x in batch.column("text").to_pylist()])
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            columns = [batch.column(n) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], [n for n in batch.schema.names if n != "text"] + ["shingles"])

    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(run, f"{kept}, shingles binary")


def linked(sets: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of at least the threshold."""
    i, j = pairs
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 2 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    else:  # count common shingles of all pairs by products of blocks of the incidence matrix
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        often = np.bincount(at, minlength=len(values)) > 1
        place = np.cumsum(often) - 1
        owner, at = owner[often[at]], place[at[often[at]]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for first in range(0, int(often.sum()), 8192):
            a, b = np.searchsorted(at, [first, first + 8192])
            part = np.zeros((len(sets), 8192), dtype=np.float32)
            part[owner[a:b], at[a:b] - first] = 1
            common += part @ part.T
        both = common[i, j]
    return both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9


def verify(trees: int, threshold: float):
    """Task of two blocks: (rep, links, root) of each text that has a link there."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        order = np.argsort(part.column("rep").to_numpy(), kind="stable")
        part = part.take(pa.array(order))
        rep, block, copies = (part.column(n).to_numpy() for n in ("rep", "block", "copies"))
        names = np.frombuffer(b"".join(part.column("names").to_pylist()), dtype=np.uint64).reshape(len(rep), trees)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("shingles").to_pylist()]
        share = np.zeros((len(rep), len(rep)), dtype=bool)
        for t in range(trees):
            share |= names[:, t][:, None] == names[:, t][None, :]
        if lo != hi:
            share &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(share, 1))
        good = linked(sets, (i, j), threshold) if len(i) else np.zeros(0, dtype=bool)
        i, j = i[good], j[good]
        links = np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
        root = np.arange(len(rep))
        while len(i):  # least member of each group, by hooking and jumping
            low = np.minimum(root[i], root[j])
            now = root.copy()
            np.minimum.at(now, root[i], low)
            np.minimum.at(now, root[j], low)
            while (now[now] != now).any():
                now = now[now]
            if (now == root).all():
                break
            root = now
        used = np.flatnonzero(links)
        return pa.table({"rep": rep[used], "links": links[used].astype(np.int64), "root": rep[root[used]]})

    return run


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    threshold: float = 0.8,
    target: float = 0.999,
    trees: int = 18,
    deepest: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (smallest doc_id of the class),
    n_links (documents linked with it, its copies included) and n_copies (copies of
    its word sequence, itself included)."""
    stage = Stage(spark, "jaccard")
    depth = adapted_depth(threshold, target, trees, deepest)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("text"), "text")})
    one = stage.write(signed(rows, Forest(trees, depth)), "signed")

    # One representative per word sequence; every column is an aggregate with map-side combine.
    reps = one.where("key IS NOT NULL").groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h1", "h2")).alias("at"), F.min("names").alias("names")
    )
    reps = stage.write(reps.select(F.monotonically_increasing_id().alias("rep"), "key", "copies", "least", "at.doc_id", "at.h1", "at.h2", "names"), "reps")

    # Trie nodes with two members or more, as edges from each member to the least one.
    width = 8
    node = F.xxhash64("tree", F.substring(F.col("names"), F.col("tree") * width + 1, F.lit(width)))
    member = reps.where("names IS NOT NULL").select("rep", "names", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("rep", node.alias("node"))
    nodes = member.groupBy("node").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = member.join(nodes.select("node", "head"), "node").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    clusters = components(edges, stage, "clusters").select(F.col("node").alias("rep"), F.col("root").alias("cluster"))

    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    placed = clusters.join(sizes, "cluster").select("rep", "cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    wanted = stage.write(placed.join(reps.select("rep", "copies", "names", "doc_id", "h1", "h2"), "rep"), "wanted")
    # Few texts are in clusters.  Their addresses go to the documents if they are a
    # bounded number; if not, both sides are shuffled.
    address = wanted.select("rep", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("no"), "h1", "h2")
    if address.count() <= BROADCAST_ROWS:
        address = F.broadcast(address)
    found = rows.withColumns({"d": F.coalesce("doc_id", F.lit(-1)), "no": F.col("doc_id").isNull()}).select("d", "no", "h1", "h2", "text")
    texts = with_shingles(found.join(address, ["d", "no", "h1", "h2"]).select("rep", "text")).dropDuplicates(["rep"])
    members = stage.write(texts.join(wanted.select("rep", "cluster", "blocks", "block", "copies", "names"), "rep"), "members")

    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
    links = met.groupBy("cluster", "lo", "hi").applyInArrow(verify(trees, threshold), "rep long, links long, root long")
    links = stage.write(links, "links")
    classes = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), stage, "classes")
    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    graph = classes.withColumnRenamed("node", "rep").join(totals, "rep", "left")
    graph = graph.join(reps.select("rep", "least"), "rep")
    heads = graph.groupBy("root").agg(F.min("least").alias("class_id"))
    graph = graph.join(heads, "root").select("rep", "class_id", "links")
    state = reps.select("rep", "key", "copies", "least").join(graph, "rep", "left")
    state = state.select("key", "copies", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Only texts that have company are joined; all other documents are their own class.
    state = state.where("n_links > 0")
    out = one.select("doc_id", "key").join(state, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
