"""Brace blocks: exact duplicates, subtree duplicates, MinHash and SimHash pairs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, text
from ..sources.shared import Stage
from . import prepare

BLOCK = (
    "file_id long, repo_id int, block int, parent int, depth int, start_tok int, end_tok int, start_line int, end_line int, "
    "n_tokens int, key string, hash string, tree string, tree2 string, tree_len int"
)


def blocks(tokens: DataFrame) -> DataFrame:
    """One row for each closed, non-empty block: BLOCK's columns.  `key` digests its
    inner tokens, `tree` and `tree2` are its subtree's signatures."""
    names = [x.split()[0] for x in BLOCK.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                read = [np.frombuffer(x, "<u4") for x in part.column("symbols").to_pylist()]
                found = [(t, kernels.blocks_of(t)) for t in read]
                trees = kernels.subtree_signatures(found)
                hashes = iter(kernels.fnv_many([t[s + 1 : e] for t, own in found for s, e, _, _ in own], 4).tolist())
                rows = []
                for file, repo, lines, (t, own), signatures in zip(*(part.column(n).to_pylist() for n in ("file_id", "repo_id", "lines")), found, trees, strict=True):
                    for i, ((s, e, depth, parent), sig, h) in enumerate(zip(own, signatures, hashes, strict=False)):
                        if sig:
                            key = hashlib.blake2b(t[s + 1 : e].tobytes(), digest_size=16).hexdigest()
                            rows.append((file, repo, i, parent, depth, s, e, lines[s], lines[e], e - s - 1, key, text.hex64(h), text.hex64(sig[0]), text.hex64(sig[1]), sig[2]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return tokens.select("file_id", "repo_id", "symbols", "lines").mapInArrow(run, BLOCK)


def _grouped(rows: DataFrame, files: DataFrame, keys: list[str], hash_: str, length: str, cross_repo_only: bool) -> DataFrame:
    rows = rows.join(files.select("file_id", "repo_label", "path"), "file_id")
    out = rows.groupBy(*keys).agg(
        F.first(hash_).alias("hash_"),
        F.count(F.lit(1)).alias("n_members"),
        F.countDistinct("repo_id").alias("n_repos"),
        F.sort_array(F.collect_list(F.struct("repo_id", "repo_label", "path", "start_line", "end_line"))).alias("occurrences"),
    ).where("n_members > 1")
    out = out.where("n_repos > 1") if cross_repo_only else out
    return out.select(F.col("hash_").alias("hash"), F.col(length).cast("long").alias("normalized_len"), "n_members", "n_repos", "occurrences")


def duplicate_blocks(tokens: DataFrame, files: DataFrame, min_token_len: int = 50, cross_repo_only: bool = False) -> DataFrame:
    rows = blocks(tokens).where(F.col("n_tokens") >= min_token_len)
    return _grouped(rows, files, ["key", "n_tokens"], "hash", "n_tokens", cross_repo_only)


def duplicate_subtrees(tokens: DataFrame, files: DataFrame, min_token_len: int = 50, cross_repo_only: bool = False) -> DataFrame:
    rows = blocks(tokens).where(F.col("tree_len") >= min_token_len)
    return _grouped(rows, files, ["tree", "tree_len", "tree2"], "tree", "tree_len", cross_repo_only)


def shapes(files: DataFrame) -> DataFrame:
    """(repo_id, path, n_blocks, max_depth) of files that have brace blocks: all of
    them, open and empty ones too; the outermost has depth 0.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in prepare.slabs(whole, "body", 1 << 20):
                found = [kernels.blocks_of(t) for t, _ in kernels.tokens_many(prepare.bytes_of(batch.column("body")))]
                counts = [pa.array([len(own) for own in found], pa.int64()), pa.array([max((d for _, _, d, _ in own), default=0) for own in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("path"), *counts], ["repo_id", "path", "n_blocks", "max_depth"])

    rows = files.select("repo_id", "path", prepare.lossy(F.col("content")).alias("body"))
    return rows.mapInArrow(run, "repo_id int, path string, n_blocks long, max_depth long").where("n_blocks > 0")


SIGNED = "file_id long, repo_id int, block int, start_line int, end_line int"


def signed_blocks(files: DataFrame, min_token_len: int = 50, max_depth: int = 2, size: int = 32, kinds: tuple[str, ...] = ("minhash", "simhash")) -> DataFrame:
    """SIGNED's columns and those of `kinds` (minhash array<int>, of unsigned slots;
    simhash long) of the outer blocks that are long enough for a shingle of five
    tokens.  Tokens never leave the kernel."""
    types = {"minhash": "array<int>", "simhash": "long"}
    schema = ", ".join([SIGNED, *[f"{k} {types[k]}" for k in kinds]])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = kernels.seeds(size)
        for whole in batches:
            for batch in prepare.slabs(whole, "body", 1 << 20):
                found = kernels.tokens_many(prepare.bytes_of(batch.column("body")))
                rows, first, last, at = [], [], [], 0
                for file, repo, (t, line) in zip(batch.column("file_id").to_pylist(), batch.column("repo_id").to_pylist(), found, strict=True):
                    for i, (s, e, depth, _) in enumerate(kernels.blocks_of(t)):
                        if depth <= max_depth and e - s - 1 >= max(5, min_token_len):
                            rows.append((file, repo, i, line[s], line[e]))
                            first.append(at + s + 1)
                            last.append(at + e - 4)
                    at += len(t)
                if rows:
                    bases = kernels.shingle_bases(np.concatenate([t for t, _ in found]))
                    a, b = np.array(first), np.array(last)
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                    if "minhash" in kinds:
                        slots = kernels.minhash_ranges(bases, a, b, numbers).astype(np.uint32).view(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(slots.ravel())))
                    if "simhash" in kinds:
                        columns.append(pa.array(kernels.simhash_ranges(bases, a, b).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return files.select("file_id", "repo_id", prepare.lossy(F.col("content")).alias("body")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Likeness:
    """How signatures are compared: candidates share one of several keys, and a pair
    counts at the first key that it shares, so nothing has to be made distinct.
    `least` is the share of equal slots, or the most bits that differ.  A key of
    MinHash is a set of its 8 bands of 4 slots, one of SimHash a mask."""

    value: str
    least: float
    masks: tuple[int, ...] = ()
    bands: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def minhash(cls, threshold: float, slots: int = 32) -> Likeness:
        """Pairs that share one of 8 bands and enough slots.  If so few slots may
        differ that at least 4 bands are equal, two of those lie in one of the groups
        (0 1 2), (3 4 5) and (6 7): seven keys of two bands find the same pairs."""
        differ = slots - math.ceil(threshold * slots - 1e-9)
        pairs = ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (6, 7))
        return cls("minhash", threshold, bands=pairs if differ <= 4 else tuple((i,) for i in range(8)))

    @classmethod
    def simhash(cls, most: int) -> Likeness:
        """Up to three differing bits leave two of five runs of 13 bits (the last has
        12) untouched: ten keys of 25 or 26 bits find the same pairs as four of 16,
        of which one must be untouched then.  Beyond three bits it's those four."""
        if most <= 3:
            runs = [((1 << 13) - 1) << 13 * i & (1 << 64) - 1 for i in range(5)]
            return cls("simhash", most, tuple(a | b for i, a in enumerate(runs) for b in runs[:i]))
        return cls("simhash", most, tuple(0xFFFF << 16 * i for i in range(4)))

    def rounds(self) -> list[list[F.Column]]:
        """The keys, (key, bits) each, in rounds: rows of 32 slots fill disks, so two
        of them go at a time."""
        if self.bands:
            keys = [F.xxhash64(*[F.slice("v", 4 * i + 1, F.lit(4)) for i in own]) for own in self.bands]
        else:
            keys = [F.col("v").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in self.masks]
        named = [F.struct(F.lit(i).alias("key"), k.alias("bits")) for i, k in enumerate(keys)]
        size = 2 if self.bands else len(named)
        return [named[i : i + size] for i in range(0, len(named), size)]

    def judge(self, values: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pairs i, j count at `key`, their similarity or distance)."""
        if self.bands:
            same = values[i] == values[j]
            n = same.sum(axis=1, dtype=np.int16)
            good = np.flatnonzero(n >= self.least * values.shape[1] - 1e-9)
            equal = same[good].reshape(len(good), 8, 4).all(axis=2)
            shared, value = [equal[:, own].all(axis=1) for own in self.bands], n[good] / values.shape[1]
        else:
            differs = values[i] ^ values[j]
            n = np.bitwise_count(differs)
            good = np.flatnonzero(n <= self.least)
            shared, value = [differs[good] & np.uint64(m) == 0 for m in self.masks], n[good].astype(np.float64)
        first = np.stack(shared, axis=1).argmax(axis=1) == key[good]
        return good[first], value[first]


TILE = 2048  # signatures of one key on each side of a comparison


def _classes(signed: DataFrame, by: Likeness) -> DataFrame:
    """(sig, v, n): blocks of equal signatures are one class until they are counted."""
    return signed.groupBy(F.col(by.value).alias("v")).agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("v").alias("sig"), "v", "n")


def staged(signed: DataFrame) -> DataFrame:
    """`signed` written once to the shared folder: classes, keys and blocks read it,
    and hashing costs more than reading."""
    return Stage(signed.sparkSession, "signed").write(signed, "blocks")


def _compared(classes: DataFrame, by: Likeness, links: bool, keys: list[F.Column]) -> DataFrame:
    """Pairs of different classes that `by` counts at one of `keys`, each once: (sa,
    sb, value); or with `links` (sig, links), the blocks that a class is linked to in
    part, and no pair leaves the kernel.  The signatures of a key are compared in
    tiles, however many they are: a row goes to the tiles of its part, a task gets
    two parts."""
    marked = classes.select("sig", "v", "n", F.explode(F.array(*keys)).alias("at")).select("sig", "v", "n", "at.key", "at.bits")
    sizes = marked.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / TILE).cast("int")
    rows = marked.join(sizes, ["key", "bits"]).withColumn("part", F.pmod(F.xxhash64("sig", F.lit(1)), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).drop("m")
    rows = rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other")
    group = ["key", "bits", "lo", "hi"]
    schema = "sig long, links long" if links else "sa long, sb long, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in prepare.whole_groups(batches, group):
            sig, n, part, key = (table.column(c).to_numpy() for c in ("sig", "n", "part", "key"))
            v = table.column("v").combine_chunks()
            values = v.to_numpy().view(np.uint64) if by.masks else v.flatten().to_numpy().reshape(len(sig), -1)
            crossing = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            group_of = prepare.group_numbers(table, group)
            left = np.arange(len(sig))
            found = []
            for d in range(1, len(sig)):
                left = left[left + d < len(sig)]
                left = left[group_of[left] == group_of[left + d]]
                if not len(left):
                    break
                here = left[~crossing[left] | (part[left] != part[left + d])]
                for a in range(0, len(here), 1 << 15):
                    i = here[a : a + (1 << 15)]
                    good, value = by.judge(values, i, i + d, key[i])
                    found.append((i[good], i[good] + d, value))
            if not found:
                continue
            i, j, value = (np.concatenate(x) for x in zip(*found, strict=True))
            if links:
                of, place = np.unique(np.concatenate([sig[i], sig[j]]), return_inverse=True)
                total = np.zeros(len(of), dtype=np.int64)
                np.add.at(total, place, np.concatenate([n[j], n[i]]))
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(total)], ["sig", "links"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[i], sig[j])), pa.array(np.maximum(sig[i], sig[j])), pa.array(value)], ["sa", "sb", "value"])

    columns = [*group, "sig", "v", "n", "part"]
    return prepare.dealt(rows.select(*columns), group).mapInArrow(run, schema)


def links(signed: DataFrame, by: Likeness) -> DataFrame:
    """Each block with its class_id, equal for blocks of equal signatures, and
    n_links, the number of other blocks that are similar to it, its copies included.
    Links are counted, not written as pairs: a crowd of copies is one class."""
    stage = Stage(signed.sparkSession, "links", tidy=True)
    own = stage.write(signed.withColumn("sig", F.xxhash64(by.value)), "signed")
    classes = stage.write(_classes(own, by), "classes")
    found = [stage.write(_compared(classes, by, True, keys), f"round{i}") for i, keys in enumerate(by.rounds())]
    linked = reduce(DataFrame.unionByName, found).groupBy("sig").agg(F.sum("links").alias("links"))
    counted = classes.join(linked, "sig", "left").select("sig", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return own.join(counted, "sig").select(*[x.split()[0] for x in SIGNED.split(", ")], F.col("sig").alias("class_id"), "n_links")


def _pairs(signed: DataFrame, by: Likeness, cross_repo_only: bool) -> DataFrame:
    """All pairs of similar blocks.  It has a row for each, also between copies; for
    sections of a report, which end after a few.  `links` is the form for a corpus."""
    classes = _classes(signed, by)
    equal = classes.where("n > 1").select(F.col("sig").alias("sa"), F.col("sig").alias("sb"), F.lit(0.0 if by.masks else 1.0).alias("value"))
    near = reduce(DataFrame.unionByName, [_compared(classes, by, False, keys) for keys in by.rounds()])
    turned = near.select(F.col("sb").alias("sa"), F.col("sa").alias("sb"), "value")
    near = near.unionByName(turned).unionByName(equal)
    if by.masks:
        near = near.select("sa", "sb", (1 - F.col("value") / 64.0).alias("score"), F.col("value").cast("int").alias("distance"))
    else:
        near = near.select("sa", "sb", F.col("value").alias("score"), F.lit(None).cast("int").alias("distance"))
    own = signed.withColumn("sig", F.xxhash64(by.value)).drop("minhash", "simhash")
    side = lambda s: own.select(*[F.col(c).alias(f"{c}_{s}") for c in own.columns])
    rows = near.join(side("a"), F.col("sa") == F.col("sig_a")).join(side("b"), F.col("sb") == F.col("sig_b"))
    rows = rows.where("file_id_a < file_id_b OR (file_id_a = file_id_b AND block_a < block_b)")
    rows = rows.where("repo_id_a <> repo_id_b") if cross_repo_only else rows
    return rows.drop("sa", "sb", "sig_a", "sig_b")


def minhash_pairs(signed: DataFrame, threshold: float = 0.85, cross_repo_only: bool = False) -> DataFrame:
    """Pairs whose share of equal slots reaches the threshold, from 8 bands of 4."""
    return _pairs(signed, Likeness.minhash(threshold), cross_repo_only)


def simhash_pairs(signed: DataFrame, max_distance: int = 3, cross_repo_only: bool = False) -> DataFrame:
    """Pairs within a Hamming distance that agree in one of 4 bands of 16 bits."""
    return _pairs(signed, Likeness.simhash(max_distance), cross_repo_only)
