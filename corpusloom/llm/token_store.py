"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's id stream into chunks, so equal
passages give equal chunks wherever they stand.  Each distinct chunk is stored
once, under its digest; a document is a recipe, the list of its chunks' digests.
The layout of a store (all Parquet, in any folder that Spark can write):

  entries   kind 0: a chunk (key = digest, n ids, data = ids);
            kind 1: a recipe (doc_id, n ids, key = its Merkle root, data = digests)
  recipes   recipes in ascending doc_id order, with the document's start offset
            and the number of its file part
  manifest  for each part of recipes: documents, ids, first start, Merkle root

`verify` reads a store back: it checks every chunk's digest, checks
each recipe's root and each part's root, and joins CRC-32s of chunks to CRC-32s
of documents, so whole documents never move between machines.

Defined cases.  Null or empty text: only the end id.  Repeated rows give a recipe
each and share their chunks.  Rows with one doc_id follow each other, ordered by
root.  A null doc_id comes first.  An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Stage, slices, small_batches, table

DIGEST = 16
LEAST, MOST, MASK = 64, 1024, 0xFF
WINDOW = 8
ENTRY = "kind byte, key binary, n int, data binary, doc_id long, tie long"
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, size=1 << 16, dtype=np.uint32)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_points(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """Ends of the chunks of several id streams that stand one after the other, the
    i-th up to ends[i].  A chunk ends after an id where the rolling hash of the last
    WINDOW ids has its low bits clear, after at least LEAST and at most MOST ids.
    As LEAST is more than WINDOW, no cut depends on the stream before."""
    gear, rolled = _GEAR[ids & 0xFFFF], np.zeros(len(ids), dtype=np.uint32)
    for i in range(WINDOW):
        rolled[i:] += gear[: len(ids) - i] << np.uint32(i)
    rolled ^= rolled >> np.uint32(15)
    marks = np.flatnonzero((rolled & MASK) == 0) + 1
    bounds = np.searchsorted(marks, ends).tolist()
    marks, out, last, a = marks.tolist(), [], 0, 0
    for stop, b in zip(ends, bounds, strict=True):
        cuts = []
        for end in (*marks[a:b], stop):
            if end != stop and end - last < LEAST:
                continue
            while end - last > MOST:
                last += MOST
                cuts.append(last)
            if end > last:
                cuts.append(end)
                last = end
        out.append(cuts)
        last, a = stop, b
    return out


def packed(ids: np.ndarray) -> bytes:
    """A chunk as it is stored: little-endian 16-bit ids, or 32-bit ids behind an
    odd byte if some don't fit.  Parquet compresses them."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        return b"\4" + ids.astype("<u4").tobytes()
    return ids.astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype="<u4") if len(data) % 2 else np.frombuffer(data, dtype="<u2").astype("<u4")


def entries(docs: DataFrame, path: str, end_id: int, seen_most: int = 200_000) -> DataFrame:
    """Chunk and recipe rows of each document.  A task sends a chunk again only
    after it has sent `seen_most` others; the store drops such repeats."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, serial = tokens.encoder(path), set(), 0
        for batch in slices(batches, "text"):
            kind, key, size, data, doc_ids, tie = [], [], [], [], [], []

            def put(k, name, n, held, doc, number):
                kind.append(k)
                key.append(name)
                size.append(n)
                data.append(held)
                doc_ids.append(doc)
                tie.append(number)

            streams = [x + end for x in enc.encode([x or "" for x in batch.column("text").to_pylist()])]
            raw = b"".join(streams)
            ids, narrow = np.frombuffer(raw, dtype="<u4"), None
            if not len(ids) or int(ids.max()) <= 0xFFFF:
                narrow = ids.astype("<u2").tobytes()
            ends = np.cumsum([len(x) // 4 for x in streams]).tolist()
            last = 0
            for doc, cuts, stream in zip(batch.column("doc_id").to_pylist(), cut_points(ids, ends), streams, strict=True):
                recipe = []
                for stop in cuts:
                    name = digest(raw[4 * last : 4 * stop])
                    recipe.append(name)
                    if name not in seen:
                        if len(seen) >= seen_most:
                            seen.clear()
                        seen.add(name)
                        put(0, name, stop - last, packed(ids[last:stop]) if narrow is None else narrow[2 * last : 2 * stop], None, 0)
                    last = stop
                serial += 1
                put(1, merkle_root(recipe), len(stream) // 4, b"".join(recipe), doc, serial)
            types = [pa.int8(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((kind, key, size, data, doc_ids, tie), types, strict=True)], ["kind", "key", "n", "data", "doc_id", "tie"])

    return docs.mapInArrow(run, ENTRY)


def digests_of(recipe: Column) -> Column:
    """The digests that a recipe is made of, in order."""
    at = F.sequence(F.lit(0), F.floor(F.octet_length(recipe) / DIGEST).cast("int") - 1)
    return F.transform(at, lambda i: F.substring(recipe, i * DIGEST + 1, F.lit(DIGEST)))


class TokenStore:
    """A written store; `path` is its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def write(cls, spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> TokenStore:
        """Tokenize and store `docs`.  Chunks are dealt by digest and recipes by a
        number of their own, so copies of a document meet in no task."""
        self = cls(spark, path)
        rows = entries(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tokenizer or tokens.default_path(), end_id)
        rows = rows.withColumn("tie", F.when(F.col("kind") == 1, F.monotonically_increasing_id()).otherwise(0))
        first = Window.partitionBy("kind", "key", "tie").orderBy("n")
        # lag, not a rank: tasks have dropped their own repeats, so no limit before the shuffle
        rows = rows.withColumn("before", F.lag("kind").over(first)).where("before IS NULL").drop("before")
        with small_batches(spark):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/entries")

        recipes = self.read("entries").where("kind = 1").select("doc_id", F.col("n").alias("n_tokens"), F.col("key").alias("root"), F.col("data").alias("digests"))
        recipes.repartitionByRange("doc_id", "root", F.rand(7)).sortWithinPartitions("doc_id", "root").select(
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*"
        ).write.mode("overwrite").parquet(f"{path}/ordered")
        ordered = self.read("ordered")
        # One row for each file part, never for a document: the running sum over parts is small.
        parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        placed = ordered.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        placed = placed.join(F.broadcast(parts.select("part", "first")), "part")
        placed.select("part", "row", "doc_id", (F.col("first") + F.col("within")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "root", "digests").sortWithinPartitions(
            "part", "row"
        ).write.mode("overwrite").parquet(f"{path}/recipes")

        def roots(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [key[0]], "root": [merkle_root(list(part.sort_values("row")["root"]))]})

        signed = self.read("recipes").select("part", "row", "root").groupBy("part").applyInPandas(roots, "part int, root binary")
        parts.join(signed, "part").write.mode("overwrite").parquet(f"{path}/manifest")
        return self

    def chunks(self) -> DataFrame:
        return self.read("entries").where("kind = 0").select("key", "n", "data")

    def verify(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, intact) of each document, from the
        files alone.  `intact` is false if a chunk is missing, its digest, its
        length, the recipe's root or the manifest's root differs."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                crc, good = [], []
                for key, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = unpacked(data).tobytes()
                    crc.append(zlib.crc32(raw))
                    good.append(digest(raw) == key and len(raw) == 4 * n)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), pa.array(good)], ["key", "n", "crc", "good"])

        checked = self.chunks().mapInArrow(check, "key binary, n int, crc long, good boolean")

        recipes = self.read("recipes")
        uses = recipes.select("part", "row", F.posexplode(digests_of(F.col("digests"))).alias("seq", "key"))
        found = uses.join(checked, "key", "left")
        per_doc = found.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("good", F.lit(False)).alias("good")))).alias("uses"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uses = batch.column(2)
                flat, bounds = uses.flatten(), np.asarray(uses.offsets) - uses.offsets[0].as_py()
                n = np.asarray(flat.field("n")).astype(np.int64)
                crc = np.asarray(flat.field("crc")).astype(np.uint32)
                good = flat.field("good").to_numpy(zero_copy_only=False)
                keys = flat.field("key").to_pylist()
                crcs = tokens.crc_joined(crc, 4 * n, bounds[:-1])
                total = np.add.reduceat(n, bounds[:-1])
                sound = np.logical_and.reduceat(good, bounds[:-1])
                roots = [merkle_root(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs.astype(np.int64)), pa.array(total), pa.array(sound), pa.array(roots, pa.binary())], ["part", "row", "ids_crc32", "n", "sound", "made_root"])

        made = per_doc.mapInArrow(joined, "part int, row long, ids_crc32 long, n long, sound boolean, made_root binary")
        rows = recipes.select("part", "row", "doc_id", "start", "n_tokens", "root").join(made, ["part", "row"], "left")

        def part_root(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [key[0]], "now": [merkle_root(list(part.sort_values("row")["root"]))]})

        now = recipes.select("part", "row", "root").groupBy("part").applyInPandas(part_root, "part int, now binary")
        signed = self.read("manifest").join(now, "part", "left").select("part", (F.col("root") == F.col("now")).alias("signed"))
        rows = rows.join(F.broadcast(signed), "part", "left")
        intact = F.col("sound") & (F.col("n") == F.col("n_tokens")) & (F.col("made_root") == F.col("root")) & F.col("signed")
        return rows.select("doc_id", "start", "n_tokens", "ids_crc32", F.coalesce(intact, F.lit(False)).alias("intact"))

    def documents(self, doc_ids: DataFrame) -> DataFrame:
        """(doc_id, start, ids): whole id arrays of the wanted documents."""
        wanted = self.read("recipes").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        uses = wanted.select("part", "row", "doc_id", "start", F.posexplode(digests_of(F.col("digests"))).alias("seq", "key"))
        rows = uses.join(self.chunks().select("key", "data"), "key").groupBy("part", "row", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("uses"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [np.concatenate([unpacked(u["data"]) for u in uses]).astype(np.int64) for uses in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

        return rows.select("doc_id", "start", "uses").mapInArrow(run, "doc_id long, start long, ids array<bigint>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "token-store")
    store = TokenStore.write(spark, table(spark, sf_dir, "documents"), stage.path("store"))
    return store.verify()
