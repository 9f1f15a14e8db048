"""From a corpus to what detectors read: numbered files and their symbols."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

FILE = ["file_id", "repo_id", "repo_label", "path"]
SYMBOLS = "file_id long, repo_id int, symbols binary, lines array<int>, sizes array<int>"


def identified(corpus: DataFrame) -> DataFrame:
    """`corpus` with file_id, where it lies."""
    return corpus.withColumn("file_id", F.xxhash64("repo_id", "path"))


def numbered(corpus: DataFrame) -> DataFrame:
    """`corpus` with file_id.  It is the hash of (repo_id, path): no global order is
    needed, and it is the same in every run.  Two files share an id only if they
    share both, which a scan rules out.  Files are dealt by it, once: kernels are
    bound by CPU, and a table of a few large row groups would keep a few cores busy."""
    spark = corpus.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return identified(corpus).repartition(parts, "file_id")


def lossy(content) -> F.Column:
    """Text of bytes; what isn't UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


class Symbols(NamedTuple):
    """A file's symbols; `lines` their lines, `sizes` their characters if they differ."""

    values: np.ndarray
    lines: Callable[[np.ndarray], np.ndarray]
    sizes: np.ndarray | None = None


_CODE = np.zeros(256, dtype=bool)
_CODE[list(b"_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True


def read_chars(texts: list[bytes]) -> list[Symbols]:
    """Code characters of each text."""
    out = []
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        places = np.flatnonzero(_CODE[raw])
        out.append(Symbols(raw[places], partial(_lines_of, raw, places)))
    return out


def _lines_of(raw: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.flatnonzero(raw == 0x0A), places[at]) + 1


def read_lines(texts: list[bytes]) -> list[Symbols]:
    """Lines that have code characters: each the folded hash of those."""
    cut, numbers, sizes = [], [], []
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        code = _CODE[raw]
        line = np.cumsum(raw == 0x0A)[code]
        values = raw[code]
        heads = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        cut += np.split(values, heads[1:]) if len(heads) else []
        numbers.append(line[heads] + 1)
        sizes.append(np.diff(np.append(heads, len(line))))
    h = kernels.fnv_many(cut, 4)
    folded = ((h & np.uint64(0xFFFFFFFF)) ^ (h >> np.uint64(32))).astype(np.uint32)
    ends = np.cumsum([len(n) for n in numbers])
    return [Symbols(folded[e - len(n) : e], n.__getitem__, z) for e, n, z in zip(ends.tolist(), numbers, sizes, strict=True)]


def read_tokens(texts: list[bytes]) -> list[Symbols]:
    """Tokens; the lines only of those that are asked for."""
    if not texts:
        return []
    all_, at, newlines, heads, cuts = kernels.token_places(texts)
    before = np.searchsorted(newlines, heads).tolist()
    return [Symbols(t, partial(_lines_at, newlines, p, n)) for t, p, n in zip(np.split(all_, cuts), np.split(at, cuts), before, strict=True)]


def _lines_at(newlines: np.ndarray, places: np.ndarray, before: int, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(newlines, places[at]) - before + 1


READERS: dict[str, Callable[[list[bytes]], list[Symbols]]] = {"char": read_chars, "line": read_lines, "token": read_tokens}


def line_symbols(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, symbols, lines, sizes): lines that have code characters,
    each a folded hash of four bytes, with numbers and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slabs(whole, "body"):
                found = read_lines(bytes_of(batch.column("body")))
                numbers = [s.lines(np.arange(len(s.values))) for s in found]
                arrays = [pa.array([s.values.astype("<u4").tobytes() for s in found], pa.binary()), pa.array(numbers, pa.list_(pa.int32())), pa.array([s.sizes for s in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("repo_id"), *arrays], ["file_id", "repo_id", "symbols", "lines", "sizes"])

    return files.select("file_id", "repo_id", lossy(F.col("content")).alias("body")).mapInArrow(run, SYMBOLS)


def slabs(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` of about `most` bytes of a binary or text column, a row at
    least: kernels work on a slice at once."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    slab = np.concatenate([[0], np.cumsum(size)[:-1]]) // most if len(size) else size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(slab)) + 1, [len(size)]]).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """`rows` shuffled by `keys` and sorted in each partition by them and `order`:
    what `whole_groups` reads.  Partitions are as many as the session asks for; a
    sort spills, so a partition needn't fit into memory."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 1, .. for the groups of neighbouring rows that agree in `keys`."""
    change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for k in keys:
        v = table.column(k).to_numpy()
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.cumsum(change)]) if table.num_rows else np.zeros(0, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 50_000, thin: Callable[[pa.Table], pa.Table] | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups, of at least so many rows but the last.  `thin` may drop
    rows of a group that is still growing."""
    held: list[pa.RecordBatch] = []
    rows, goal = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= goal:
            table = pa.Table.from_batches(held).combine_chunks()
            numbers = group_numbers(table, keys)
            cut = int(np.searchsorted(numbers, numbers[-1]))
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            rest = thin(rest) if thin else rest
            held, rows = rest.to_batches(), rest.num_rows
            goal = max(least, 2 * rows)  # a large group is put together once for each doubling
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def token_symbols(files: DataFrame) -> DataFrame:
    """Tokens of each file, with their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slabs(whole, "body", 1 << 20):
                found = kernels.tokens_many(bytes_of(batch.column("body")))
                arrays = [pa.array([t.astype("<u4").tobytes() for t, _ in found], pa.binary()), pa.array([n for _, n in found], pa.list_(pa.int32())), pa.array([None] * len(found), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("repo_id"), *arrays], ["file_id", "repo_id", "symbols", "lines", "sizes"])

    return files.select("file_id", "repo_id", lossy(F.col("content")).alias("body")).mapInArrow(run, SYMBOLS)


def token_numbers(corpus: DataFrame) -> DataFrame:
    """(repo_id, path, n_tokens) of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slabs(whole, "body", 1 << 20):
                n = [len(t) for t, _ in kernels.tokens_many(bytes_of(batch.column("body")))]
                yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("path"), pa.array(n, pa.int64())], ["repo_id", "path", "n_tokens"])

    return corpus.select("repo_id", "path", lossy(F.col("content")).alias("body")).mapInArrow(run, "repo_id int, path string, n_tokens long")


def token_counts(symbols: DataFrame) -> DataFrame:
    """(token, n) over all files; a task sends one row for each token it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            counts = np.bincount(np.frombuffer(b"".join(batch.column("symbols").to_pylist()), "<u4").astype(np.int64))
            total, counts = (total, counts) if len(total) >= len(counts) else (counts, total)
            total[: len(counts)] += counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    return symbols.select("symbols").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
