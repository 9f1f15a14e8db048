"""Sequence packing by minimum bin slack.

Whole texts are tokenized in one pass that writes only piece headers: a document
longer than a window is cut into full windows and a remainder.  Full windows are
sequences of their own; remainders are dealt by a hash into groups of bounded
size, and each group is packed on its own.  A group takes its longest remainder,
then a bitset subset-sum over the lengths that are left finds the multiset that
comes closest to the window; backtracking gives how often each length is used,
and the same multiset is repeated while its lengths last.

Defined cases.  Null or empty text: one id, the end id.  Rows are packed one by
one, so repeated rows give repeated pieces; a null doc_id is kept.  Ties between
equal lengths go by doc_id, then by content.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Stage, slices, table

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, window: int, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): windows and remainders of
    each document's ids with the end id."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in slices(batches, "text"):
            rows = []
            encoded = enc.encode([x or "" for x in batch.column("text").to_pylist()])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def closest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths, within `counts` by length, whose sum comes closest
    to `room` without passing it.  Bit s of `reach` says that sum s can be made."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        most = min(int(counts[length]), room // length)
        steps.append((length, most, reach))
        left, part = most, 1
        while left:
            part = min(part, left)
            reach |= reach << (length * part) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        for k in range(most + 1):
            if target - k * length >= 0 and before >> (target - k * length) & 1:
                if k:
                    used[length] = k
                target -= k * length
                break
    return used


def minimum_bin_slack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; every length is in 1..window."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=window + 1)
    heads = np.concatenate([[0], np.cumsum(counts)])
    taken = np.zeros(window + 1, dtype=np.int64)
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    n, longest = 0, window
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return sequence, offset
        counts[longest] -= 1
        used = closest(counts, window - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        for _ in range(min(int(counts[x]) // k for x, k in used.items())):
            at = 0
            for x, k in used.items():
                for _ in range(k):
                    i = order[heads[x] + taken[x]]
                    taken[x] += 1
                    sequence[i], offset[i] = n, at
                    at += x
            n += 1
            for x, k in used.items():
                counts[x] -= k


def pack(
    spark: SparkSession, docs: DataFrame, window: int = 2048, end_id: int = 1, path: str | None = None, group: int = 8192, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: PIECE's columns with sequence_id and offset.  The pieces
    are written once, so a lost executor costs no second tokenization and their
    number, which sets the number of groups, is known."""
    stage = Stage(spark, "packing")
    pieces = stage.write(pieces_of(docs, window, end_id, path or tokens.default_path(), doc_id, text), "pieces")
    groups = max(1, math.ceil(pieces.count() / group))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        sequence, offset = minimum_bin_slack(part["length"].to_numpy(), window)
        return part.drop(columns="grp").assign(sequence_id=int(key[0]) * 2**32 + sequence, offset=offset)

    return dealt.groupBy("grp").applyInPandas(run, f"{PIECE}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
