"""Duplicates in a stream of files, by Structured Streaming.

Counts of white-space-insensitive digests are streaming state: `counts` keeps them
for as long as the watermark says, and `repeated` sends each file whose content was
seen within it.  Both are plain plans, so recovery and late rows are Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.prepare import lossy


def digested(files: DataFrame) -> DataFrame:
    """`files` (repo_id, path, content, ts) with the digest of their plain text."""
    plain = text.without_blanks(lossy(F.col("content")))
    return files.withColumns({"digest": F.sha2(plain, 256), "normalized_len": F.octet_length(plain).cast("long")}).drop("content")


def counts(files: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, digest, normalized_len, n_members, first_path) per tumbling window."""
    rows = digested(files).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "digest", "normalized_len").agg(F.count(F.lit(1)).alias("n_members"), F.min("path").alias("first_path"))


def first_seen(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files whose content wasn't seen before within the watermark."""
    return digested(files).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])
