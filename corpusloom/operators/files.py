"""Files that are equal but for white space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .prepare import lossy


def members(corpus: DataFrame, cross_repo_only: bool = False) -> DataFrame:
    """(digest, normalized_len, n_members, repo_id, repo_label, path) of each file in
    a group of two or more.  The shuffle carries a digest, never the content; group
    sizes are partial aggregates, so one huge group is no hot task there."""
    plain = text.without_blanks(lossy(F.col("content")))
    rows = corpus.select("repo_id", "repo_label", "path", F.sha2(plain, 256).alias("digest"), F.octet_length(plain).cast("long").alias("normalized_len"))
    groups = rows.groupBy("digest", "normalized_len").agg(F.count(F.lit(1)).alias("n_members"), F.min("repo_id").alias("lo"), F.max("repo_id").alias("hi")).where("n_members > 1")
    if cross_repo_only:
        groups = groups.where("lo <> hi")
    return rows.join(groups.select("digest", "normalized_len", "n_members"), ["digest", "normalized_len"])


def groups(corpus: DataFrame, cross_repo_only: bool = False) -> DataFrame:
    """(hash, normalized_len, n_members, n_repos, first_path): only one content of
    each group is hashed the slow way."""
    found = members(corpus, cross_repo_only)
    heads = found.groupBy("digest", "normalized_len", "n_members").agg(F.min(F.struct("repo_id", "path")).alias("first"), F.countDistinct("repo_id").alias("n_repos"))
    heads = heads.select("digest", "normalized_len", "n_members", "n_repos", F.col("first.repo_id").alias("repo_id"), F.col("first.path").alias("path"))
    own = corpus.select("repo_id", "path", text.without_blanks(lossy(F.col("content"))).alias("plain"))
    own = heads.join(own, ["repo_id", "path"]).dropDuplicates(["digest", "normalized_len"])
    return own.select(text.fnv_text("plain").alias("hash"), "digest", "normalized_len", "n_members", "n_repos", F.col("path").alias("first_path"))


def nested(corpus: DataFrame, cross_repo_only: bool = False) -> DataFrame:
    """(hash, normalized_len, files): files sorted by root and path."""
    heads = groups(corpus, cross_repo_only).select("digest", "normalized_len", "hash")
    files = members(corpus, cross_repo_only).groupBy("digest", "normalized_len").agg(F.sort_array(F.collect_list(F.struct("repo_id", "path", "repo_label"))).alias("files"))
    shaped = F.transform("files", lambda f: F.struct(f["repo_id"].alias("repo_id"), f["repo_label"].alias("repo_label"), f["path"].alias("path")))
    return heads.join(files, ["digest", "normalized_len"]).select("hash", "normalized_len", shaped.alias("files"))
