"""Corpora from tables.  A corpus is (repo_id int, repo_label string, path string,
content binary); operators take nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root for each source of `documents`, one file for each document."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(
        F.substring("source", 4, 10).cast("int").alias("repo_id"),
        F.col("source").alias("repo_label"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"),
    )


def as_code(docs: DataFrame) -> DataFrame:
    """Prose turned into brace code: a function with a nested block for each line."""
    plain = F.translate(F.decode("content", "utf-8"), "aeiou\"'#/", "+-*=;    ")
    code = F.concat(F.lit("function f(x) {\nif (x) {"), F.replace(plain, F.lit("\n"), F.lit("}\nif (x) {")), F.lit("}\n}\n"))
    return docs.withColumn("content", F.encode(code, "utf-8"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select(F.lit(0).alias("repo_id"), F.lit("pages").alias("repo_label"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
