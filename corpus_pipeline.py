"""A training corpus from `documents`: five stages, each an operator of corpusloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept.  All but the last return the columns of `documents`, with texts as far as they
were rewritten and n_chars to match; the last returns the packed sequences' pieces.

Defined cases.  Null and empty texts are kept by every filtering stage: they have no
words and no lines.  A null doc_id is judged like any other row.  Rows with one doc_id
are judged one by one, by their texts; line_dedup counts them as one document.  Other
columns than those of `documents` are dropped.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from corpusloom.llm.common import Stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  Labels are those of the corpus."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents share stay in one of them.  A document that
    loses all its lines stays, with an empty text."""
    out = line_dedup.dedup_lines(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays, that with the smallest doc_id
    (a null is the largest).  Rows are numbered once, so that doc_ids may be null or
    repeat: of equal rows one stays, and another text under a doc_id is another row.
    Documents without words are no copies of each other."""
    stage = Stage(spark, "pipeline")
    rows = stage.write(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    classes = jaccard_join.near_duplicates(spark, rows, doc_id="row").where("n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    named = stage.write(classes.join(rows.select("row", "doc_id"), "row"), "classes")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    gone = named.join(first, "class_id").where("row <> first.row").select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their doc_id."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# No SQL has the tokenizer, the language models or the forest; the tests hold each
# stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
