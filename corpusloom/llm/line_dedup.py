"""Line dedup on levelled sorted runs of line hashes, in DataFrame operations only.

A run is a Parquet table sorted by line hash inside each of its partitions:
(h1, h2, n_docs, last_doc), one row per line key of one batch of documents.  A
new batch is merge-anti-joined with the runs (which keys are new?) and becomes a
run of level 0; when a level holds `fanout` runs they are merged into one run of
the next level, so a key is rewritten once per level only.  A line is identified
by two 64-bit hashes of its key.

Defined cases.  Null or empty text: one empty line.  Every row is a document;
rows with one doc_id share it as holder.  A null doc_id counts as a holder but
loses no line.  Lines with short keys always stay.  Ties cannot occur: the
largest doc_id keeps the line.  Other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = ["h1", "h2"]
SALTS = 8


def line_key(line: Column) -> Column:
    """ASCII blanks off both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2): each long line key of each document, once."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars))
    rows = docs.select(F.col(doc_id).alias("doc"), F.explode(keys).alias("key"))
    return rows.select("doc", *hashed(F.col("key")))


@dataclass
class LineRuns:
    """The levelled store. `levels[i]` names the runs of level i, newest last."""

    spark: SparkSession
    fanout: int = 2
    min_chars: int = 40
    levels: list[list[str]] = field(default_factory=list)
    made: int = 0

    def __post_init__(self):
        self.stage = Stage(self.spark, "line-runs")

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.parquet(self.stage.path(n)) for level in self.levels for n in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, runs)
        return rows.groupBy(*HASHES).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _add(self, run: DataFrame, level: int) -> str:
        name = f"run-{self.made}"
        self.made += 1
        self.stage.write(run.sortWithinPartitions(*HASHES), name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def ingest(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Add one batch. Returns its fresh keys (h1, h2, n_docs, last_doc): those
        that no earlier run holds; the others only add to what the runs count.
        The returned rows can be read until the next call, which compacts first."""
        self.compact()
        rows = occurrences(docs, doc_id, text, self.min_chars)
        stats = rows.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        if earlier := self.runs():
            known = reduce(DataFrame.unionByName, [r.select(*HASHES) for r in earlier]).withColumn("seen", F.lit(True))
            stats = stats.join(known.distinct(), HASHES, "left").select(*HASHES, "n_docs", "last_doc", F.col("seen").isNull().alias("fresh"))
        else:
            stats = stats.withColumn("fresh", F.lit(True))
        name = self._add(stats, 0)
        return self.spark.read.parquet(self.stage.path(name)).where("fresh").drop("fresh")

    def compact(self) -> None:
        """Merge each full level into one run of the next."""
        for i in range(len(self.levels)):
            if len(old := self.levels[i]) >= self.fanout:
                runs = [self.spark.read.parquet(self.stage.path(n)) for n in old]
                self.levels[i] = []
                self._add(self._merged(runs).withColumn("fresh", F.lit(False)), i + 1)
                for n in old:
                    self.stage.drop(n)

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc) over all batches."""
        if not (runs := self.runs()):
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
        return self._merged(runs) if len(runs) > 1 else runs[0].select(*HASHES, "n_docs", "last_doc")


def dedup_lines(
    spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """Drop repeated lines: each line whose key has at least `min_chars` code
    points and occurs in at least `min_docs` documents stays only in the largest
    doc_id that holds it.  Returns `docs` with its columns, `text` being the kept
    lines, and n_lines and n_dropped as `__n_lines` and `__n_dropped`.

    The documents come in `batches` batches by a hash of doc_id through the
    levelled runs.  Hot lines are counted by partial aggregates; the join of line
    occurrences with hot keys is salted, so no task gets all rows of one line.
    """
    runs = LineRuns(spark, fanout=fanout, min_chars=min_chars)
    slot = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches))
    for i in range(batches):
        runs.ingest(docs.where(slot == i), doc_id, text)
    hot = runs.counts().where(F.col("n_docs") >= min_docs).select(*HASHES, "last_doc")
    hot = hot.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    held = occurrences(docs.where(F.col(doc_id).isNotNull()), doc_id, text, min_chars)
    held = held.withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS)))
    lost = held.join(hot, [*HASHES, "salt"]).where("doc < last_doc")
    lost = lost.groupBy("doc").agg(F.collect_set(F.struct(*HASHES)).alias("__lost"))
    joined = docs.join(lost.withColumnRenamed("doc", "__doc"), F.col(doc_id) == F.col("__doc"), "left").drop("__doc")
    lines = lines_of(F.col(text))
    stays = lambda x: ~((F.char_length(line_key(x)) >= min_chars) & F.array_contains(F.col("__lost"), F.struct(*hashed(line_key(x)))))
    kept = F.when(F.col("__lost").isNull(), lines).otherwise(F.filter(lines, stays))
    out = joined.withColumns({"__n_lines": F.size(lines).cast("long"), "__kept": kept})
    out = out.withColumns({"__n_dropped": F.col("__n_lines") - F.size("__kept"), text: F.array_join("__kept", "\n")})
    return out.drop("__kept", "__lost")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, (hot.k IS NOT NULL AND doc_id < last_doc) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
