"""Scan budgets over file metadata, in the total order (repo_id, path).

Running sums over all files are worked out in two steps: sums of ranges of files,
then of the files within a range, so no task gets more than a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["repo_id", "path"]


def running(files: DataFrame, value: str, out: str) -> DataFrame:
    """`files` with the sum of `value` up to and including each row."""
    dealt = files.repartitionByRange(*ORDER).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("__within", F.sum(value).over(inside))
    parts = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition only
    parts = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(parts), "__part").withColumn(out, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")


def first_files(files: DataFrame, max_files: int) -> DataFrame:
    """The first files in order.  The limit is the feature."""
    return files.orderBy(*ORDER).limit(max_files)


def until_over(files: DataFrame, value: str, most: int) -> DataFrame:
    """Files before the first that would take the running sum over `most`."""
    return running(files, value, "__total").where(F.col("__total") <= most).drop("__total")


def place(row) -> Column:
    """A row's place in the order, to be compared with struct(*ORDER)."""
    return F.struct(F.lit(row.repo_id).cast("int").alias("repo_id"), F.lit(row.path).alias("path"))


def first_over(files: DataFrame, value: str, most: int):
    """The first file that takes the running sum over `most`: a row with ORDER's
    columns, or None."""
    return running(files, value, "__total").where(F.col("__total") > most).agg(F.min(F.struct(*ORDER)).alias("o")).first().o


def _any(conditions: list[Column]) -> Column:
    """Their disjunction, as a tree that isn't deep."""
    while len(conditions) > 1:
        conditions = [reduce(Column.__or__, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def greedy_condition(files: DataFrame, size: str, most: int) -> Column:
    """Which files fit one after the other: one that doesn't fit is skipped and costs
    nothing.  A round takes, of the files behind the last skipped one that are no
    larger than what is left, those before the first that goes over; that one is
    larger than what is left then.  Only that file's place and a sum leave a round,
    so the result is a filter on the files themselves.  `files` is read once a round:
    give a written table of names and sizes."""
    here, left, behind, taken = F.struct(*ORDER), most, F.lit(True), []
    while True:
        fits = behind & (F.col(size) <= left)
        over = F.col("__total") > left
        summed = running(files.where(fits), size, "__total")
        row = summed.agg(F.min(F.when(over, F.struct(*ORDER))).alias("o"), F.max(F.when(~over, F.col("__total"))).alias("used")).first()
        if row.o is None:
            return _any([*taken, fits])
        stop = place(row.o)
        taken.append(fits & (here < stop))
        left, behind = left - (row.used or 0), here > stop


def greedy_bytes(files: DataFrame, size: str, most: int) -> DataFrame:
    return files.where(greedy_condition(files, size, most))
