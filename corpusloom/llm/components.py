"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node links its larger (or smaller) neighbours, and itself,
    to the least node of its neighbourhood.  Least nodes come from an aggregate, so
    no neighbourhood is ever gathered."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # b is a neighbour of a; small star: only the smaller neighbours
    near = edges.unionByName(back) if large else edges.unionByName(back).where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if large:
        out = near.where("b > a").join(least, "a").select(F.col("b").alias("x"), "m")
    else:
        out = near.join(least, "a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    out = out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
    return out.distinct()


def components(edges: DataFrame, stage: Stage, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a, b), root being the component's least node.
    Each round is written to the shared folder; only a count and a checksum come to
    the driver."""
    spark = stage.spark
    now = stage.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen = None
    for i in range(1, rounds):
        turned = stage.write(_stars(_stars(now, True), False), f"{name}-{i}")
        stage.drop(f"{name}-{i - 1}")
        now = turned
        # every edge leads to a root: no right end is a left end
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == seen:
            break
        seen = row
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stage.write(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), name) if spark else now
