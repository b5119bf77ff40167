"""Connected components by alternating stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node it can reach.

    Each round hangs every node's larger neighbours on its least one, then its smaller ones; the
    longest path shrinks by a factor. Edges only ever become fewer. Each round is written, so a
    lost executor costs one step. Minima are aggregated before the shuffle; the edges of a node with
    very many neighbours do meet its minimum under one key, in a join whose partitions Spark splits.
    """
    at = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    mark, step = None, 0
    while True:
        # edges point downwards, a > b, so what is less than a node stands in its own rows
        least = at.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        large = at.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        # each node has one row with its minimum, which gives the node itself
        small = large.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        step += 1
        at = scratch.written(small.distinct(), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if now == mark:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
