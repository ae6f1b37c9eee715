"""Connected components of a graph that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that can be reached.

    Large-star and small-star steps in turn: each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest. Rounds grow with the logarithm of the longest path. Each round is one table in the shared folder, so a
    lost executor costs a round at most. Both orders of an edge, loops and repeated edges are allowed.
    """
    spark = edges.sparkSession
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.select("v", "u").unionAll(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m"))
        large = both.join(least, F.col("v") == F.col("c")).where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "c")
        hung = large.join(least, F.col("v") == F.col("c")).select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e")).select("e.*")
        before, now = now, materialise(hung.where("v <> u").distinct(), "edges")
        after = _mark(now)
        remove(spark, before.stored_at)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A count and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
