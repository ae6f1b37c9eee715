"""Seeded point sets on known shapes, as lazy DataFrames (id, features, color or label).

Draws come from the MD5 of the seed and the row's number, so they are the same for any partitioning and in any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = 2 * math.pi


def uniform(seed: int, key: Column | None = None) -> Column:
    """A number in (0, 1) for each key (by default the column id), from the first 13 hex digits of the MD5 of seed:key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("id") if key is None else key).cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / (1 << 52)


def normal(seed: int) -> Column:
    """A number from the normal distribution, by Box and Muller's rule from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed))) * F.cos(TURN * uniform(seed + 1000))


def _drawn(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    return spark.range(n).withColumns(columns)


def four_gaussians(spark: SparkSession, n: int, distance: float = 8.2, seed: int = 0) -> DataFrame:
    """Four round clouds of variance 2, round(n / 4) points each."""
    each = round(n / 4)
    df = spark.range(4 * each).withColumn("label", F.floor(F.col("id") / max(each, 1)).cast("int"))
    mean = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("label") + 1)
    x = mean([-4.0 * distance, 1.2 * distance, 0.0, 0.0]) + normal(seed) * math.sqrt(2)
    y = mean([0.0, 0.0, distance, -2.0 * distance]) + normal(seed + 1) * math.sqrt(2)
    return df.select("id", F.array(x, y).alias("features"), "label")


def moons(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Two interleaved half circles."""
    df = _drawn(spark, n, label=(F.col("id") % 2).cast("int"), t=uniform(seed) * math.pi)
    x = F.when(F.col("label") == 0, F.cos("t")).otherwise(1 - F.cos("t")) + normal(seed + 1) * noise
    y = F.when(F.col("label") == 0, F.sin("t")).otherwise(0.5 - F.sin("t")) + normal(seed + 2) * noise
    return df.select("id", F.array(x, y).alias("features"), "label")


def hemisphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Unevenly dense half of the unit sphere."""
    df = _drawn(spark, n, a=uniform(seed) * TURN, b=uniform(seed + 1) * (math.pi / 2))
    return df.select("id", F.array(F.sin("b") * F.cos("a"), F.sin("b") * F.sin("a"), F.cos("b")).alias("features"), F.col("a").alias("color"))


def torus(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    df = _drawn(spark, n, a=uniform(seed) * TURN, b=uniform(seed + 1) * TURN)
    r = 2 + F.cos("a")
    return df.select("id", F.array(r * F.cos("b"), r * F.sin("b"), F.sin("a")).alias("features"), F.col("b").alias("color"))


def swiss_roll(spark: SparkSession, n: int, hole: bool = True, seed: int = 0, turns: float | None = None, noise: float = 0.0) -> DataFrame:
    """A rolled sheet; with a hole fewer than n points. turns: the angle runs from 0 to turns * pi."""
    t = uniform(seed) * (turns * math.pi) if turns else 1.5 * math.pi * (1 + 2 * uniform(seed))
    df = _drawn(spark, n, t=t, u=uniform(seed + 1) * (60 if turns else 21))
    if hole and not turns:
        df = df.where(~((F.col("t") > 2.5 * math.pi) & (F.col("t") < 3.5 * math.pi) & (F.col("u") > 7) & (F.col("u") < 14)))
    e = lambda k: normal(seed + k) * noise if noise else F.lit(0.0)
    return df.select("id", F.array(F.col("t") * F.cos("t") + e(2), F.col("u") + e(3), F.col("t") * F.sin("t") + e(4)).alias("features"), F.col("t").alias("color"))


def s_curve(spark: SparkSession, n: int, noise: float = 0.0, hole: float = 0.0, seed: int = 0) -> DataFrame:
    """An S-shaped sheet; points within `hole` of its middle (0, 1, 0) are left out."""
    df = _drawn(spark, n, t=3 * math.pi * (uniform(seed) - 0.5), u=2 * uniform(seed + 1))
    e = lambda k: normal(seed + k) * noise if noise else F.lit(0.0)
    x, y, z = F.sin("t") + e(2), F.col("u") + e(3), F.signum("t") * (F.cos("t") - 1) + e(4)
    out = df.select("id", F.array(x, y, z).alias("features"), F.col("t").alias("color"))
    f = F.col("features")
    return out.where(f[0] * f[0] + (f[1] - 1) * (f[1] - 1) + f[2] * f[2] > hole * hole) if hole else out


def moebius(spark: SparkSession, n: int, width: float = 1.0, seed: int = 0) -> DataFrame:
    """A Moebius strip, denser towards one edge."""
    df = _drawn(spark, n, u=uniform(seed) * TURN, v=(1 - F.sqrt(1 - uniform(seed + 1))) * 2 * width - width)
    r = 1 + F.col("v") * F.cos(F.col("u") / 2)
    return df.select("id", F.array(r * F.cos("u"), r * F.sin("u"), F.col("v") * F.sin(F.col("u") / 2)).alias("features"), F.col("u").alias("color"))


def asymmetric_distances(spark: SparkSession, n: int = 5, seed: int = 42) -> DataFrame:
    """(i, j, dist): a matrix of random distances that differ by direction."""
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"), "id")
    return pairs.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(10 * uniform(seed)).alias("dist"))
