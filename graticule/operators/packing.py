"""Points as packed rows, equal ones taken together: what neighbour searches beyond one block work on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import materialise

_PACKED = pa.schema([("id", pa.int64()), ("data", pa.binary())])


def rows_of(column: pa.Array) -> np.ndarray:
    """A matrix of doubles from a column of binaries of one length."""
    return np.stack([np.frombuffer(v, "<f8") for v in column.to_pylist()]) if len(column) else np.zeros((0, 0))


def in_space(x: np.ndarray, metric: str) -> np.ndarray:
    """Coordinates whose euclidean distances have the order of the metric's: for cosine unit vectors, and a further axis for vectors of zeros, whose
    cosine distance to all is 1."""
    if metric == "l2":
        return x
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}; known: l2, cosine")
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    none = (norms == 0).astype(float)
    return np.hstack([x / (norms + none), none])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        features = b.column("features")
        if features.null_count:
            raise ValueError("a point has no features")
        x = features.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # one zero
        data = x.reshape(b.num_rows, -1) if b.num_rows else x.reshape(0, 0)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([row.tobytes() for row in data], pa.binary())], schema=_PACKED)


@dataclass
class Distinct:
    """points (id, data): each different vector once, under the least id of its equals; n of them. Where vectors repeat also members (id, own), own
    the id that stands for them, and least (own, ids): the k least ids of each."""

    points: DataFrame
    n: int
    members: DataFrame | None = None
    least: DataFrame | None = None


def distinct(points: DataFrame, k: int) -> Distinct:
    """Points (id, features) packed. A vector that very many points share is one row of partial sums for each task before it meets its equals."""
    typed = points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    rows = materialise(typed.mapInArrow(_pack, "id long, data binary").withColumn("key", F.unhex(F.sha2("data", 256))), "packed")
    own = materialise(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("data").alias("data"), F.count("*").alias("n")), "distinct")
    n, total = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n == total:
        return Distinct(own.select("id", "data"), n)
    several = own.where("n > 1").select("key", F.col("id").alias("own"))
    members = materialise(rows.select("id", "key").join(several, "key").select("id", "own"), "members")
    ranked = members.withColumn("_rank", F.row_number().over(W.partitionBy("own").orderBy("id"))).where(F.col("_rank") <= k)
    least = ranked.groupBy("own").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return Distinct(own.select("id", "data"), n, members, least)


def spread_out(near: DataFrame, known: Distinct, k: int) -> DataFrame:
    """(i, j, rank, dist) of all points from the neighbours (i, j, dist) of different vectors, each vector among its own: a point comes first among
    its own neighbours, then others by distance and id."""
    if known.members is None:
        order = W.partitionBy("i").orderBy(F.col("i") != F.col("j"), "dist", "j")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "j", "rank", "dist")
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("dist"))).over(W.partitionBy("i"))
    wide = near.withColumn("self", own).join(known.least, F.col("j") == F.col("own"), "left").select("i", "self", "dist", F.explode(F.coalesce("ids", F.array("j"))).alias("j"))
    # k of each vector are enough: a member leaves itself out and comes first.
    ranked = wide.withColumn("_rank", F.row_number().over(W.partitionBy("i").orderBy("dist", "j"))).where(F.col("_rank") <= k)
    lists = ranked.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("dist", "j"))).alias("near"), F.max("self").alias("self"))
    each = lists.join(known.members, F.col("i") == F.col("own"), "left").select(F.coalesce("id", "i").alias("i"), "near", "self")
    others = F.slice(F.filter("near", lambda s: s["j"] != F.col("i")), 1, k - 1) if k > 1 else F.array().cast("array<struct<dist:double,j:bigint>>")
    out = each.select("i", F.posexplode(F.concat(F.array(F.struct(F.col("self").alias("dist"), F.col("i").alias("j"))), others)).alias("rank", "s"))
    return out.select("i", F.col("s.j").alias("j"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("s.dist").alias("dist"))
