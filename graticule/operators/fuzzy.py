"""From neighbours to a metric graph: local normalisation, edges of neighbourhoods, merge by a t-conorm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tconorms
from ..functions.phi import Pair, phi
from ..functions.vectors import l2, total


def normalise(neighbours: DataFrame, divide: bool = True, beyond: bool = True) -> DataFrame:
    """(i, j, rank, dist) with distances local to i: less the distance of the nearest other point (beyond), by the largest (divide)."""
    w = W.partitionBy("i")
    nearest = F.max(F.when(F.col("rank") == 2, F.col("dist"))).over(w)
    moved = F.when(F.col("rank") == 1, 0.0).otherwise(F.col("dist") - F.coalesce(nearest, F.lit(0.0))) if beyond else F.col("dist")
    df = neighbours.withColumn("_d", moved)
    largest = F.max("_d").over(w)
    scaled = F.when(largest > 1e-10, F.col("_d") / largest).otherwise(F.col("_d")) if divide else F.col("_d")
    return df.withColumn("dist", scaled).drop("_d")


def star_edges(neighbours: DataFrame, directed: bool = False) -> DataFrame:
    """(owner, src, dst, dist): from each point to its neighbours and, unless directed, back."""
    there = F.struct(F.col("i").alias("src"), F.col("j").alias("dst"))
    back = F.struct(F.col("j").alias("src"), F.col("i").alias("dst"))
    ends = F.explode(F.array(there) if directed else F.array(there, back)).alias("e")
    return neighbours.where("i <> j").select(F.col("i").alias("owner"), ends, "dist").select("owner", "e.src", "e.dst", "dist")


def clique_edges(neighbours: DataFrame, metric: str = "canonical", points: DataFrame | None = None) -> DataFrame:
    """(owner, src, dst, dist) between all members of each neighbourhood. metric: canonical (by way of the owner), freed, or euclidean (needs points)."""
    own = neighbours.where("i <> j").select(F.col("i").alias("owner"), F.col("j").alias("a"), F.col("dist").alias("da"))
    other = own.select(F.col("owner"), F.col("a").alias("b"), F.col("da").alias("db"))
    pairs = own.join(other, "owner").where("a <> b")
    root2 = F.sqrt(F.lit(2.0))
    if metric == "euclidean":
        if points is None:
            raise ValueError("euclidean edges need the points")
        at = lambda name, to: points.select(F.col("id").alias(name), F.col("features").cast("array<double>").alias(to))
        # Both rays are scaled once for each end, so that no length is worked out again for each coordinate.
        ends = own.join(at("owner", "xo"), "owner").join(at("a", "xa"), "a").withColumn("length", F.greatest(l2(F.col("xa"), F.col("xo")), F.lit(1e-300)))
        rays = ends.select("owner", "a", F.zip_with("xa", "xo", lambda p, q: (p - q) * F.col("da") / F.col("length")).alias("ray"))
        pairs = pairs.join(rays, ["owner", "a"]).join(rays.select("owner", F.col("a").alias("b"), F.col("ray").alias("ray_b")), ["owner", "b"])
        between: Column = l2(F.col("ray"), F.col("ray_b"))
    else:
        between = (F.col("da") + F.col("db")) / (root2 if metric == "freed" else F.lit(1.0))
    inner = pairs.select("owner", F.col("a").alias("src"), F.col("b").alias("dst"), between.alias("dist"))
    back = F.col("dist") / root2 if metric == "freed" else F.col("dist")
    outer = neighbours.where("i <> j").select(F.col("i").alias("owner"), F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("dist").alias("d")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), back.alias("d")))).alias("e"))
    return outer.select("owner", "e.src", "e.dst", F.col("e.d").alias("dist")).unionByName(inner)


def merge(edges: DataFrame, tconorm: str = "canonical", by: str | Pair | None = None, m: float = 1.0, clique: bool = False, scale: float = 1.0, shape: float = 2.0) -> DataFrame:
    """(src, dst, dist): all contributions to an edge merged by a t-conorm. by: phi's name or a pair of functions."""
    if m <= 0:
        raise ValueError("m must be positive")
    if tconorm in tconorms.SCHEMES:
        if tconorm == "m_scheme":
            # Loops count for the largest distance: twice the largest radius in a clique.
            largest = edges.agg((F.max("dist") if not clique else F.greatest(F.max("dist"), 2 * F.max(F.when((F.col("src") == F.col("owner")), F.col("dist"))))).alias("largest"))
            return edges.crossJoin(F.broadcast(largest)).groupBy("src", "dst").agg(tconorms.m_scheme(m, F.col("largest"))(F.col("dist")).alias("dist"))
        if tconorm == "m_scheme_Hyperbolic":
            # The contribution of the smallest owner comes first, the least of several. The window's shuffle serves the aggregation too.
            edges = edges.withColumn("later", F.row_number().over(W.partitionBy("src", "dst").orderBy("owner", "dist")) > 1)
        aggregate = {"m_scheme_Wiener_Shannon": tconorms.wiener_shannon(m), "m_scheme_Composition": tconorms.composition(m), "m_scheme_Hyperbolic": tconorms.hyperbolic(F.col("later"))}[tconorm]
        return edges.groupBy("src", "dst").agg(aggregate(F.col("dist")).alias("dist"))
    if tconorm not in tconorms.WEIGHTS:
        raise ValueError(f"unknown t-conorm {tconorm!r}")
    if tconorm == "canonical" and (by is None or isinstance(by, str)):
        # The largest weight is that of the least distance, so no underflow of phi can spoil it; identity does not decrease.
        return edges.groupBy("src", "dst").agg((F.max if by == "identity" else F.min)("dist").alias("dist"))
    weight, inverse = phi(by, scale, shape)
    weights = edges.select("src", "dst", weight(F.col("dist")).alias("w"))
    if tconorm == "nilpotent maximum":
        # Spark limits each group before it shuffles, so a hub's edge sends two rows a task.
        weights = weights.withColumn("rank", F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("w")))).where("rank <= 2")
    merged = weights.groupBy("src", "dst").agg(tconorms.WEIGHTS[tconorm](F.col("w")).alias("w"))
    return merged.select("src", "dst", inverse(F.col("w")).alias("dist"))


def check(edges: DataFrame) -> DataFrame:
    """edges, after an assertion that no distance is NaN."""
    if not edges.where(F.isnan("dist")).isEmpty():
        raise ValueError("an edge has no distance (NaN)")
    return edges


def fuzzy_union(graph: DataFrame, mix: float = 1.0) -> DataFrame:
    """(src, dst, weight): a fuzzy graph united with its transpose, mix * (probabilistic sum) + (1 - mix) * product."""
    both = graph.select("src", "dst", "weight").unionAll(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    product = F.when(F.count("*") == 2, F.product("weight")).otherwise(0.0)
    return both.groupBy("src", "dst").agg((mix * (F.sum("weight") - product) + (1 - mix) * product).alias("weight"))


def smooth_weights(neighbours: DataFrame, tolerance_steps: int = 64, local_connectivity: float = 1.0, bandwidth: float = 1.0, alpha: float = 1.0) -> DataFrame:
    """(src, dst, weight): exp(-(d - alpha * rho) / sigma), sigma by bisection so that the weights of a point's neighbours add up to bandwidth * log2 k.

    rho is the distance of the local_connectivity-th neighbour that is not at 0, interpolated between two if it is no whole number; 0 with 0.
    """
    near = neighbours.groupBy("i").agg(F.sort_array(F.collect_list(F.when(F.col("i") != F.col("j"), F.col("dist")))).alias("d"), F.count("*").alias("k"))
    whole, part = int(local_connectivity), local_connectivity - int(local_connectivity)
    apart = F.filter("d", lambda x: x > 0)
    place = lambda k: F.coalesce(F.get(apart, F.least(F.lit(k), F.size(apart) - 1)), F.lit(0.0))
    rho = place(whole - 1) if whole else F.lit(0.0)
    if part:
        rho = rho + part * (place(whole) - rho)
    near = near.withColumn("rho", alpha * rho)
    target = bandwidth * F.log2(F.col("k"))
    fitted = lambda s: total(F.transform("d", lambda x: F.exp(-F.greatest(x - F.col("rho"), F.lit(0.0)) / s)))
    state = F.struct(F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(1.0).alias("mid"))

    def step(acc: Column, _: Column) -> Column:
        above = fitted(acc["mid"]) > target
        low, high = F.when(above, acc["low"]).otherwise(acc["mid"]), F.when(above, acc["mid"]).otherwise(acc["high"])
        return F.struct(low.alias("low"), high.alias("high"), F.when(high == float("inf"), acc["mid"] * 2).otherwise((low + high) / 2).alias("mid"))

    sigma = F.aggregate(F.sequence(F.lit(1), F.lit(tolerance_steps)), state, step, lambda acc: acc["mid"])
    least = 1e-3 * total(F.col("d")) / F.greatest(F.size("d"), F.lit(1))
    near = near.select("i", "rho", F.greatest(sigma, least).alias("sigma"))
    weight = F.when(F.col("dist") <= F.col("rho"), 1.0).otherwise(F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma")))
    return neighbours.where("i <> j").join(near, "i").select(F.col("i").alias("src"), F.col("j").alias("dst"), weight.alias("weight"))
