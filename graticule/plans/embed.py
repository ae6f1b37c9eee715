"""The whole way from points to embeddings, and to separated clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phi import Pair
from ..operators import clusters, eigen, evaluate, fuzzy, mds, paths, separation
from ..operators.descent import knn_descent
from ..operators.knn import knn, top_k
from ..operators.pivots import knn_pivots
from .storage import materialise

#: Neighbour searches by name: (points, k) to (i, j, rank, dist).
SEARCHES: dict[str, Callable[[DataFrame, int], DataFrame]] = {"blocks": knn, "pivots": knn_pivots, "descent": knn_descent}


def build_graph(
    data: DataFrame, k: int, normalise: bool = True, beyond: bool = True, distances: bool = False, directed: bool = False, tconorm: str = "canonical",
    metric: str = "canonical", phi: str | Pair | None = None, star: bool = True, m: float = 1.0, pca: int | None = None, scale: float = 1.0, shape: float = 2.0, search: str = "blocks",
) -> DataFrame:
    """(src, dst, dist): the merged metric graph of points (id, features) or, with distances, of a table (i, j, dist). k counts the point itself.

    search: how neighbours are found, exactly by all blocks or by pivots, or nearly all of them by descent, whose work grows with the points only.
    """
    if distances:
        near = top_k(data, k)
    else:
        near = SEARCHES[search](evaluate.pca(data, pca) if pca else data, k)
    near = materialise(near, "neighbours")
    if phi == "uniform" and not normalise and not distances:
        scale = data.agg(F.max(F.array_max("features"))).first()[0]
    local = fuzzy.normalise(near, normalise, beyond)
    edges = fuzzy.star_edges(local, directed) if star else fuzzy.clique_edges(local, metric, None if distances else data)
    return fuzzy.merge(edges, tconorm, phi, m, clique=not star, scale=scale, shape=shape)


def distance_table(data: DataFrame, k: int, geodesic: bool = False, directed: bool = False, dijkstra: bool = True, most: float = 100.0, **options) -> DataFrame:
    """(i, j, dist): geodesic distances; pairs without a path are absent. A table that is geodesic already (geodesic) is only made symmetric."""
    if geodesic:
        return paths.symmetrised(data)
    graph = materialise(build_graph(data, k, directed=directed, **options), "graph")
    if dijkstra:
        return paths.geodesics(graph, directed=directed)
    points = graph.select(F.col("src").alias("id")).unionAll(graph.select(F.col("dst").alias("id"))).distinct()
    return paths.filled(graph.select(F.col("src").alias("i"), F.col("dst").alias("j"), "dist"), points, graph.agg(F.max("dist")).first()[0] or 0.0, most)


def means(data: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, pos, x): the mean of each coordinate of each component (labels: id, component)."""
    return data.join(labels, "id").select("component", F.posexplode("features").alias("pos", "x")).groupBy("component", "pos").agg(F.avg("x").alias("x"))


def _means(data: DataFrame, labels: DataFrame) -> pd.DataFrame:
    return means(data, labels).groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean")).orderBy("component").toPandas()


def _landmark_table(data: DataFrame, k: int, n: int = 0, directed: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph's components (id, component), the landmarks of each (id, component), and geodesic distances (i, j, dist) of all points i to the
    landmarks j of theirs."""
    graph = materialise(build_graph(data, k, directed=directed, **options), "graph")
    nodes = graph.select(F.col("src").alias("id")).unionAll(graph.select(F.col("dst").alias("id"))).distinct()
    labels = materialise(paths.components(nodes, graph), "labels")
    marks = materialise(mds.landmark_ids(labels, n), "landmarks")
    from_marks = paths.geodesics(graph, marks.select(F.col("id").alias("i")), directed=directed)
    return labels, marks, materialise(from_marks.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"), "distances")


#: Ways of scaling: in one task, by landmarks, by joins.
WAYS = ("dense", "landmarks", "joins")


def embed(data: DataFrame, k: int, d: int, metric: bool = True, distances: bool = False, split: bool = True, sgd: dict | None = None, init: str | DataFrame = "classical", way: str | None = None, landmarks: int = 0, made: tuple[DataFrame, DataFrame, DataFrame] | None = None, **options) -> DataFrame:
    """(id, component, init, embedding, way) of points, or of a distance table.

    Components are scaled by themselves and moved by the scaled means of their points (added once, to both). Without split a graph of several
    components is an error.
    way: dense, each component in one task, at most mds.DENSE points of it, from an init of classical, spectral, random, or a table (id, init);
    landmarks, by geodesics from some points of each component only
    (landmarks of them, mds.LANDMARKS if 0), see mds.by_landmarks; joins, by all geodesics and no task that holds a component, see
    eigen.classical_by_joins and mds.descend_by_joins. Without a way, data of up to mds.DENSE points
    go the dense way, more points by landmarks and larger tables by joins. The column way says which one it was. By landmarks and by joins the
    initialisation is classical; by landmarks dijkstra and geodesic have no meaning. made: what _landmark_table() has made of the same data, k and options, so that
    several d need one search.
    """
    size = (data.select("i").distinct() if distances else data).count()
    way = way or ("dense" if size <= mds.DENSE else "joins" if distances else "landmarks")
    if way not in WAYS:
        raise ValueError(f"unknown way {way!r}; known: {', '.join(WAYS)}")
    if way != "dense" and init != "classical":
        raise ValueError(f"the way by {way} starts from classical scaling")
    if way == "landmarks":
        if options.pop("geodesic", False) or not options.pop("dijkstra", True):
            raise ValueError("landmarks need geodesics")
        options.pop("most", None)
        labels, _, table = made or _landmark_table(data, k, landmarks, distances=distances, **options)
    else:
        table = materialise(distance_table(data, k, distances=distances, **options), "distances")
        labels = materialise(table.groupBy("i").agg(F.min("j").alias("component")).withColumnRenamed("i", "id"), "labels")
    n = labels.select("component").distinct().count()
    if n > 1 and not split:
        raise ValueError(f"the graph has {n} components; raise k, or split it")
    if way == "landmarks":
        out = mds.by_landmarks(table, labels, d, metric, **(sgd or {}))
    elif way == "dense":
        out = mds.embed_components(table, labels, d, metric, init, **(sgd or {}))
    else:
        out = _by_joins(table, labels, d, metric, sgd or {})
    out = out.withColumn("way", F.lit(way))
    if n == 1 or distances:
        return out
    centre = _means(data, labels)
    x = np.stack(centre["mean"].map(np.asarray))
    centres = x if x.shape[1] == d else mds.classical(((x[:, None] - x[None]) ** 2).sum(-1), d)
    moves = data.sparkSession.createDataFrame([(int(c), [float(v) for v in y]) for c, y in zip(centre["component"], centres, strict=True)], "component long, move array<double>")
    add = lambda c: F.zip_with(c, "move", lambda a, b: a + b).alias(c)
    return out.join(F.broadcast(moves), "component").select("id", "component", add("init"), add("embedding"), "way")


def _by_joins(table: DataFrame, labels: DataFrame, d: int, metric: bool, sgd: dict) -> DataFrame:
    """embed_components() of components of any size: those beyond mds.DENSE points one after the other by joins, the others as they are."""
    sizes = labels.groupBy("component").count()
    large = [r["component"] for r in sizes.where(F.col("count") > (mds.DENSE if sizes.count() > 1 else 0)).collect()]  # no more than points / DENSE
    small = labels.where(~F.col("component").isin(large))
    out = None if small.isEmpty() else mds.embed_components(table.join(small.select(F.col("id").alias("i")), "i", "left_semi"), small, d, metric)
    for component in large:
        own = labels.where(F.col("component") == component).select(F.col("id").alias("i"))
        part = materialise(table.join(own, "i", "left_semi"), "distances")
        start = materialise(eigen.classical_by_joins(part, d), "init")
        end = mds.descend_by_joins(part, start, d, **sgd) if metric else start.select("id", F.col("init").alias("embedding"))
        done = start.join(end, "id").select("id", F.lit(component).cast("long").alias("component"), "init", "embedding")
        out = done if out is None else out.unionByName(done)
    return out


def isomap(data: DataFrame, k: int = 15, d: int = 2) -> DataFrame:
    """Classical scaling of geodesic distances over raw neighbour distances, of a connected graph."""
    return embed(data, k, d, metric=False, split=False, normalise=False, beyond=False)


@dataclass
class ClusterEmbedding:
    """points (id, cluster, x, y), medoids (cluster, medoid, x, y), losses of the separation, and the medoids' paths."""

    points: DataFrame
    medoids: DataFrame
    losses: list[float]
    paths: np.ndarray


def cluster_embed(data: DataFrame, k: int, n_clusters: int | None = 10, distances: bool = False, cluster: Callable[[DataFrame], DataFrame] | None = None, together: bool = True, **options) -> ClusterEmbedding:
    """Points clustered by average linkage of geodesic distances (or by a function of the table of them), scaled to the plane, and clusters moved
    apart.

    together: all points are scaled at once; else each cluster by itself, in one task, and put where its medoid stands when medoids are scaled by
    their distances.
    Points (not tables) beyond mds.DENSE go by landmarks, together only: these are clustered, every other point has the cluster of the nearest one,
    and medoids are landmarks. The
    graph must be connected then. Only hulls and the points nearest other clusters' medoids reach the driver.
    """
    by = cluster or (lambda t: clusters.linkage_clusters(t, n_clusters))
    if not distances and data.count() > mds.DENSE:
        if not together:
            raise ValueError("beyond mds.DENSE points clusters are scaled together, by landmarks")
        components, marks, to_marks = _landmark_table(data, k, **options)
        if components.select("component").distinct().count() > 1:
            raise ValueError("the graph has several components; raise k")
        table = materialise(to_marks.join(marks.select(F.col("id").alias("i")), "i", "left_semi"), "distances")
        of_marks = materialise(by(table), "labels")
        nearest = to_marks.join(F.broadcast(of_marks.withColumnRenamed("id", "j")), "j").groupBy("i").agg(F.min_by("cluster", F.struct("dist", "j")).alias("cluster"))
        labels = materialise(nearest.withColumnRenamed("i", "id"), "labels")
        placed = mds.by_landmarks(to_marks, components, 2, metric=False)
        middle = materialise(clusters.medoids(table, of_marks), "medoids")
    else:
        table = materialise(distance_table(data, k, distances=distances, **options), "distances")
        labels = materialise(by(table), "labels")
        middle = materialise(clusters.medoids(table, labels), "medoids")
        own = labels.select("id", (F.lit(0) if together else F.col("cluster")).cast("long").alias("component"))
        placed = mds.embed_components(table if together else clusters.within(table, labels).select("i", "j", "dist"), own, 2, metric=False)
    placed = materialise(placed.select("id", F.col("init")[0].alias("x"), F.col("init")[1].alias("y")).join(labels, "id"), "placed")
    # Clusters are few: a row each, and some thousand points near each other one, go to the driver.
    medoid = middle.join(placed.select(F.col("id").alias("medoid"), "x", "y"), "medoid").select("cluster", "medoid", "x", "y").orderBy("cluster").toPandas()
    ids, names = medoid["medoid"].to_numpy(), medoid["cluster"].tolist()
    chosen = table.join(F.broadcast(middle.select(F.col("medoid").alias("i"))), "i").join(F.broadcast(middle.select(F.col("medoid").alias("j"))), "j").toPandas()
    apart = np.zeros((len(ids), len(ids)))
    order = np.argsort(ids)
    apart[order[np.searchsorted(ids[order], chosen["i"])], order[np.searchsorted(ids[order], chosen["j"])]] = chosen["dist"]
    spark = data.sparkSession
    if not together:
        medoid[["x", "y"]] = mds.classical(((apart + apart.T) / 2) ** 2, 2)
        steps = spark.createDataFrame(medoid.rename(columns={"x": "mx", "y": "my"})[["cluster", "mx", "my"]])
        placed = materialise(placed.join(F.broadcast(steps), "cluster").select("id", "cluster", (F.col("x") + F.col("mx")).alias("x"), (F.col("y") + F.col("my")).alias("y")), "placed")
    others = spark.createDataFrame(medoid.rename(columns={"cluster": "other", "x": "mx", "y": "my"})[["other", "mx", "my"]])
    near = separation.nearest_points(placed, others).select("cluster", "id", "x", "y").distinct().orderBy("cluster", "id").toPandas()
    corners = clusters.hulls(placed).orderBy("cluster", "corner").toPandas()
    of = lambda rows, c: rows.loc[rows["cluster"] == c, ["x", "y"]].to_numpy().reshape(-1, 2)
    done = separation.separate([of(near, c) for c in names], medoid[["x", "y"]].to_numpy(), apart, [of(corners, c) for c in names])
    moves = medoid[["cluster", "x", "y"]].rename(columns={"x": "mx", "y": "my"})
    moves["tx"], moves["ty"] = (done.medoids - medoid[["x", "y"]].to_numpy()).T
    moves["angle"] = 0.0
    medoid[["x", "y"]] = done.medoids
    shifted = separation.moved(placed, spark.createDataFrame(moves)).select("id", "cluster", "x", "y")
    return ClusterEmbedding(shifted, spark.createDataFrame(medoid[["cluster", "medoid", "x", "y"]]), done.losses, done.paths)
