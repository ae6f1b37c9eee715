"""Shortest paths and connected components of metric graphs (src, dst, dist)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..plans.storage import drop, materialise, shared_dir
from .series import numbered

#: Edges up to which the graph is sent to every executor: 12 bytes each, so 144 MB at most; and distances that a search holds at once.
BROADCAST_EDGES, SEARCH_CELLS = 12_000_000, 1 << 18
#: Sources whose distances a task returns together at most, distances that it holds for that (8 bytes each), and nodes of a part.
SOURCES, HELD_CELLS, TOGETHER = 64, 8 << 20, 512
#: Pairs that are relaxed by joins at a time.
JOINED_PAIRS = 16_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations of every edge, with the least distance of the two."""
    both = edges.select("src", "dst", "dist").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    return both.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def shortest(first: np.ndarray, ends: np.ndarray, costs: np.ndarray, sources: np.ndarray, step: float) -> np.ndarray:
    """(source, node): lengths of shortest paths from some sources at once. Edges of node k are those from first[k] to first[k + 1].

    Nodes are taken in the order of their lengths, those within `step` of the least together, so few are taken more than once; only a source's own nodes are.
    """
    n = len(first) - 1
    best, degree = np.full(len(sources) * n, np.inf), np.diff(first)
    stamp = np.zeros(len(best), np.int64)
    now = np.arange(len(sources)) * n + sources
    best[now] = 0.0
    late, limit = [], step

    def once(places: np.ndarray) -> np.ndarray:
        stamp[places] = np.arange(len(places))
        return places[stamp[places] == np.arange(len(places))]

    while True:
        while len(now):
            node = now % n
            many = degree[node]
            edges = np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            to, reach = np.repeat(now - node, many) + ends[edges], np.repeat(best[now], many) + costs[edges]
            nearer = np.flatnonzero(reach < best[to])
            to, reach = to[nearer], reach[nearer]
            np.minimum.at(best, to, reach)
            to = once(to)
            soon = best[to] < limit
            late.append(to[~soon])
            now = to[soon]
        wait = np.concatenate(late)
        wait = wait[best[wait] >= limit]
        if not len(wait):
            return best.reshape(len(sources), n)
        limit = max(best[wait].min() + step, np.nextafter(best[wait].min(), np.inf))
        wait = once(wait)
        soon = best[wait] < limit
        now, late = wait[soon], [wait[~soon]]


def _joined(n: int, src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(group of each node, first, ends, costs, step) of the graph between groups of nodes that are 0 apart both ways, which have the same distances to all; see shortest()."""
    none = dist == 0
    src0, dst0 = src[none], dst[none]
    back = np.isin(src0 * n + dst0, dst0 * n + src0)
    src0, dst0 = src0[back], dst0[back]
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, src0, label[dst0])
        np.minimum.at(least, label[src0], label[dst0])
        least = least[least]
        if (least == label).all():
            break
        label = least
    group = np.unique(label, return_inverse=True)[1]
    src, dst = group[src], group[dst]
    order = np.lexsort((dist, dst, src))
    src, dst, dist = src[order], dst[order], dist[order]
    some = (src != dst) & np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))[: len(src)]
    src, dst, dist = src[some], dst[some], dist[some]
    groups = int(group.max(initial=-1)) + 1
    return group, np.searchsorted(src, np.arange(groups + 1)), dst.astype(np.int32), dist, 0.15 * float(dist.mean()) if len(dist) else 1.0


def _searcher(graph, to: int | None = None) -> Callable:
    """Tasks take groups of nodes: one search serves all sources of a group. Rows of some sources come by parts of TOGETHER nodes, so that the nodes' ids come again soon, which
    compressed files hold once; the whole list of a large graph's nodes is beyond what Snappy looks back."""
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, group, first, ends, costs, step, asked = graph.value
        members = np.flatnonzero(asked)
        members = members[np.argsort(group[members], kind="stable")]
        owners = group[members]
        at_once, most = max(1, SEARCH_CELLS // max(1, len(first) - 1)), max(1, min(SOURCES, HELD_CELLS // max(1, len(ids))))
        held: list[tuple[int, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            sources, dist = np.array([x for x, _ in held], np.int64), np.stack([x for _, x in held])
            for at in range(0, len(ids), TOGETHER):
                part = dist[:, at : at + TOGETHER]
                met = np.isfinite(part)
                row, column = np.nonzero(met)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(sources[row]), pa.array(ids[at : at + TOGETHER][column]), pa.array(part[met])], schema=schema)

        for b in batches:
            taken = b.column("id").to_numpy()
            for k in range(0, len(taken), at_once):
                for g, found in zip(taken[k : k + at_once].tolist(), shortest(first, ends, costs, taken[k : k + at_once], step), strict=True):
                    dist = (found if to is None else rounded(found, to))[group]
                    for source in ids[members[np.searchsorted(owners, g) : np.searchsorted(owners, g, "right")]].tolist():
                        held.append((source, dist))
                        if len(held) == most:
                            yield from out()
                            held.clear()
        if held:
            yield from out()

    return run


def geodesics(edges: DataFrame, sources: DataFrame | None = None, directed: bool = False, to: int | None = None) -> DataFrame:
    """(i, j, dist): lengths of shortest paths from the sources (column i; all nodes if None), rounded to `to` decimals if given. Pairs without a path are absent.

    A graph of at most BROADCAST_EDGES edges goes to all executors, and a task searches from its sources, some at once; a larger one is relaxed by joins.
    """
    graph = materialise(edges.select("src", "dst", "dist") if directed else undirected(edges), "graph")
    if graph.count() > BROADCAST_EDGES:
        nodes = graph.select(F.col("src").alias("i")).unionAll(graph.select(F.col("dst").alias("i"))).distinct()
        return relaxed(graph, nodes if sources is None else sources.select("i").distinct().join(nodes, "i", "left_semi"), to=to)
    # Both orientations of an undirected edge are one row here.
    rows = (graph if directed else graph.where("src <= dst")).toPandas()
    ids = np.unique(np.concatenate([rows["src"], rows["dst"]]).astype(np.int64))
    src, dst, dist = np.searchsorted(ids, rows["src"]), np.searchsorted(ids, rows["dst"]), rows["dist"].to_numpy(float)
    del rows
    if not directed:
        src, dst, dist = np.append(src, dst), np.append(dst, src), np.append(dist, dist)
    asked = np.ones(len(ids), bool)
    if sources is not None:
        asked = np.isin(ids, sources.select("i").distinct().toPandas()["i"].to_numpy().astype(np.int64))
    joined = _joined(len(ids), src, dst, dist)
    spark = edges.sparkSession
    sent = spark.sparkContext.broadcast((ids, *joined, asked))
    heads = np.unique(joined[0][asked])
    tasks = max(1, min(len(heads), 4 * spark.sparkContext.defaultParallelism))
    of = spark.createDataFrame(pd.DataFrame({"id": heads.astype(np.int64)}), "id long")
    return of.repartition(tasks).mapInArrow(_searcher(sent, to), "i long, j long, dist double")


def within(edges: DataFrame, labels: DataFrame, directed: bool = False, to: int | None = None) -> DataFrame:
    """(i, j, dist): lengths of shortest paths that do not leave a cluster (labels: id, cluster)."""
    a, b = (labels.select(F.col("id").alias(name), F.col("cluster").alias(f"_{name}")) for name in ("src", "dst"))
    inner = edges.join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst", "dist")
    return geodesics(inner, directed=directed, to=to)


def relaxed(graph: DataFrame, sources: DataFrame, most_rounds: int = 1000, to: int | None = None) -> DataFrame:
    """geodesics() of a directed graph (src, dst, dist) from the sources (i), each of which has a row of its own even if no edge leaves it.

    Paths are relaxed in the tasks, a group of sources at a time, as long as the graph may be sent: its paths are rows of nothing but the result then. A larger
    graph is relaxed by joins.
    """
    graph = materialise(graph.select("src", "dst", "dist"), "graph")
    sources = sources.select("i").distinct()
    if graph.count() > BROADCAST_EDGES:
        far = _by_joins(graph, sources, most_rounds)
        return far if to is None else far.withColumn("dist", F.round("dist", to) + F.lit(0.0))
    nodes = graph.select(F.col("src").alias("i")).unionAll(graph.select(F.col("dst").alias("i"))).distinct()
    alone = sources.join(nodes, "i", "left_anti").select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist"))
    return geodesics(graph, sources, directed=True, to=to).unionByName(alone)


def _by_joins(graph: DataFrame, sources: DataFrame, most_rounds: int) -> DataFrame:
    """relaxed() by joins: each round extends the paths that became shorter by one edge. Sources are taken some at a time, so that no more than JOINED_PAIRS pairs are
    on their way, and the tables of a part go before the next one begins; what stays is the result."""
    spark = graph.sparkSession
    nodes = graph.select("src").unionAll(graph.select("dst")).distinct().count()
    dealt = materialise(numbered(sources.select(F.col("i").cast("long").alias("i")), "i"), "sources")
    at_once, found = max(1, JOINED_PAIRS // max(1, nodes)), shared_dir(spark, "paths")
    for at in range(0, max(1, dealt.count()), at_once):
        part = dealt.where((F.col("_rn") >= at) & (F.col("_rn") < at + at_once))
        best = front = stored = materialise(part.select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist")), "part")
        for _ in range(most_rounds):
            longer = front.join(graph, F.col("j") == F.col("src")).select("i", F.col("dst").alias("j"), (front["dist"] + graph["dist"]).alias("dist")).groupBy("i", "j").agg(F.min("dist").alias("dist"))
            both = longer.join(best.withColumnRenamed("dist", "old"), ["i", "j"], "full")
            merged = materialise(both.select("i", "j", F.least("dist", "old").alias("dist"), (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("fresh")), "part")
            drop(stored)
            stored, front, best = merged, merged.where("fresh").select("i", "j", "dist"), merged.select("i", "j", "dist")
            if front.isEmpty():
                break
        else:
            raise RuntimeError("paths did not settle")
        best.write.mode("append").parquet(found)
        drop(stored)
    return spark.read.schema("i long, j long, dist double").parquet(found)


def filled(distances: DataFrame, points: DataFrame, diameter: float, most: float = 100.0) -> DataFrame:
    """A graph's own distances over all pairs of points (id): absent pairs get the larger of diameter and most, a point itself 0."""
    ids = points.select(F.col("id").alias("i"))
    pairs = ids.crossJoin(ids.withColumnRenamed("i", "j"))
    joined = pairs.join(distances.select("i", "j", "dist"), ["i", "j"], "left")
    return joined.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.coalesce("dist", F.lit(max(diameter, most)))).alias("dist"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): component is the smallest id that can be reached along edges (src, dst).

    Every node takes the least label around it, then the label of its label; labels halve their distance to the end each round.
    """
    ends = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    ends = materialise(ends, "ends")
    stored = now = materialise(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    for _ in range(most_rounds):
        near = ends.join(now, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("near"))
        least = now.join(near, F.col("id") == F.col("src"), "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = least.select(F.col("id").alias("label"), F.col("component").alias("further"))
        after = materialise(least.join(jump, F.col("component") == F.col("label"), "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        drop(stored)
        stored, now = after, after.select("id", "component")
        if after.where("old <> component").isEmpty():
            drop(ends)
            return now
    raise RuntimeError("components did not settle")


def symmetrised(distances: DataFrame) -> DataFrame:
    """(i, j, dist) with the mean of both orientations."""
    both = distances.select("i", "j", "dist").unionAll(distances.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    return both.groupBy("i", "j").agg(F.avg("dist").alias("dist"))


def grid_neighbours(spark, n: int, periodic: bool = False) -> DataFrame:
    """(a, b): unordered pairs of cells of an n by n grid that touch, corners included."""
    cells = spark.range(n * n).select(F.col("id").alias("a"), F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)))).alias("d"))
    x, y = F.floor(F.col("a") / n) + F.col("d.dx"), F.col("a") % n + F.col("d.dy")
    if periodic:
        x, y = F.pmod(x, F.lit(n)), F.pmod(y, F.lit(n))
    moved = cells.select("a", x.alias("x"), y.alias("y")).where(f"x BETWEEN 0 AND {n - 1} AND y BETWEEN 0 AND {n - 1}")
    b = (F.col("x") * n + F.col("y")).cast("long")
    return moved.select(F.least("a", b).alias("a"), F.greatest("a", b).alias("b")).where("a <> b").distinct()
