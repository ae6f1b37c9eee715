"""Minimum spanning forests of graphs, and what follows from them: single linkage, its cuts, and the components that a growing threshold leaves.

Boruvka's rounds: every component takes the lightest edge that leaves it, components that these edges join become one, and of parallel edges between
two of them the
lightest stays. Each round halves the components at least, so rounds grow with the logarithm of the points. A round is a few joins and groupings of
what is left of
the graph; a component with very many edges sends one edge from each task.

Edges are ordered by length, then by the ids of their ends, so the forest is the same for any partitioning. Single linkage of the geodesic distances
of a graph is that of
its edges, because a path is never shorter than an edge on it: no table of all pairs is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import drop, materialise


#: Rows of two ids, some 24 bytes each, that are sent to every executor at most.
SENT = 500_000


def _roots(hooks: DataFrame, small: bool, most_rounds: int = 64) -> DataFrame:
    """(c, root) from hooks (c, to): each component points to the one that its lightest edge leads to. Two that point to each other are the root of
    all that leads there, under the lesser name."""
    sent = F.broadcast if small else (lambda t: t)
    back = hooks.select(F.col("c").alias("_c"), F.col("to").alias("_to"))
    met = hooks.join(sent(back), F.col("to") == F.col("_c"))
    now = materialise(met.select("c", F.when((F.col("_to") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")), "roots")
    for _ in range(most_rounds):
        one = now.select(F.col("c").alias("_c"), F.col("root").alias("_r"))
        two = one.select(F.col("_c").alias("_d"), F.col("_r").alias("_s"))
        # Each jump follows three steps at once.
        jumped = now.join(sent(one), F.col("root") == F.col("_c")).join(sent(two), F.col("_r") == F.col("_d")).select("c", F.col("root").alias("old"), F.col("_s").alias("root"))
        after = materialise(jumped, "roots")
        settled = after.where("old <> root").isEmpty()
        drop(now)
        now = after
        if settled:
            return now
    raise RuntimeError("components did not settle")


def _rounds(edges: DataFrame, most_rounds: int = 64) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(lightest, roots) of each of Boruvka's rounds: the edge (dist, a, b) that each component c takes, and the component (root) that it is part of
    then; both are sent where there are few. The graph gets smaller with each."""
    own = edges.where("src <> dst AND dist IS NOT NULL AND NOT isnan(dist)").select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b"), F.col("dist").cast("double").alias("dist"))
    left = own.groupBy("a", "b").agg(F.min("dist").alias("dist")).select(F.col("a").alias("x"), F.col("b").alias("y"), "dist", "a", "b")
    left = materialise(left, "edges")
    for _ in range(most_rounds):
        ends = F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("to")), F.struct(F.col("y").alias("c"), F.col("x").alias("to")))).alias("e")
        lightest = left.select(ends, F.struct("dist", "a", "b").alias("s")).groupBy("e.c").agg(F.min(F.struct("s.dist", "s.a", "s.b", "e.to")).alias("s"))
        hooks = materialise(lightest.select("c", "s.dist", "s.a", "s.b", "s.to"), "lightest")
        n = hooks.count()
        if not n:
            return
        stored = _roots(hooks.select("c", "to"), n <= SENT)
        roots = F.broadcast(stored.select("c", "root")) if n <= SENT else stored.select("c", "root")
        yield hooks, roots
        x, y = (roots.select(F.col("c").alias(e), F.col("root").alias(f"r{e}")) for e in ("x", "y"))
        x, y = (F.broadcast(t) if n <= SENT else t for t in (x, y))
        moved = left.join(x, "x").join(y, "y").where("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"), F.struct("dist", "a", "b").alias("s"))
        after = materialise(moved.groupBy("x", "y").agg(F.min("s").alias("s")).select("x", "y", "s.dist", "s.a", "s.b"), "edges")
        drop(left)
        left = after
        if left.isEmpty():
            return
    raise RuntimeError("the forest did not settle")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, dist), a < b: the edges of the minimum spanning forest of a graph (src, dst, dist), whose edges count in both directions. Loops and
    repeated edges are allowed, null or NaN distances are not edges."""
    out = None
    for hooks, _ in _rounds(edges):
        chosen = hooks.select("a", "b", "dist")
        out = chosen if out is None else out.unionByName(chosen)
    if out is None:
        return edges.sparkSession.createDataFrame([], "a long, b long, dist double")
    return out.distinct()


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges (a, b, dist) connect a node (id) with, by the same rounds."""
    labels = nodes.select(F.col("id").cast("long").alias("id")).distinct().withColumn("component", F.col("id"))
    for _, roots in _rounds(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "dist")):
        labels = materialise(labels.join(roots, F.col("component") == F.col("c"), "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return labels.join(least, "component").select("id", F.col("least").alias("component"))


def cut_at(nodes: DataFrame, forest: DataFrame, height: float) -> DataFrame:
    """(id, component): single linkage of nodes (id) cut at a height: what edges of that length at most connect, under the least id."""
    return linked(nodes, forest.where(F.col("dist") <= height))


def deaths(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """(birth, death, n): classes of connected components of a growing neighbourhood, born at 0; those that never end have no death. n of each."""
    ends = forest.groupBy(F.col("dist").alias("death")).agg(F.count("*").alias("n"))
    dead = forest.agg(F.count("*").alias("dead"))
    for_ever = nodes.distinct().agg(F.count("*").alias("all")).crossJoin(F.broadcast(dead)).select(F.lit(None).cast("double").alias("death"), (F.col("all") - F.col("dead")).alias("n")).where("n > 0")
    return ends.unionByName(for_ever).select(F.lit(0.0).alias("birth"), "death", "n")


def betti_curve(nodes: DataFrame, forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, components): how many components edges of a threshold's length at most leave."""
    n = nodes.distinct().agg(F.count("*").alias("all"))
    counts = forest.agg(*(F.count(F.when(F.col("dist") <= t, 1)).alias(f"n{k}") for k, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.col("all") - F.col(f"n{k}")).alias("components")) for k, t in enumerate(thresholds)))).alias("r")
    return n.crossJoin(F.broadcast(counts)).select(rows).select("r.*")


def longest_edges(forest: DataFrame, n: int) -> list[tuple[float, int, int]]:
    """The n longest edges (dist, a, b), longest first; of equal ones those of larger ids."""
    return [(r["dist"], r["a"], r["b"]) for r in forest.orderBy(F.desc("dist"), F.desc("a"), F.desc("b")).limit(n).collect()]


def chosen_k(forest: DataFrame, trees: int, by: str = "elbow", most: int = 15) -> int:
    """How many clusters single linkage has, from the heights of its last `most` merges: elbow, before the largest drop from one height to the next,
    or inconsistency, before the largest height over the mean of the two below it. trees: components of the graph, which are clusters at least."""
    heights = [e[0] for e in longest_edges(forest, most + 2)]
    if len(heights) < 2:
        return max(trees, 1)
    if by == "elbow":
        score = [a - b for a, b in zip(heights, heights[1:])]
    elif by == "inconsistency":
        score = [h / max(sum(heights[k + 1 : k + 3]) / len(heights[k + 1 : k + 3]), 1e-300) for k, h in enumerate(heights[:-1])]
    else:
        raise ValueError(f"unknown rule {by!r}; known: elbow, inconsistency")
    score = score[: max(1, most - 1)]
    return trees + 1 + score.index(max(score))


def single_linkage(nodes: DataFrame, edges: DataFrame, k: int | None = 10, by: str = "elbow", most: int = 15) -> DataFrame:
    """(id, cluster): single linkage of nodes (id) over a graph (src, dst, dist), or over the geodesics of it, cut in k clusters, or in as many as a
    rule says. Clusters are numbered from 1 by their least ids.

    Components of the graph are never joined, so there are as many clusters at least. k - components of the longest edges are cut, of equal ones those
    of larger ids first.
    """
    nodes = materialise(nodes.select(F.col("id").cast("long").alias("id")).distinct(), "nodes")
    forest = materialise(spanning_forest(edges), "forest")
    n, kept = nodes.count(), forest.count()
    trees = n - kept
    k = k or chosen_k(forest, trees, by, most)
    cuts = longest_edges(forest, max(0, min(k, n) - trees))
    if cuts:
        # What is shorter than the shortest cut edge stays, and so do those of its length with lesser ids.
        d, a, b = cuts[-1]
        forest = forest.where((F.col("dist") < d) | ((F.col("dist") == d) & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") < b)))))
    labels = materialise(linked(nodes, forest), "labels")
    least = labels.select("component").distinct()
    # As many rows as there are clusters.
    numbers = least.select("component", F.row_number().over(W.orderBy("component")).alias("cluster"))
    return labels.join(numbers, "component").select("id", "cluster")
