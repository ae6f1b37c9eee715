"""Communities of weighted graphs by modularity, with a resolution.

Rounds of local moves: each node weighs the communities of its neighbours by the gain in modularity. Nodes move at the same time, a hashed half of
them in each round, so
that neighbours do not keep changing places; of equal gains the lesser community counts. Once moves bring nothing, each community becomes a node, its
inner edges a
loop, and moves begin anew on the smaller graph. A round is a join of edges with labels and sums by node and community; labels and sums are tables,
whatever the size of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import drop, materialise


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): both directions of every edge, of which repeated ones are added; a loop counts twice, as it has two ends at its node. Null
    and non-positive weights are left out."""
    own = edges.where("weight > 0").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    both = own.unionAll(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of labels (id, community) on a graph of symmetric(): the share of weight within communities, less resolution times what
    would fall there at random."""
    at = lambda c: labels.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    met = graph.join(at("src"), "src").join(at("dst"), "dst")
    sums = met.groupBy("csrc").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("csrc") == F.col("cdst"), F.col("weight")).otherwise(0.0)).alias("inner"))
    return sums.agg((F.sum("inner") / F.sum("degree") - resolution * F.sum(F.col("degree") * F.col("degree")) / (F.sum("degree") * F.sum("degree"))).alias("modularity"))


def _moved(graph: DataFrame, now: DataFrame, whole: float, resolution: float, turn: int, seed: int) -> DataFrame:
    """(id, degree, community) after a round of moves."""
    sizes = now.groupBy("community").agg(F.sum("degree").alias("size"))
    of = now.select(F.col("id").alias("dst"), F.col("community").alias("there"))
    met = graph.where("src <> dst").join(of, "dst").groupBy(F.col("src").alias("id"), "there").agg(F.sum("weight").alias("w"))
    # Its own community is a choice too, even without a neighbour there.
    stay = now.select("id", F.col("community").alias("there"), F.lit(0.0).alias("w"))
    choices = met.unionByName(stay).groupBy("id", "there").agg(F.sum("w").alias("w"))
    known = choices.join(now, "id").join(sizes.withColumnRenamed("community", "there"), "there")
    own = F.col("there") == F.col("community")
    gain = F.col("w") - resolution * F.col("degree") * (F.col("size") - F.when(own, F.col("degree")).otherwise(0.0)) / whole
    best = known.withColumn("gain", F.round(gain, 9)).groupBy("id", "degree", "community").agg(F.max_by("there", F.struct("gain", (-F.col("there")).alias("order"))).alias("best"), F.max("gain").alias("most"), F.max(F.when(own, F.col("gain"))).alias("stays"))
    turn_of = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(turn)), F.lit(2)) == 0
    return best.select("id", "degree", F.when(turn_of & (F.col("most") > F.col("stays")), F.col("best")).otherwise(F.col("community")).alias("community"))


def communities(edges: DataFrame, resolution: float = 1.0, most_rounds: int = 12, most_levels: int = 8, least_gain: float = 1e-4, seed: int = 0) -> DataFrame:
    """(id, community) of the nodes of a graph (src, dst, weight), whose edges count in both directions; a community is named by its least node. A
    larger resolution gives smaller communities.

    A level ends once two rounds in a row have brought less than least_gain of modularity together, and levels end once one brings less.
    """
    graph = materialise(symmetric(edges), "graph")
    whole = graph.agg(F.sum("weight")).first()[0] or 0.0
    nodes = materialise(graph.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("community")), "communities")
    if not whole:
        return nodes
    level, labels, reached = graph, nodes, modularity(graph, nodes, resolution).first()[0]
    for depth in range(most_levels):
        now = materialise(level.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")).withColumn("community", F.col("id")), "moves")
        best, value, past = now, reached, [reached]
        for turn in range(most_rounds):
            after = materialise(_moved(level, now, whole, resolution, turn, seed + depth), "moves")
            score = modularity(level, after.select("id", "community"), resolution).first()[0]
            if now is not best:
                drop(now)
            now = after
            if score > value:
                if best is not now:
                    drop(best)
                best, value = now, score
            past.append(value)
            if len(past) > 2 and past[-1] - past[-3] < least_gain:
                break
        if value - reached < least_gain:
            break
        reached = value
        step = best.select(F.col("id").alias("community"), F.col("community").alias("next"))
        labels = materialise(labels.join(step, "community").select("id", F.col("next").alias("community")), "communities")
        at = lambda c: step.select(F.col("community").alias(c), F.col("next").alias(f"n{c}"))
        merged = level.join(at("src"), "src").join(at("dst"), "dst").groupBy(F.col("nsrc").alias("src"), F.col("ndst").alias("dst")).agg(F.sum("weight").alias("weight"))
        level = materialise(merged, "graph")
    return labels.select("id", F.min("id").over(W.partitionBy("community")).alias("community"))
