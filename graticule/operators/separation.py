"""Moving clusters apart: violations of hulls, and descent on one move per cluster."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusters import hull

EPS = 1e-8


def violations(points: DataFrame, hull_edges: DataFrame, margin: Column | float) -> DataFrame:
    """(cluster, id, other, inside, dist, violation) of points (cluster, id, x, y) against hulls of other clusters.

    hull_edges: (other, ax, ay, bx, by), anticlockwise, a few per cluster. Inside, dist is to the nearest line and the violation
    tanh(margin + dist); outside, dist is to the nearest edge and the violation tanh(max(0, margin - dist)).
    """
    joined = points.join(hull_edges, F.col("cluster") != F.col("other"))
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    px, py = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    length2 = ex * ex + ey * ey
    signed = (ex * py - ey * px) / F.sqrt(length2)
    along = F.greatest(F.least((px * ex + py * ey) / length2, F.lit(1.0)), F.lit(0.0))
    dx, dy = px - along * ex, py - along * ey
    edges = joined.where(length2 > 0).select("cluster", "id", "other", signed.alias("signed"), F.sqrt(dx * dx + dy * dy).alias("apart"))
    both = edges.groupBy("cluster", "id", "other").agg(F.count("*").alias("n"), F.min("signed").alias("least"), F.max("signed").alias("most"), F.min(F.abs("signed")).alias("line"), F.min("apart").alias("apart"))
    inside = (F.col("n") >= 3) & ((F.col("least") >= -EPS) | (F.col("most") <= EPS))
    dist = F.when(F.col("inside"), F.col("line")).otherwise(F.col("apart"))
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    value = F.when(F.col("n") < 3, 0.0).when(F.col("inside"), F.tanh(m + F.col("dist"))).otherwise(F.tanh(F.greatest(F.lit(0.0), m - F.col("dist"))))
    return both.withColumn("inside", inside).withColumn("dist", dist).select("cluster", "id", "other", "inside", "dist", value.alias("violation"))


def nearest_points(points: DataFrame, medoids: DataFrame, k: int = 2000) -> DataFrame:
    """(cluster, id, x, y, other): the k points of each cluster nearest each other cluster's medoid (other, mx, my)."""
    joined = points.join(F.broadcast(medoids), F.col("cluster") != F.col("other"))
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2
    order = W.partitionBy("cluster", "other").orderBy("d2", "id")
    return joined.withColumn("d2", d2).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cluster", "id", "x", "y", "other")


def moved(points: DataFrame, moves: DataFrame) -> DataFrame:
    """Points (cluster, id, x, y) rotated about their medoid (mx, my) by angle and shifted by (tx, ty), by moves, one row for each cluster."""
    joined = points.join(F.broadcast(moves), "cluster")
    dx, dy, c, s = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.cos("angle"), F.sin("angle")
    return joined.select("cluster", "id", (dx * c - dy * s + F.col("mx") + F.col("tx")).alias("x"), (dx * s + dy * c + F.col("my") + F.col("ty")).alias("y"))


@dataclass
class Separation:
    """Points and medoids after the moves, losses of each step, and the medoids' paths."""

    points: list[np.ndarray]
    medoids: np.ndarray
    losses: list[float]
    paths: np.ndarray


def _one_violation(points: np.ndarray, corners: np.ndarray, margin: float) -> tuple[float, np.ndarray]:
    """Mean violation and its derivative by a common shift of the points."""
    a, b = corners, np.roll(corners, -1, axis=0)
    e = b - a
    length = np.sqrt((e**2).sum(1))
    a, e, length = a[length > 0], e[length > 0], length[length > 0]
    if len(a) < 3 or not len(points):
        return 0.0, np.zeros(2)
    p = points[:, None] - a[None]
    signed = (e[:, 0] * p[..., 1] - e[:, 1] * p[..., 0]) / length
    inside = (signed >= -EPS).all(1) | (signed <= EPS).all(1)
    line = np.abs(signed).argmin(1)
    along = np.clip((p * e).sum(-1) / length**2, 0, 1)
    gap = p - along[..., None] * e
    apart = np.sqrt((gap**2).sum(-1))
    near, rows = apart.argmin(1), np.arange(len(points))
    normal = np.stack([-e[:, 1], e[:, 0]], 1) / length[:, None]
    inner = np.tanh(margin + np.abs(signed[rows, line]))
    room = margin - apart[rows, near]
    outer = np.tanh(np.maximum(0, room))
    slope_in = (1 - inner**2)[:, None] * np.sign(signed[rows, line])[:, None] * normal[line]
    way = np.divide(gap[rows, near], apart[rows, near][:, None], out=np.zeros((len(points), 2)), where=apart[rows, near][:, None] > 0)
    slope_out = -np.where(room > 0, 1 - outer**2, 0)[:, None] * way
    value = np.where(inside, inner, outer)
    return float(value.mean()), np.where(inside[:, None], slope_in, slope_out).mean(0)


def separate(clusters: list[np.ndarray], medoids: np.ndarray, apart: np.ndarray, corners: list[np.ndarray] | None = None, most_steps: int = 300, rate: float = 1.0, k: int = 2000, weight: float = 2.0, drift: float = 0.0, factor: float = 0.3) -> Separation:
    """Shift clusters until hulls (of their points, or with the corners given) are at a margin in proportion to the medoids' distances (apart). Two parameters for each cluster, on the driver."""
    n = len(clusters)
    corners = corners or [hull(c) for c in clusters]
    diameter = max((float(np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1)).max()) for h in corners), default=0.0)
    margin = apart / max(float(apart.max()), 1e-300) * factor * diameter
    shift, losses, paths = np.zeros((n, 2)), [], []
    for step in range(most_steps):
        paths.append(medoids + shift)
        loss, slope = drift * float((shift**2).sum()), 2 * drift * shift
        for i in range(n):
            for j in range(n):
                if i == j:
                    continue
                own = clusters[i] + shift[i]
                if len(own) > k:
                    own = own[np.argpartition(((own - medoids[j] - shift[j]) ** 2).sum(1), k)[:k]]
                value, g = _one_violation(own, corners[j] + shift[j], margin[i, j])
                loss += weight * value
                slope[i] += weight * g
                slope[j] -= weight * g
        losses.append(loss)
        if step > 10 and (abs(losses[-10] - loss) < 5e-4 or loss < 1e-3):
            break
        shift = shift - (0.1 + (rate - 0.1) * min(1.0, step / 20)) * slope
    return Separation([c + s for c, s in zip(clusters, shift, strict=True)], medoids + shift, losses, np.array(paths))
