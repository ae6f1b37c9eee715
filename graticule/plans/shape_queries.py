"""Queries on generated shapes, and on scaling where the result is known exactly."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import clusters, evaluate, mds, paths
from ..operators.knn import pairwise, widest
from ..sources import generators
from .catalogue import PAIRS, P, coordinates, points, query, rounded
from .storage import materialise

N = 1000


def _uniform(seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def _normal(seed: int) -> str:
    return f"(sqrt(-2 * ln({_uniform(seed)})) * cos(2 * pi() * {_uniform(seed + 1000)}))"


#: Of each shape the generator's arguments, columns drawn for an id, a condition, and the coordinates.
_SHAPES = {
    "four_gaussians": ({}, "id // 250 AS label", "TRUE", [f"[-32.8, 9.84, 0.0, 0.0][label + 1] + {_normal(0)} * sqrt(2)", f"[0.0, 0.0, 8.2, -16.4][label + 1] + {_normal(1)} * sqrt(2)"]),
    "moons": ({}, f"id % 2 AS label, {_uniform(42)} * pi() AS t", "TRUE", [f"CASE WHEN label = 0 THEN cos(t) ELSE 1 - cos(t) END + {_normal(43)} * 0.1", f"CASE WHEN label = 0 THEN sin(t) ELSE 0.5 - sin(t) END + {_normal(44)} * 0.1"]),
    "hemisphere": ({}, f"{_uniform(0)} * 2 * pi() AS a, {_uniform(1)} * pi() / 2 AS b", "TRUE", ["sin(b) * cos(a)", "sin(b) * sin(a)", "cos(b)"]),
    "torus": ({}, f"{_uniform(0)} * 2 * pi() AS a, {_uniform(1)} * 2 * pi() AS b", "TRUE", ["(2 + cos(a)) * cos(b)", "(2 + cos(a)) * sin(b)", "sin(a)"]),
    "swiss_roll": ({}, f"1.5 * pi() * (1 + 2 * {_uniform(0)}) AS t, 21 * {_uniform(1)} AS u", "NOT (t > 2.5 * pi() AND t < 3.5 * pi() AND u > 7 AND u < 14)", ["t * cos(t)", "u", "t * sin(t)"]),
    "swiss_roll_turns": ({"turns": 8, "noise": 0.5}, f"8 * pi() * {_uniform(0)} AS t, 60 * {_uniform(1)} AS u", "TRUE", [f"t * cos(t) + {_normal(2)} * 0.5", f"u + {_normal(3)} * 0.5", f"t * sin(t) + {_normal(4)} * 0.5"]),
    "s_curve": ({}, f"3 * pi() * ({_uniform(0)} - 0.5) AS t, 2 * {_uniform(1)} AS u", "TRUE", ["sin(t)", "u", "sign(t) * (cos(t) - 1)"]),
    "s_curve_hole": ({"hole": 0.5}, f"3 * pi() * ({_uniform(0)} - 0.5) AS t, 2 * {_uniform(1)} AS u", "pow(sin(t), 2) + pow(u - 1, 2) + pow(cos(t) - 1, 2) > 0.25", ["sin(t)", "u", "sign(t) * (cos(t) - 1)"]),
    "moebius": ({}, f"{_uniform(0)} * 2 * pi() AS u, (1 - sqrt(1 - {_uniform(1)})) * 2 - 1 AS v", "TRUE", ["(1 + v * cos(u / 2)) * cos(u)", "(1 + v * cos(u / 2)) * sin(u)", "v * sin(u / 2)"]),
}

for _name, (_options, _draws, _where, _axes) in _SHAPES.items():
    _rows = " UNION ALL ".join(f"SELECT id, {k}::INT AS pos, round({a}, 5) + 0.0 AS x FROM d WHERE {_where}" for k, a in enumerate(_axes))

    @query(f"WITH d AS (SELECT id, {_draws} FROM range({N}) r(id)) {_rows}", name=f"generate_{_name}")
    def _generated(spark, d, shape=_name.removesuffix("_turns").removesuffix("_hole"), options=_options):
        return coordinates(getattr(generators, shape)(spark, N, **options))


@query(f"WITH d AS (SELECT id, id // 5 AS i, id % 5 AS j FROM range(25) r(id)) SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE 10 * {_uniform(42)} END, 5) + 0.0 AS dist FROM d")
def generate_asymmetric_distances(spark, d):
    return rounded(generators.asymmetric_distances(spark), "dist")


_MATRIX = f"m AS (SELECT id // 40 AS i, id % 40 AS j, CASE WHEN id // 40 = id % 40 THEN 0 ELSE 10 * {_uniform(42)} END AS dist FROM range(1600) r(id))"


@query(f"WITH {_MATRIX} SELECT a.i, a.j, round((a.dist + b.dist) / 2, 5) + 0.0 AS dist FROM m a JOIN m b ON a.i = b.j AND a.j = b.i")
def symmetrised_distances(spark, d):
    return rounded(paths.symmetrised(generators.asymmetric_distances(spark, 40)), "dist")


@query(f"WITH {_MATRIX} SELECT a.i AS i, b.i AS j, round(CASE WHEN a.i = b.i THEN 0 ELSE coalesce(m.dist, 100.0) END, 5) + 0.0 AS dist FROM range(40) a(i) CROSS JOIN range(40) b(i) LEFT JOIN (SELECT * FROM m WHERE dist < 3) m ON m.i = a.i AND m.j = b.i")
def filled_distances(spark, d):
    own = generators.asymmetric_distances(spark, 40).where("dist < 3")
    return rounded(paths.filled(own, spark.range(40), 3.0), "dist")


_SOLID = f"{P}, q AS (SELECT id, v[1:3] AS v FROM p)"


def _solid(spark, d):
    """The first three coordinates, whose distances three dimensions hold exactly."""
    return points(spark, d).select("id", F.slice("features", 1, 3).alias("features"))


def _spaced(embedding, d: int, to: int):
    """All distances of an embedding, of which classical scaling has divided the coordinates by sqrt(d / 2), to so many decimals."""
    return pairwise(embedding.select("id", F.transform("init", lambda x: x * math.sqrt(d / 2)).alias("features")), to=to)


@query(f"WITH {_SOLID} SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v), 4) + 0.0 AS dist FROM q a, q b")
def classical_scaling(spark, d):
    own = _solid(spark, d)
    if own.count() > mds.DENSE:  # no table of all distances, and none in one task
        placed = materialise(mds.classical_of(own, 3), "placed").select("id", F.lit(0).cast("long").alias("component"), "init", F.col("init").alias("embedding"))
        return _spaced(placed, 3, to=4)
    table = materialise(pairwise(own), "distances")
    whole = points(spark, d).select("id", F.lit(0).cast("long").alias("component"))
    return _spaced(mds.embed_components(table, whole, 3, metric=False), 3, to=4)


@query(f"WITH {_SOLID} SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v), 4) + 0.0 AS dist FROM q a, q b")
def landmark_scaling(spark, d):
    own = _solid(spark, d)
    whole = materialise(own.select("id", F.lit(0).cast("long").alias("component")), "labels")
    marks = mds.landmark_ids(whole, 50).select(F.col("id").alias("j"))
    chosen = own.join(F.broadcast(marks), F.col("id") == F.col("j")).select("id", "features")
    table = materialise(pairwise(own, asked=chosen).select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"), "distances")
    return _spaced(mds.by_landmarks(table, whole, 3, metric=False), 3, to=4)


@query(f"WITH {P}, u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM p), m AS (SELECT k, avg(x) AS m FROM u GROUP BY k) SELECT id, round(sqrt(sum(pow(x - m, 2))), 4) AS norm FROM u JOIN m USING (k) GROUP BY id")
def pca_norms(spark, d):
    """All principal components hold the centred vectors' lengths."""
    own = points(spark, d)
    size = own.select(F.size("features")).first()[0]
    return evaluate.pca(own, size).select("id", F.round(vectors.norm(F.col("features")), 4).alias("norm"))


_HULL = f"""{P}, h AS (SELECT DISTINCT label AS cluster, v[1] AS x, v[2] AS y FROM p),
e AS (SELECT a.cluster, a.x, a.y, b.x AS bx, b.y AS b_y FROM h a JOIN h b ON a.cluster = b.cluster AND (a.x, a.y) <> (b.x, b.y)),
s AS (SELECT e.cluster, e.x, e.y, e.bx, e.b_y FROM e JOIN h c ON c.cluster = e.cluster GROUP BY ALL
HAVING min((e.bx - e.x) * (c.y - e.y) - (e.b_y - e.y) * (c.x - e.x)) >= 0)
SELECT DISTINCT cluster, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y FROM s"""


@query(f"WITH {_HULL}")
def hull_corners(spark, d):
    plane = points(spark, d).select(F.col("label").alias("cluster"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    return rounded(clusters.hulls(plane).select("cluster", "x", "y"), "x", "y")


@query(f"WITH {PAIRS} SELECT a.label AS cluster, round(max(dist), 5) AS diameter FROM pairs JOIN p a ON a.id = i JOIN p b ON b.id = j WHERE a.label = b.label GROUP BY a.label")
def diameters(spark, d):
    labels = points(spark, d).select("id", F.col("label").alias("cluster"))
    return rounded(widest(points(spark, d), labels), "diameter")
