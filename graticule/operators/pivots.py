"""Exact neighbours by pivots: a part of space is only looked at for points that can still have a neighbour there.

Points are dealt to the nearest of some pivots; a cell knows the range of its points' distances to every pivot. By the triangle inequality each point
has a
least distance to each cell, and a largest distance to its k-th neighbour (from its own block, and from the cells that are near as a whole). Blocks of
queries meet those cells only that lie within it, and pass on only what lies within it. Where the space has no structure (vectors drawn evenly
from a sphere of many dimensions) no cell can be left out and all pairs are compared, as by any exact search.

Equal points are one point until the end, so ties of copies cost nothing; other ties at the k-th distance are kept until exact distances and ids
decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .packing import Distinct, distinct, in_space, rows_of, spread_out

#: Points of a block; pivots at most, and points drawn for each; bytes of packed points that are sent to every executor at most; pairs of which exact
#: distances are computed at once.
BLOCK, PIVOTS, DRAWN, SENT_BYTES, PAIRS = 1024, 256, 16, 64 << 20, 1 << 14


def _apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances by products, and how far they can be wrong."""
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)
    slack = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx + yy)
    square = np.maximum(xx + yy - 2 * x @ y.T, 0)
    return np.sqrt(square), np.sqrt(square + slack) - np.sqrt(np.maximum(square - slack, 0))


def chosen_pivots(known: Distinct, pivots: int | None, metric: str) -> np.ndarray:
    """One pivot for each block of points, PIVOTS at most: from DRAWN points for each, by the MD5 of their ids, those farthest from each other, moved
    to the means of what is nearest to them."""
    n = pivots or int(np.clip(known.n // BLOCK, 1, PIVOTS))
    rows = known.points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n * DRAWN).select("data").collect()
    x = in_space(np.stack([np.frombuffer(r[0], "<f8") for r in rows]), metric)
    chosen, apart = [0], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(apart.argmax()))
    centres = x[chosen]
    for _ in range(5):
        own = _apart(x, centres)[0].argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


def _dealer(sent, metric: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _apart(in_space(rows_of(b.column("data")), metric), sent.value)[0]
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), b.column("id"), b.column("data")], names=["cell", "far", "id", "data"])

    return run


def _blocker(sent, metric: str) -> Callable:
    """Blocks of up to BLOCK points of one cell, with the ranges of their distances to the pivots."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, data = None, [], []

        def out() -> pa.RecordBatch:
            x = np.stack([np.frombuffer(v, "<f8") for v in data])
            d, wrong = _apart(in_space(x, metric), sent.value)
            row = [[cell], [len(ids)], [np.array(ids, "<i8").tobytes()], [x.tobytes()], [(d - wrong).min(0)], [(d + wrong).max(0)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for b in batches:
            for c, i, v in zip(b.column("cell").to_pylist(), b.column("id").to_pylist(), b.column("data").to_pylist()):
                if ids and (c != cell or len(ids) == BLOCK):
                    yield out()
                    ids, data = [], []
                cell = c
                ids.append(i)
                data.append(v)
        if ids:
            yield out()

    return run


def _visitor(sent, metric: str, k: int) -> Callable:
    """A block's queries once for each cell that can have neighbours of some of them, nearest cells first, with each query's least distance to the
    cell, and the largest at which its k-th neighbour can lie."""
    schema = pa.schema([("cell", pa.int32()), ("n_queries", pa.int32()), ("queries", pa.binary()), ("asked", pa.binary()), ("least", pa.binary()), ("most", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, low, high, counts = sent.value
        for b in batches:
            for ids, data in zip(b.column("ids").to_pylist(), b.column("data").to_pylist()):
                x = np.frombuffer(data, "<f8").reshape(len(ids) // 8, -1)
                s = in_space(x, metric)
                d, wrong = _apart(s, pivots)
                # The k-th neighbour lies within the block's k-th distance, and within a cell's whole reach once the nearest cells have k points.
                most = np.full(len(x), np.inf)
                if len(x) >= k:
                    inner, off = _apart(s, s)
                    most = np.partition(inner + off, k - 1, axis=1)[:, k - 1]
                reach = d + wrong + np.diag(high)
                order = reach.argsort(1)
                enough = (counts[order].cumsum(1) >= k).argmax(1)
                if counts.sum() >= k:
                    most = np.minimum(most, reach[np.arange(len(x)), order[np.arange(len(x)), enough]])
                least = np.zeros((len(x), len(counts)))
                for p in range(len(pivots)):
                    np.maximum(least, np.maximum((d - wrong)[:, p, None] - high[None, :, p], low[None, :, p] - (d + wrong)[:, p, None]), out=least)
                near = (least <= most[:, None]) & (counts > 0)
                for c in sorted(np.flatnonzero(near.any(0)).tolist(), key=lambda c: (least[:, c].sum(), d[:, c].sum())):
                    row = [[c], [int(near[:, c].sum())], [ids], [data], [least[:, c].tobytes()], [most.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    return run


def _comparer(metric: str, k: int) -> Callable:
    """Queries against blocks. Rows of one block of queries stand together: its nearest so far bound what further cells can have, and it passes on k
    of each query once. Without bounds (least, most) every pair is compared."""
    from .knn import _exact

    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a, x, s, bound, best = None, None, None, None, None, None

        def out() -> pa.RecordBatch:
            rows, ids, dist = best
            return pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(ids), pa.array(dist)], schema=schema)

        for b in batches:
            for n in range(b.num_rows):
                row = {c: b.column(c)[n].as_py() for c in b.schema.names}
                if row["queries"] != key:
                    if key is not None and len(best[0]):
                        yield out()
                    key, a = row["queries"], np.frombuffer(row["queries"], "<i8")
                    x = np.frombuffer(row["asked"], "<f8").reshape(len(a), -1)
                    s, bound = in_space(x, metric), np.frombuffer(row["most"], "<f8").copy() if "most" in row else np.full(len(a), np.inf)
                    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                c = np.frombuffer(row["ids"], "<i8")
                y = np.frombuffer(row["data"], "<f8").reshape(len(c), -1)
                some = np.flatnonzero(np.frombuffer(row["least"], "<f8") <= bound) if "least" in row else np.arange(len(a))
                if not len(some):
                    continue
                d, wrong = _apart(s[some], in_space(y, metric))
                if len(c) >= k:
                    bound[some] = np.minimum(bound[some], np.partition(d + wrong, k - 1, axis=1)[:, k - 1])
                at, found = np.nonzero(d - wrong <= bound[some, None])
                at = some[at]
                dist = np.concatenate([np.zeros(0), *(_exact(x[at[i : i + PAIRS]], y[found[i : i + PAIRS]], metric) for i in range(0, len(at), PAIRS))])
                rows, ids, dist = np.concatenate([best[0], at]), np.concatenate([best[1], c[found]]), np.concatenate([best[2], dist])
                order = np.lexsort((ids, a[rows] != ids, dist, rows))
                rows, ids, dist = rows[order], ids[order], dist[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                best = tuple(v[place < k] for v in (rows, ids, dist))
                full = place == k - 1
                # In the space of the bounds: a cosine distance of c is an angle whose chord is sqrt(2 c).
                last = np.sqrt(2 * np.maximum(dist[full], 0)) if metric == "cosine" else dist[full]
                bound[rows[full]] = np.minimum(bound[rows[full]], last * (1 + 1e-9) + 1e-7)
        if key is not None and len(best[0]):
            yield out()

    return run


def _visits(known: Distinct, k: int, metric: str, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """Blocks, and which of their queries visit which cell."""
    spark = known.points.sparkSession
    centres = chosen_pivots(known, pivots, metric)
    sent = spark.sparkContext.broadcast(centres)
    dealt = materialise(known.points.mapInArrow(_dealer(sent, metric), "cell int, far double, id long, data binary"), "cells")
    # A cell with a large part of all points is divided by their distance to its pivot.
    ranged = dealt.repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far", "id")
    blocks = materialise(ranged.mapInArrow(_blocker(sent, metric), "cell int, n int, ids binary, data binary, low array<double>, high array<double>"), "blocks")
    # Ranges of each cell to each pivot: at most PIVOTS squared rows, whatever the points.
    ends = blocks.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "e")).groupBy("cell", "pivot").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).toPandas()
    sizes = blocks.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    low, high, counts = np.full((len(centres), len(centres)), np.inf), np.full((len(centres), len(centres)), -np.inf), np.zeros(len(centres), np.int64)
    low[ends["cell"], ends["pivot"]], high[ends["cell"], ends["pivot"]], counts[sizes["cell"]] = ends["low"], ends["high"], sizes["n"]
    facts = spark.sparkContext.broadcast((centres, low, np.where(np.isinf(high), np.inf, high), counts))
    visits = blocks.select("ids", "data").repartition(max(1, blocks.count())).mapInArrow(_visitor(facts, metric, k), "cell int, n_queries int, queries binary, asked binary, least binary, most binary")
    return blocks.select("cell", "n", "ids", "data"), visits


def pivot_work(points: DataFrame, k: int, metric: str = "l2", pivots: int | None = None) -> DataFrame:
    """One row: points that differ, and the pairs of them that knn_pivots compares at most."""
    known = distinct(points, k)
    blocks, visits = _visits(known, k, metric, pivots)
    cells = blocks.groupBy("cell").agg(F.sum("n").alias("n"))
    pairs = visits.select("cell", "n_queries").join(cells, "cell").agg(F.sum(F.col("n_queries").cast("long") * F.col("n")).alias("compared"))
    return pairs.select(F.lit(known.n).cast("long").alias("points"), "compared")


def knn_pivots(points: DataFrame, k: int, metric: str = "l2", pivots: int | None = None) -> DataFrame:
    """(i, j, rank, dist): the k nearest of each point (id, features), itself first, ties by id. metric: l2 or cosine."""
    known = distinct(points, k)
    if not known.n:
        return known.points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1).alias("rank"), F.lit(0.0).alias("dist"))
    blocks, visits = _visits(known, k, metric, pivots)
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0]
    met = visits.join(F.broadcast(blocks) if size <= SENT_BYTES else blocks, "cell").drop("cell", "n", "n_queries")
    near = met.mapInArrow(_comparer(metric, k), "i long, j long, dist double")
    return spread_out(near, known, k)
