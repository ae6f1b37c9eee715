"""Largest eigenvalues of a symmetric table (i, j, value), by products of blocks.

Chebyshev polynomials of the matrix are applied to a block of vectors. The nodes are dealt to slices, the matrix to a grid of blocks of some
BLOCK_ENTRIES entries: a product brings each slice to the blocks of its columns, one group each, and sums what they give by slices of rows. So a vector goes to as
many blocks as the grid is wide (the root of the number of blocks), and nothing to the driver.
All vectors of a round span a Krylov space; their products with the matrix are combinations of them, so one table of inner products (as wide as the
space, whatever the points) is all that the driver needs to find the best vectors in it. Rounds start again from these until the residuals |A v - l v| are
small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import drop, materialise

#: Bytes of the vectors that polished() sends at most; nodes of a slice and entries of a block of the matrix, about.
SENT_BYTES, SLICE, BLOCK_ENTRIES = 64 << 20, 8192, 4 << 20
#: Vectors by slices: doubles, one row of them for each node of the slice.
_SLICES = pa.schema([("slice", pa.int32()), ("v", pa.binary())])


@dataclass
class Eigen:
    """vectors (id, vector), of unit length and with their largest part positive; values, largest first; residuals |A v - l v|."""

    vectors: DataFrame
    values: np.ndarray
    residuals: np.ndarray


def _product(matrix: DataFrame, block: DataFrame, width: int, sent: bool) -> DataFrame:
    """(id, v): the matrix times a block (id, v) of width vectors."""
    own = block.select(F.col("id").alias("j"), "v")
    met = matrix.join(F.broadcast(own) if sent else own, "j")
    sums = met.groupBy("i").agg(*(F.sum(F.col("value") * F.col("v")[k]).alias(f"s{k}") for k in range(width)))
    return sums.select(F.col("i").alias("id"), F.array(*(f"s{k}" for k in range(width))).alias("v"))


def _means(block: DataFrame, width: int) -> list[float]:
    row = block.agg(*(F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(width))).first()
    return [v or 0.0 for v in row]


def _less_means(block: DataFrame, width: int) -> DataFrame:
    means = _means(block, width)
    return block.select("id", F.array(*(F.col("v")[k] - means[k] for k in range(width))).alias("v"))


def _of(table: pa.Table | pa.RecordBatch, name: str = "v", dtype: str = "<f8") -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def _table(slices: list[int], rows: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(slices, pa.int32()), pa.array([np.ascontiguousarray(x, "<f8").tobytes() for x in rows], pa.binary())], schema=_SLICES)


def _inner(width: int) -> Callable:
    """Sums of products of any two of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            for v in _of(b):
                x = v.reshape(-1, width)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    return run


def _changed(vectors: DataFrame, width: int, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _table(b.column("slice").to_pylist(), [fn(v.reshape(-1, width)) for v in _of(b)]).to_batches()

    return vectors.mapInArrow(run, "slice int, v binary")


def _beside(tables: list[DataFrame], widths: list[int]) -> DataFrame:
    """The vectors of all tables, slice by slice."""
    rows = tables[0].select("slice", "v", F.lit(0).alias("k"))
    for k, t in enumerate(tables[1:], 1):
        rows = rows.unionAll(t.select("slice", "v", F.lit(k).alias("k")))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        parts = dict(zip(group.column("k").to_pylist(), _of(group), strict=True))
        return _table([key[0].as_py()], [np.hstack([parts[k].reshape(-1, w) for k, w in enumerate(widths)])])

    return rows.groupBy("slice").applyInArrow(run, "slice int, v binary")


class _Grid:
    """A matrix (i, j, value) in blocks, and the places of its nodes (id) in slices."""

    def __init__(self, matrix: DataFrame, nodes: DataFrame, n: int, over: float):
        """over: what values are divided by."""
        spark, entries = matrix.sparkSession, max(1, matrix.count())
        wanted = max(1, int(np.ceil((entries / BLOCK_ENTRIES) ** 0.5)))
        slices = max(1, -(-n // SLICE), min(wanted, n))
        self.span = span = -(-slices // wanted)  # slices of a block's side
        self.side = side = -(-slices // span)
        own = nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"))
        self.placed = materialise(own.select("id", "slice", (F.row_number().over(W.partitionBy("slice").orderBy("id")) - 1).alias("place")), "placed")
        self.stride = stride = self.placed.agg(F.max("place")).first()[0] + 1
        a, b = (self.placed.select(F.col("id").alias(c), F.expr(f"slice div {span}").cast("int").alias(f"b{c}"), (F.col("slice") % span * stride + F.col("place")).alias(f"p{c}")) for c in "ij")
        met = matrix.join(a, "i").join(b, "j").select((F.col("bi") * side + F.col("bj")).alias("block"), "pi", "pj", (F.col("value") / over).alias("value"))

        def pack(key: tuple, group: pa.Table) -> pa.Table:
            rows, columns, values = (group.column(c).to_numpy() for c in ("pi", "pj", "value"))
            order = np.lexsort((columns, rows))
            met, starts = np.unique(rows[order], return_index=True)
            parts = [met.astype("<i4"), starts.astype("<i4"), columns[order].astype("<i4"), values[order].astype("<f8")]
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["block", "rows", "starts", "columns", "data"])

        self.stored = materialise(met.groupBy("block").applyInArrow(pack, "block int, rows binary, starts binary, columns binary, data binary"), "blocks")
        # Kept where it is, so that only vectors move; what is lost is read again.
        self.blocks = self.stored.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").persist()

    def free(self) -> None:
        self.blocks.unpersist()
        drop(self.stored)

    def vectors(self, columns: list) -> DataFrame:
        """Vectors of expressions of id."""
        width = len(columns)

        def run(key: tuple, group: pa.Table) -> pa.Table:
            v = np.stack([group.column(f"c{k}").to_numpy() for k in range(width)], 1)
            return _table([key[0].as_py()], [v[np.argsort(group.column("place").to_numpy())]])

        return self.placed.select("slice", "place", *(c.alias(f"c{k}") for k, c in enumerate(columns))).groupBy("slice").applyInArrow(run, "slice int, v binary")

    def rows(self, vectors: DataFrame, width: int) -> DataFrame:
        """(id, v) of vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, v in zip(b.column("slice").to_pylist(), _of(b), strict=True):
                    n = len(v) // width
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(v))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int32)), pa.array(np.arange(n, dtype=np.int32)), lists], names=["slice", "place", "v"])

        return vectors.mapInArrow(run, "slice int, place int, v array<double>").join(self.placed, ["slice", "place"]).select("id", "v")

    def product(self, vectors: DataFrame, width: int, before: DataFrame | None = None) -> DataFrame:
        """The matrix times vectors; with those before them, twice that less these."""
        span, side, stride = self.span, self.side, self.stride

        def times(key: tuple, block: pa.Table, own: pa.Table) -> pa.Table:
            if not block.num_rows:
                return _table([], []).append_column("part", pa.array([], pa.int32()))
            bi, bj = divmod(key[0].as_py(), side)
            v = np.zeros((width, span * stride))
            for s, x in zip(own.column("slice").to_pylist(), _of(own), strict=True):
                at = (s - bj * span) * stride
                v[:, at : at + len(x) // width] = x.reshape(-1, width).T
            (rows,), (starts,), (columns,) = (_of(block, c, "<i4") for c in ("rows", "starts", "columns"))
            (data,) = _of(block, "data")
            sums = np.zeros((span * stride, width))
            for k in range(width):
                sums[rows, k] = np.add.reduceat(data * v[k].take(columns), starts)
            met = np.unique(rows // stride).tolist()
            return _table([bi * span + s for s in met], [sums[s * stride : (s + 1) * stride] for s in met]).append_column("part", pa.array([bj] * len(met), pa.int32()))

        sent = vectors.select(F.expr(f"explode(transform(sequence(0, {side - 1}), b -> cast(b * {side} + slice div {span} AS int)))").alias("block"), "slice", "v")
        parts = self.blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(times, "slice int, v binary, part int")
        # Part -1 has as many rows as the slice.
        parts = parts.unionAll((vectors if before is None else before).select("slice", "v", F.lit(-1).alias("part")))
        factor = 1 if before is None else 2

        def add(key: tuple, group: pa.Table) -> pa.Table:
            found = dict(zip(group.column("part").to_pylist(), _of(group), strict=True))
            own = found.pop(-1)
            out = np.zeros(len(own)) if factor == 1 else -own
            for k in sorted(found):
                out += factor * found[k][: len(own)]
            return _table([key[0].as_py()], [out])

        return parts.groupBy("slice").applyInArrow(add, "slice int, v binary")

    def centred(self, vectors: DataFrame, width: int, n: int) -> DataFrame:
        """vectors less their means."""
        sums = _changed(vectors, width, lambda x: x.sum(0)).orderBy("slice").collect()
        means = sum((np.frombuffer(r.v) for r in sums), np.zeros(width)) / n
        return _changed(vectors, width, lambda x: x - means)


def _best(inner: np.ndarray, width: int, steps: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, residuals, weights of all blocks) of the best vectors within the first `steps` blocks, from the inner products of steps + 1 blocks T_0
    ... T_steps.

    T_1 = A T_0 and T_(k+1) = 2 A T_k - T_(k-1), so A times a block is a combination of its neighbours.
    """
    n = width * steps
    shifted = np.zeros((len(inner), n))
    for k in range(steps):
        own = slice(k * width, (k + 1) * width)
        eye = np.eye(width)
        shifted[(k + 1) * width : (k + 2) * width, own] = eye if k == 0 else eye / 2
        if k:
            shifted[(k - 1) * width : k * width, own] += eye / 2
    own, moved = inner[:n, :n], inner[:n] @ shifted
    scale = 1 / np.sqrt(np.maximum(np.diag(own), 1e-300))
    sizes, axes = np.linalg.eigh(own * scale[:, None] * scale)
    some = sizes > max(sizes[-1], 1e-300) * 1e-11
    to = scale[:, None] * axes[:, some] / np.sqrt(sizes[some])
    reduced = to.T @ ((moved + moved.T) / 2) @ to
    values, turned = np.linalg.eigh(reduced)
    order = np.argsort(-values)[:wanted]
    chosen = to @ turned[:, order]
    values = values[order]
    left = shifted @ chosen
    left[:n] -= chosen * values
    residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", left, inner, left), 0))
    weights = np.zeros((len(inner), len(order)))
    weights[:n] = chosen
    return values, residuals, weights


def largest(matrix: DataFrame, wanted: int, centred: bool = False, steps: int = 12, extra: int = 4, most_rounds: int = 12, tolerance: float = 1e-6, seed: int = 0, log: list | None = None, bound: float | None = None) -> Eigen:
    """The `wanted` algebraically largest eigenvalues of a symmetric matrix (i, j, value), of which pairs that are not in the table are 0, and their
    vectors.

    centred: of the matrix between projections that take the mean away, as double centring does, without a row for each pair. Rounds end once
    residuals are within tolerance of the matrix's norm
    (bound, if known; else an upper one, its largest sum of absolute values in a row: the closer, the fewer rounds, as polynomials of small numbers are much alike). extra vectors are carried along, as close eigenvalues need.
    """
    matrix = materialise(matrix.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value")), "matrix")
    ids = matrix.select(F.col("i").alias("id")).unionAll(matrix.select(F.col("j").alias("id"))).distinct()
    nodes = materialise(ids, "nodes")
    n = nodes.count()
    bound = bound or matrix.groupBy("i").agg(F.sum(F.abs("value")).alias("s")).agg(F.max("s")).first()[0] or 1.0
    grid = _Grid(matrix, nodes, n, bound)
    width = min(wanted + extra, n)
    wanted = min(wanted, width)
    steps = max(1, min(steps, -(-n // width)))
    draw = lambda k: (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1.0)
    block = grid.vectors([draw(k) for k in range(width)])
    values = residuals = np.zeros(0)
    for turn in range(most_rounds):
        blocks = [materialise(grid.centred(block, width, n) if centred else block, "block")]
        stored = blocks[:]
        for k in range(steps):
            new = materialise(grid.product(blocks[-1], width, blocks[-2] if k else None), "block")
            stored.append(new)
            # The block before has no mean, so this one's is the product's.
            blocks.append(grid.centred(new, width, n) if centred else new)
        whole = materialise(_beside(blocks, [width] * len(blocks)), "krylov")
        drop(*stored)
        size = width * (steps + 1)
        sums = whole.mapInArrow(_inner(size), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        inner = np.zeros(size * size)
        inner[sums["place"]] = sums["value"]
        values, residuals, weights = _best(inner.reshape(size, size), width, steps, width)
        block = materialise(_changed(whole, size, lambda x, weights=weights: x @ weights), "ritz")
        drop(whole)
        if log is not None:
            log.append((turn, values[:wanted] * bound, residuals[:wanted] * bound))
        if (residuals[:wanted] <= tolerance).all() or turn == most_rounds - 1:
            break
        if len(values) < width:  # fewer directions than vectors: the rest begins anew
            missing = width - len(values)
            block = _beside([block, grid.vectors([draw(width * (turn + 1) + k) for k in range(missing)])], [len(values), missing])
    rows = materialise(grid.rows(block, len(values)), "ritz")
    grid.free()
    found = len(values[:wanted])
    vectors = _signed(rows, found)
    return Eigen(vectors, values[:found] * bound, residuals[:found] * bound)


def _signed(vectors: DataFrame, found: int) -> DataFrame:
    """(id, vector) of rows (id, v), each vector with its largest part positive."""
    ends = vectors.agg(*(F.max_by(F.col("v")[k], F.struct(F.abs(F.col("v")[k]), "id")).alias(f"e{k}") for k in range(found))).first()
    signs = [-1.0 if (e or 0) < 0 else 1.0 for e in ends]
    return vectors.select("id", F.array(*(F.col("v")[k] * signs[k] for k in range(found))).alias("vector"))


def polished(matrix: DataFrame, found: Eigen) -> Eigen:
    """What largest() has found of a matrix between projections that take the mean away, once more multiplied by it and made orthogonal. Inner products of a Krylov space
    leave an error of about the root of the machine's precision; this takes it out where the values found are the largest in size, too. Kept only if residuals become smaller."""
    from .mds import _products, _turned

    width = len(found.values)
    n = found.vectors.count()
    sent = n * (8 * width + 32) <= SENT_BYTES
    times = lambda v: materialise(_less_means(materialise(_product(matrix, v, width, sent), "product"), width), "product")
    v = times(_less_means(materialise(found.vectors.select("id", F.col("vector").alias("v")), "vectors"), width))
    for _ in range(2):  # twice, as rounding spoils the first time
        sizes, axes = np.linalg.eigh(_products(v, width))
        if sizes[0] <= max(sizes[-1] * 1e-20, 1e-280):  # fewer directions than vectors
            return found
        v = materialise(_turned(v, axes / np.sqrt(sizes)), "vectors")
    both = materialise(v.join(times(v).select("id", F.col("v").alias("w")), "id").select("id", F.concat("v", "w").alias("v")), "vectors")
    inner = _products(both, 2 * width)
    values, turned = np.linalg.eigh((inner[:width, width:] + inner[width:, :width]) / 2)
    values, turned = values[::-1], turned[:, ::-1]
    rest = _turned(both, np.vstack([-turned * values, turned]))
    residuals = np.sqrt(np.array(rest.agg(*(F.sum(F.col("v")[k] * F.col("v")[k]) for k in range(width))).first(), float))
    if residuals.max() > found.residuals.max() or (values < found.values - 1e-6 * np.abs(found.values).max()).any():
        return found
    return Eigen(_signed(materialise(_turned(both, np.vstack([turned, 0 * turned])), "vectors"), width), values, residuals)


def classical_by_joins(distances: DataFrame, d: int, **options) -> DataFrame:
    """(id, init): classical scaling of a symmetric table of all distances (i, j, dist), as mds.classical does in one task, for any number of
    points."""
    squares = distances.select("i", "j", (-F.col("dist") * F.col("dist")).alias("value"))
    found = largest(squares, d, centred=True, **options)
    if len(found.values):
        found = polished(squares, found)
    roots = [float(np.sqrt(v / d)) if v >= 1e-14 else 0.0 for v in found.values]
    axes = [F.col("vector")[k] * r for k, r in enumerate(roots)] + [F.lit(0.0)] * (d - len(roots))
    return found.vectors.select("id", F.array(*axes).alias("init"))


def spectral_by_joins(neighbours: DataFrame, d: int, **options) -> tuple[DataFrame, Eigen]:
    """((id, embedding), what was found) of the symmetric neighbour graph (i, j): the eigenvectors of the least eigenvalues of its normalised
    Laplacian, over the roots of degrees, the first one left out.

    An edge weighs 1 if both ends name each other and 1/2 else, as in grids.spectral. Eigenvalues of the Laplacian are 1 less those found.
    """
    own = neighbours.where("i <> j").select("i", "j").distinct()
    both = own.select("i", "j", F.lit(0.5).alias("w")).unionAll(own.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.5).alias("w")))
    edges = materialise(both.groupBy("i", "j").agg(F.sum("w").alias("w")), "edges")
    degrees = materialise(edges.groupBy(F.col("i").alias("id")).agg(F.sqrt(F.sum("w")).alias("root")), "degrees")
    a, b = degrees.select(F.col("id").alias("i"), F.col("root").alias("ri")), degrees.select(F.col("id").alias("j"), F.col("root").alias("rj"))
    # Of a graph divided by the roots of degrees no eigenvalue is larger than 1.
    found = largest(edges.join(a, "i").join(b, "j").select("i", "j", (F.col("w") / F.col("ri") / F.col("rj")).alias("value")), d + 1, bound=1.0, **options)
    axes = F.transform(F.slice("vector", 2, d), lambda x: x / F.col("root"))
    return found.vectors.join(degrees, "id").select("id", axes.alias("embedding")), found
