"""Classifiers trained by rounds over distributed rows: each round sends the weights, sums gradients of a draw of rows in each task, and moves the
weights on the driver.

Only weights and their gradients travel (as large as the model, whatever the rows). Validation loss is summed in the same pass; training stops once it
has not fallen for some rounds,
and the best weights stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import drop, materialise


@dataclass
class Classifier:
    """Weights by layer, the labels, means and scales of features, and the losses (train, validation) of each round."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    labels: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    losses: list[tuple[float, float]] = field(default_factory=list)
    best: int = 0

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of each layer, probabilities last."""
        out = [(x - self.mean) / self.scale]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            if k < len(self.layers) - 1:
                out.append(np.maximum(z, 0))
            else:
                e = np.exp(z - z.max(1, keepdims=True))
                out.append(e / e.sum(1, keepdims=True))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """The sum of losses of rows and its derivatives."""
        out = self.forward(x)
        loss = float(-np.log(np.maximum(out[-1][np.arange(len(y)), y], 1e-12)).sum())
        back, grads = out[-1].copy(), []
        back[np.arange(len(y)), y] -= 1
        for k in range(len(self.layers) - 1, -1, -1):
            grads.append((out[k].T @ back, back.sum(0)))
            if k:
                back = (back @ self.layers[k][0].T) * (out[k] > 0)
        return loss, grads[::-1]


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)


def _round(sent, share: float, turn: int, seed: int) -> Callable:
    """A task's sums: rows and losses of both parts, and the gradient of the drawn training rows, flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = sent.value
        total, facts = None, np.zeros(4)
        for b in batches:
            if not b.num_rows:
                continue
            x, y, aside = _matrix(b), b.column("label").to_numpy(), b.column("aside").to_numpy(zero_copy_only=False).astype(bool)
            drawn = ~aside & ((b.column("place").to_numpy() * 2654435761 + (turn * 7919 + seed) * 40503) % (1 << 20) < share * (1 << 20))
            for part, at in ((drawn, 0), (aside, 2)):
                if part.any():
                    loss, grads = model.gradient(x[part], y[part])
                    facts[at : at + 2] += part.sum(), loss
                    if at == 0:
                        flat = np.concatenate([g.ravel() for pair in grads for g in pair])
                        total = flat if total is None else total + flat
        if facts.any():
            total = np.zeros(sum(w.size + c.size for w, c in model.layers)) if total is None else total
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 + len(total))), pa.array(np.concatenate([facts, total]))], names=["place", "value"])

    return run


def train(rows: DataFrame, hidden: list[int] | None = None, rounds: int = 60, rate: float = 0.05, share: float = 0.5, aside: float = 0.2, patience: int = 8, decay: float = 1e-4, seed: int = 0) -> Classifier:
    """A softmax classifier, with hidden layers of rectified units if given, of rows (id, features, label). aside: the share of rows, by a hash of id,
    that validate; share: of the others, how many a round draws. Rows without a label or features are left out."""
    spark = rows.sparkSession
    own = rows.where("label IS NOT NULL AND features IS NOT NULL").select(F.col("id"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("long").alias("label"))
    labels = np.array(sorted(r[0] for r in own.select("label").distinct().collect()), np.int64)  # as many as there are classes
    if not len(labels):
        raise ValueError("no row has a label")
    code = F.array_position(F.array(*(F.lit(int(v)).cast("long") for v in labels)), F.col("label")) - 1
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20))
    packed = materialise(own.select("features", code.alias("label"), place.alias("place"), (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1000)) < int(aside * 1000)).alias("aside")), "training")
    width = packed.select(F.size("features")).first()[0]
    stats = packed.agg(*(F.avg(F.col("features")[k]) for k in range(width)), *(F.stddev_pop(F.col("features")[k]) for k in range(width))).first()
    draw, sizes = np.random.default_rng(seed), [width, *(hidden or []), len(labels)]
    layers = [(draw.normal(0, np.sqrt(2 / a), (a, b)) if hidden else np.zeros((a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    model = Classifier(layers, labels, np.array(stats[:width], float), np.maximum(np.array(stats[width:], float), 1e-9))
    flat = np.concatenate([v.ravel() for pair in layers for v in pair])
    first, second, best, kept, waited = np.zeros_like(flat), np.zeros_like(flat), np.inf, flat.copy(), 0

    def unflat(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for w, b in layers:
            out.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return out

    for turn in range(rounds):
        model.layers = unflat(flat)
        sent = spark.sparkContext.broadcast(Classifier(model.layers, labels, model.mean, model.scale))
        sums = packed.mapInArrow(_round(sent, share, turn, seed), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        sent.unpersist()
        values = np.zeros(4 + len(flat))
        values[sums["place"]] = sums["value"]
        n, loss, n_aside, loss_aside = values[:4]
        check = loss_aside / n_aside if n_aside else loss / max(n, 1)
        model.losses.append((loss / max(n, 1), check))
        if check < best - 1e-5:
            best, kept, waited, model.best = check, flat.copy(), 0, turn
        else:
            waited += 1
            if waited >= patience:
                break
        gradient = values[4:] / max(n, 1) + decay * flat
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        flat = flat - rate * (first / (1 - 0.9 ** (turn + 1))) / (np.sqrt(second / (1 - 0.999 ** (turn + 1))) + 1e-8)
    drop(packed)
    model.layers = unflat(kept)
    return model


def predicted(points: DataFrame, model: Classifier) -> DataFrame:
    """points with predicted (a label) and probability (of it)."""
    sent = points.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = sent.value.forward(_matrix(b))[-1]
                yield b.append_column("predicted", pa.array(sent.value.labels[p.argmax(1)])).append_column("probability", pa.array(p.max(1)))

    from pyspark.sql import types as T

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("predicted", T.LongType()), T.StructField("probability", T.DoubleType())]))


def accuracy_by_dimension(points: DataFrame, methods: dict[str, Callable[[DataFrame, int], DataFrame]], dimensions: list[int], share: float = 0.75, **options) -> DataFrame:
    """(method, d, train, test, rounds, best_round): how well labels of points (id, features, label) are told from what each method (points, d) to
    (id, features) makes of their features, for each d. test: of the rows, by a hash of id, that the classifier has not seen."""
    spark, out = points.sparkSession, []
    seen = F.pmod(F.xxhash64("id", F.lit(97)), F.lit(1000)) < int(share * 1000)
    for name, method in methods.items():
        for d in dimensions:
            made = materialise(method(points, d).select("id", "features").join(points.select("id", "label"), "id"), "features")
            model = train(made.where(seen), **options)
            right = predicted(made, model).withColumn("_right", (F.col("predicted") == F.col("label")).cast("double"))
            row = right.agg(F.avg(F.when(seen, F.col("_right"))), F.avg(F.when(~seen, F.col("_right")))).first()
            out.append((name, d, row[0], row[1], len(model.losses), model.best))
            drop(made)
    return spark.createDataFrame(out, "method string, d int, train double, test double, rounds int, best_round int")
