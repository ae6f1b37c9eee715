"""How good a labelling or model is: confusion, accuracy, pair sets, nearest-neighbour votes, classifiers, PCA."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n)"""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"))


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, predicted): the most frequent label (labels: id, label) among a point's neighbours, itself left out; the smallest on ties."""
    named = labels.select(F.col("id").alias("j"), "label")
    counted = neighbours.where("i <> j").join(named, "j").groupBy("i", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("i").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("predicted")).withColumnRenamed("i", "id")


def assignment(gain: np.ndarray) -> np.ndarray:
    """For each row the column of a matching of largest total gain (rows <= columns), by shortest augmenting paths."""
    n, m = gain.shape
    cost, u, v = gain.max(initial=0) - gain, np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, free = match[j0], ~used
            free[0] = False
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(free, least, np.inf).argmin())
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out


def pair_sets_index(df: DataFrame, a: str, b: str) -> float:
    """Similarity of two partitions by matched pairs of clusters, corrected for chance (0: no better; 1: equal). The contingency table goes to the driver: clusters times clusters."""
    rows = df.groupBy(a, b).count().collect()
    left, right = sorted({r[a] for r in rows}), sorted({r[b] for r in rows})
    table = np.zeros((len(left), len(right)))
    for r in rows:
        table[left.index(r[a]), right.index(r[b])] = r["count"]
    if len(left) > len(right):
        table = table.T
    n, m = table.sum(1), table.sum(0)
    k = max(len(left), len(right))
    share = table / np.maximum(n[:, None], m[None])
    chosen = assignment(share)
    s = share[np.arange(len(n)), chosen].sum()
    big, small = np.sort(m)[::-1], np.sort(n)[::-1]
    expected = sum(small[i] * big[i] / table.sum() / max(small[i], big[i]) for i in range(len(small)))
    if len(left) == len(right) == 1:
        return 1.0
    return float((s - expected) / (k - expected)) if s >= expected else 0.0


def pca(points: DataFrame, d: int, centre: bool = True) -> DataFrame:
    """(id, features): projections on the first d principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = points.select("id", array_to_vector(F.col("features").cast("array<double>")).alias("x"))
    if centre:
        own = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(own).transform(own).select("id", F.col("c").alias("x"))
    return PCA(k=d, inputCol="x", outputCol="p").fit(own).transform(own).select("id", vector_to_array("p").alias("features"))


def pca_shares(points: DataFrame, d: int) -> DataFrame:
    """(component, variance, share): variances along the first d principal components of points (id, features), and their shares of all variance in percent. A task sends one table of sums of products."""
    own = points.select(F.col("features").cast("array<double>").alias("features"))
    width = (own.select(F.size("features")).first() or [0])[0]
    facts = own.agg(F.count("*"), *(F.avg(F.col("features")[k]) for k in range(width))).first()
    mean = np.array(facts[1:], float)

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean if b.num_rows else np.zeros((0, width))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    sums = own.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(width * width)
    total[sums["place"]] = sums["value"]
    values = np.linalg.eigvalsh(total.reshape(width, width) / max(facts[0] - 1, 1))[::-1]
    whole = max(float(values.sum()), 1e-300)
    return points.sparkSession.createDataFrame([(k + 1, float(v), float(100 * v / whole)) for k, v in enumerate(values[:d])], "component int, variance double, share double")


def classifier_accuracy(points: DataFrame, seed: int = 0, hidden: list[int] | None = None, share: float = 0.8) -> tuple[float, float]:
    """Accuracy on training and other rows of a logistic regression of label, or of a perceptron with hidden layers."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    own = points.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), F.xxhash64("id", F.lit(seed)).alias("h"))
    train, test = own.where(F.pmod("h", F.lit(1000)) < int(share * 1000)), own.where(F.pmod("h", F.lit(1000)) >= int(share * 1000))
    if hidden is None:
        model = LogisticRegression(family="multinomial", regParam=1e-3).fit(train)
    else:
        width, kinds = own.first()["features"].size, int(own.agg(F.max("label")).first()[0]) + 1
        model = MultilayerPerceptronClassifier(layers=[width, *hidden, kinds], seed=seed).fit(train)
    return tuple(model.transform(x).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] for x in (train, test))


def poisson_regression(df: DataFrame, target: str, inputs: list[str]) -> DataFrame:
    """df with prediction, by a generalised linear model with log link."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    own = VectorAssembler(inputCols=inputs, outputCol="_x").transform(df)
    return GeneralizedLinearRegression(family="poisson", featuresCol="_x", labelCol=target).fit(own).transform(own).drop("_x")
