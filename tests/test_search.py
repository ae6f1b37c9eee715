"""Neighbour searches by pivots and by descent against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.operators import descent, pivots
from graticule.operators.knn import knn
from graticule.plans import embed


def cloud(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, features array<double>")


def brute(x, k, metric):
    if metric == "l2":
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    else:
        n = np.linalg.norm(x, axis=1)
        norms = n[:, None] * n
        d = 1 - np.divide(x @ x.T, norms, out=np.zeros_like(norms), where=norms > 0)
    return {(i, rank + 1): (j, d[i, j]) for i in range(len(x)) for rank, j in enumerate(sorted(range(len(x)), key=lambda j: (j != i, round(d[i, j], 9), j))[:k])}


def shapes():
    draw = np.random.default_rng(0)
    copies = draw.normal(size=(400, 5))
    copies[::3] = copies[0]
    copies[[5, 7, 9]] = 0
    return {"even": draw.normal(size=(500, 8)), "ties": np.round(draw.normal(size=(500, 3))), "copies": copies, "few": draw.normal(size=(4, 3)), "zeros": np.zeros((5, 3))}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("name, k", [("even", 5), ("ties", 15), ("copies", 6), ("few", 6), ("zeros", 3)])
def test_pivots_find_all_neighbours(spark, monkeypatch, name, k, metric):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    x = shapes()[name]
    got = {(r.i, r["rank"]): (r.j, r.dist) for r in pivots.knn_pivots(cloud(spark, x), k, metric).collect()}
    want = brute(x, k, metric)
    assert got.keys() == want.keys()
    # Directions that differ by rounding alone have no order.
    rounding = metric == "cosine" and name == "ties"
    assert all((rounding or got[key][0] == want[key][0]) and abs(got[key][1] - want[key][1]) < 1e-7 for key in want)


def test_pivots_without_sending_blocks_and_without_points(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    monkeypatch.setattr(pivots, "SENT_BYTES", 0)
    x = shapes()["copies"]
    got = {(r.i, r["rank"]): r.j for r in pivots.knn_pivots(cloud(spark, x), 6).collect()}
    assert got == {key: j for key, (j, _) in brute(x, 6, "l2").items()}
    assert pivots.knn_pivots(cloud(spark, x).where("false"), 3).collect() == []


def test_pivots_leave_cells_out(spark, monkeypatch):
    """Of ten clusters: less than a quarter of all pairs is compared."""
    monkeypatch.setattr(pivots, "BLOCK", 64)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 10)) * 0.05 + 10 * np.eye(10)[draw.integers(0, 10, 2000)]
    work = pivots.pivot_work(cloud(spark, x), 15).first()
    assert work.points == 2000 and work.compared < 2000 * 2000 / 4


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_descent_finds_nearly_all(spark, monkeypatch, sent):
    monkeypatch.setattr(descent, "SENT_BYTES", sent)
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    own = own if sent else own.where("id < 600")
    log = []
    found = descent.knn_descent(own, 15, log=log).persist()
    row = descent.recall(found, own, 15).first()
    print(f"recall {row.recall:.4f} of {row.queries} queries, {len(log)} rounds")
    assert row.recall >= 0.95 and found.groupBy("i").count().where("count <> 15").isEmpty()
    exact = {(r.i, r.j): r.dist for r in knn(own, 15).collect()}
    both = [(exact[r.i, r.j], r.dist) for r in found.collect() if (r.i, r.j) in exact]
    assert len(both) > 0.95 * len(exact) and max(abs(a - b) for a, b in both) < 1e-6


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_descent_with_copies_and_zeros(spark, metric):
    x = shapes()["copies"]
    got = descent.knn_descent(cloud(spark, x), 6, metric, leaf=50).collect()
    want = brute(x, 6, metric)
    assert len(got) == len(want) and {(r.i, r["rank"]) for r in got} == want.keys()
    same = sum(abs(r.dist - want[r.i, r["rank"]][1]) < 1e-6 for r in got)
    assert same > 0.97 * len(got)
    few = descent.knn_descent(cloud(spark, x[:3]), 6, metric).collect()
    assert len(few) == 9
    assert descent.knn_descent(cloud(spark, x).where("false"), 6, metric).collect() == []


def test_graphs_by_each_search(spark):
    draw = np.random.default_rng(2)
    own = cloud(spark, draw.normal(size=(300, 4)))
    graphs = [{(r.src, r.dst): round(r.dist, 5) for r in embed.build_graph(own, 8, search=s).collect()} for s in ("blocks", "pivots", "descent")]
    assert graphs[0] == graphs[1]
    assert len(graphs[0].keys() & graphs[2].keys()) > 0.98 * len(graphs[0])
