"""Every query of the catalogue against its SQL on the smallest tables, and that it runs where there is none."""

import glob
import os

import duckdb
import numpy as np
import pytest

from graticule.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def finite(rows, *names, size=None):
    values = np.array([np.ravel(r[n]) for r in rows for n in names], float)
    return len(rows) > 0 and np.isfinite(values).all() and (size is None or values.shape[1] == size)


#: What is asserted of queries without SQL: f(rows, points) with points (id to label).
CHECKS = {
    "knn_lsh_l2": lambda rows, p: len({r.i for r in rows}) == len(p) and all(r.dist >= 0 and r.rank <= 15 for r in rows) and sum(r.i == r.j for r in rows) == len(p),
    "knn_descent": lambda rows, p: {r.i for r in rows} == set(p) and len(rows) == 15 * len(p) and all(r.i == r.j and r.dist == 0 for r in rows if r.rank == 1) and len({(r.i, r.j) for r in rows}) == len(rows),
    "knn_descent_recall": lambda rows, p: len(rows) == 1 and rows[0].queries == sum(i % 20 == 0 for i in p) and rows[0].recall >= 0.95,
    "spectral_by_joins": lambda rows, p: [r.place for r in rows] == [0, 1, 2, 3] and abs(rows[0].eigenvalue) < 1e-3 and all(0 <= r.residual < 1e-2 and -1e-6 <= r.eigenvalue <= 2 for r in rows),
    "stress_descent": lambda rows, p: {r.at for r in rows} == {"start", "end"} and {r.at: r.mse for r in rows}["end"] < {r.at: r.mse for r in rows}["start"],
    "single_linkage": lambda rows, p: {r.id: r.cluster for r in rows}.keys() == p.keys() and len({(r.cluster, p[r.id]) for r in rows}) == len(set(p.values())) == len({r.cluster for r in rows}),
    "communities": lambda rows, p: {r.id for r in rows} == set(p) and len({(r.community, p[r.id]) for r in rows}) == len({r.community for r in rows}) >= len(set(p.values())) and rows[0].modularity > 0.8 and all(r.community <= r.id for r in rows),
    "doublet_scores": lambda rows, p: {r.id for r in rows} == set(p) and all(0 <= r.score <= 1 and 0 <= r.n_simulated <= 30 for r in rows),
    "accuracy_by_dimension": lambda rows, p: [(r.method, r.d) for r in rows] == [("pca", 2), ("pca", 8), ("isomap", 2), ("isomap", 8)] and all(r.best_round < r.rounds <= 60 for r in rows) and rows[1].test > 0.9 and rows[1].test > rows[0].test,
    "linkage_selection": lambda rows, p: {r.rule: r.k for r in rows} == {"elbow": len(set(p.values())), "inconsistency": len(set(p.values()))},
    "phi_half_normal": lambda rows, p: len(rows) > len(p) and all(r.dist >= 0 for r in rows),
    "phi_log_normal": lambda rows, p: len(rows) > len(p) and all(r.dist >= 0 for r in rows),
    "cluster_hulls": lambda rows, p: {r.cluster for r in rows} == set(p.values()) and finite(rows, "x", "y"),
    "embed_isomap": lambda rows, p: {r.id for r in rows} == set(p) and finite(rows, "init", "embedding", size=2) and all(r.init == r.embedding for r in rows),
    "embed_metric": lambda rows, p: {r.id for r in rows} == set(p) and finite(rows, "init", "embedding", size=2),
    "cluster_embed": lambda rows, p: {r.id for r in rows} == set(p) and finite(rows, "x", "y") and len({r.cluster for r in rows}) == 10,
    "cluster_landmarks": lambda rows, p: len({r.id for r in rows}) == len(rows) == 6000 and finite(rows, "x", "y") and len({r.cluster for r in rows}) == 8,
    "embed_landmarks": lambda rows, p: len({r.id for r in rows}) == len(rows) == 6000 and finite(rows, "init", "embedding", size=2),
    "linkage_clusters": lambda rows, p: {r.id for r in rows} == set(p) and {r.cluster for r in rows} == set(range(1, 11)),
    "kmeans": lambda rows, p: {r.id for r in rows} == set(p) and {r.cluster for r in rows} <= set(range(1, 11)) and len({r.cluster for r in rows}) > 5,
    "pca": lambda rows, p: {r.id for r in rows} == set(p) and finite(rows, "features", size=8) and (np.diff(np.var([r.features for r in rows], axis=0)) <= 1e-9).all(),
    "pair_sets_index": lambda rows, p: len(rows) == 1 and 0 <= rows[0].psi <= 1,
    "classifier_accuracy": lambda rows, p: len(rows) == 1 and 0 <= rows[0].test <= 1 and rows[0].train > 0.3,
    "poisson_regression": lambda rows, p: abs(np.mean([r.prediction for r in rows]) - np.mean([r.l_quantity for r in rows])) < 1e-3 * len(rows) ** 0.5,
    "spectral_embedding": lambda rows, p: {r.id for r in rows} == set(p) and finite(rows, "embedding", size=2),
    "denoised_sample": lambda rows, p: len({r.id for r in rows}) == len(rows) == min(100, len(p)) and all(a.strength >= b.strength - 1e-9 for a, b in zip(rows, rows[1:])),
    "radial_sample": lambda rows, p: {r.id for r in rows} == set(p) and 0 < sum(r.chosen for r in rows) <= len(p) / 10 + 1,
    "smooth_rate_map": lambda rows, p: len(rows) == 25 and finite(rows, "parameter"),
}


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = df.collect()
    got = [tuple(plain(r[c]) for c in columns) for r in rows]
    if name not in catalogue.SQL:
        table = duck.execute("SELECT vec_id, label FROM embeddings").fetchall()
        assert CHECKS[name](rows, dict(table))
        return
    result = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert sorted(names) == columns and sorted(map(repr, got)) == sorted(map(repr, want))


def test_metric_embedding_has_the_defaults_of_the_operator(spark, monkeypatch):
    given = []
    monkeypatch.setattr(catalogue.embed, "embed", lambda *a, **b: given.append((a[1:], b)))
    catalogue.QUERIES["embed_metric"](spark, FOLDER)
    assert given == [((catalogue.K, 2), {})]
