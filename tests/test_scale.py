"""Operators that work beyond what one task holds, against dense or sequential versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.operators import clusters, communities, descent, doublets, eigen, grids, mds, paths, series, spanning, training
from graticule.operators.knn import knn, nearest_by_few, nearest_of
from graticule.plans import embed


def cloud(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, features array<double>")


def pairs_of(spark, m, name="dist"):
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if np.isfinite(m[i, j])]
    return spark.createDataFrame(rows, f"i long, j long, {name} double")


def apart(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def sheet(n, seed=0):
    return np.random.default_rng(seed).uniform(size=(n, 3)) * [4, 2, 0.2]


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_largest_eigenvalues(spark, monkeypatch, sent):
    monkeypatch.setattr(eigen, "SENT_BYTES", sent)
    draw = np.random.default_rng(0)
    a = draw.normal(size=(60, 60)) * (draw.uniform(size=(60, 60)) < 0.2)
    a = a + a.T + np.diag(np.arange(60) / 4)
    rows = pairs_of(spark, np.where(a == 0, np.nan, a), "value")
    found = eigen.largest(rows, 3)
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(found.values, values[::-1][:3], atol=1e-5)
    got = np.array([r.vector for r in found.vectors.orderBy("id").collect()])
    assert np.abs(a @ got - got * found.values).max() < 1e-3 and np.allclose(got.T @ got, np.eye(3), atol=1e-6)
    assert (got[np.abs(got).argmax(0), range(3)] > 0).all()


def test_products_send_no_vectors(spark, monkeypatch):
    def sent(table):
        raise AssertionError("sent through the driver")

    monkeypatch.setattr(eigen.F, "broadcast", sent)
    monkeypatch.setattr(eigen, "SLICE", 5)
    monkeypatch.setattr(eigen, "BLOCK_ENTRIES", 40)
    draw = np.random.default_rng(1)
    a = draw.normal(size=(24, 24)) * (draw.uniform(size=(24, 24)) < 0.3)
    a = a + a.T + np.diag(np.arange(24) / 4)
    centred = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    found = eigen.largest(pairs_of(spark, np.where(a == 0, np.nan, a), "value"), 3, centred=True)
    got = np.array([r.vector for r in found.vectors.orderBy("id").collect()])
    assert np.allclose(found.values, np.linalg.eigvalsh(centred)[::-1][:3], atol=1e-5) and np.abs(centred @ got - got * found.values).max() < 1e-3


def test_eigenvalues_of_small_and_empty_matrices(spark):
    one = eigen.largest(spark.createDataFrame([(5, 5, 2.0)], "i long, j long, value double"), 3)
    assert np.allclose(one.values, [2.0]) and [tuple(r) for r in one.vectors.collect()] == [(5, [1.0])]
    zeros = eigen.largest(spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0)], "i long, j long, value double"), 1)
    assert np.allclose(zeros.values, [0.0])


def test_scaling_by_joins_is_scaling(spark):
    m = apart(sheet(60))
    got = np.array([r.init for r in eigen.classical_by_joins(pairs_of(spark, m), 2).orderBy("id").collect()])
    assert np.abs(got - mds.classical(m**2, 2)).max() < 1e-3


def test_spectral_by_joins_is_spectral(spark):
    near = knn(cloud(spark, sheet(120)), 8)
    dense = np.array([r.embedding for r in grids.spectral(near, 2).orderBy("id").collect()])
    got, found = eigen.spectral_by_joins(near, 2)
    got = np.array([r.embedding for r in got.orderBy("id").collect()])
    assert abs(found.values[0] - 1) < 1e-6 and (found.residuals < 1e-4).all()
    assert all(abs(np.corrcoef(got[:, k], dense[:, k])[0, 1]) > 0.9999 for k in range(2))


@pytest.mark.parametrize("loss", ["MSE", "Sammon", "Sammon2", "ratio"])
def test_descent_by_joins_lowers_each_loss(spark, loss):
    m = apart(sheet(50) * [1, 1, 8])
    start = mds.classical(m**2, 2)
    table = pairs_of(spark, m)
    places = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(start)], "id long, init array<double>")
    log = []
    end = np.array([r.embedding for r in mds.descend_by_joins(table, places, 2, epochs=12, share=0.5, loss=loss, log=log).orderBy("id").collect()])
    value = lambda y: mds.losses(m, apart(y), loss)[0]
    assert value(end) < value(start) and len(log) == 12


def test_descent_by_joins_beyond_one_task(spark):
    """6000 points by their distances to landmarks: the loss falls below that of the landmarks' own placement."""
    draw = np.random.default_rng(3)
    x = draw.uniform(size=(6000, 3)) * [4, 2, 1]
    marks = draw.choice(6000, 20, replace=False)
    rows = [(i, int(j), float(np.sqrt(((x[i] - x[j]) ** 2).sum()))) for i in range(6000) for j in marks]
    table = spark.createDataFrame(rows, "i long, j long, dist double").repartition(8).persist()
    whole = spark.range(6000).select("id", F.lit(0).cast("long").alias("component"))
    placed = mds.by_landmarks(table, whole, 2).persist()
    end = mds.descend_by_joins(table, placed.select("id", F.col("embedding").alias("init")), 2, epochs=25)
    target = np.array([r[2] for r in rows]).reshape(6000, 20)

    def loss(df, name):
        y = np.array([r[name] for r in df.orderBy("id").collect()])
        return ((np.sqrt(((y[:, None] - y[marks][None]) ** 2).sum(-1)) - target) ** 2).mean()

    assert loss(end, "embedding") < loss(placed, "embedding")


def test_ways_of_embedding(spark):
    x = sheet(90)
    own = cloud(spark, x)
    got = {}
    for way in ("dense", "landmarks", "joins"):
        rows = embed.embed(own, 10, 2, metric=False, way=way, landmarks=60, normalise=False, beyond=False).orderBy("id").collect()
        assert {r.way for r in rows} == {way} and [r.id for r in rows] == list(range(90))
        got[way] = apart(np.array([r.init for r in rows])).ravel()
    assert np.allclose(got["dense"], got["joins"], atol=1e-3) and np.corrcoef(got["dense"], got["landmarks"])[0, 1] > 0.99
    with pytest.raises(ValueError, match="way"):
        embed.embed(own, 10, 2, way="none")


def test_tables_of_distances_go_by_joins_beyond_one_task(spark, monkeypatch):
    m = apart(np.vstack([sheet(30), sheet(20, 1) + 100]))
    table = pairs_of(spark, m)
    dense = embed.embed(table, 8, 2, metric=False, distances=True).orderBy("id").collect()
    monkeypatch.setattr(mds, "DENSE", 25)
    joins = embed.embed(table, 8, 2, metric=False, distances=True).orderBy("id").collect()
    assert {r.way for r in joins} == {"joins"} and {r.component for r in joins} == {r.component for r in dense} == {0, 30}
    for c in (0, 30):
        a, b = (apart(np.array([r.init for r in rows if r.component == c])) for rows in (dense, joins))
        assert np.allclose(a, b, atol=1e-3)


def test_clusters_scaled_one_by_one(spark):
    draw = np.random.default_rng(0)
    x = np.vstack([draw.normal(size=(20, 3)) + c for c in ([0, 0, 0], [12, 0, 0], [0, 12, 0])])
    table = pairs_of(spark, apart(x))
    done = embed.cluster_embed(table, 30, 3, distances=True, together=False, normalise=False, beyond=False)
    rows = sorted(done.points.collect(), key=lambda r: r.id)
    assert len(rows) == 60 and {r.cluster for r in rows} == {1, 2, 3}
    y = np.array([[r.x, r.y] for r in rows])
    for c in range(3):  # each cluster is its own scaling, moved and turned as a whole
        own = slice(20 * c, 20 * c + 20)
        near = np.array([[r.dist for r in table.where(f"i = {i}").orderBy("j").collect()] for i in range(20 * c, 20 * c + 20)])[:, own]
        assert np.corrcoef(apart(y[own]).ravel(), apart(mds.classical(near**2, 2)).ravel())[0, 1] > 0.98


def kruskal(n, edges):
    parent, out = list(range(n)), []

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for d, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in edges if a != b):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b, d))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_spanning_forest_is_kruskals(spark, seed):
    draw = random.Random(seed)
    n = 150
    edges = [(draw.randrange(n), draw.randrange(n), float(draw.randrange(12))) for _ in range([400, 120, 1000][seed])]
    df = spark.createDataFrame([*edges, (0, 1, None), (0, 2, math.nan)], "src long, dst long, dist double")
    forest = spanning.spanning_forest(df).persist()
    want = kruskal(n, edges)
    assert sorted(map(tuple, forest.collect())) == want
    nodes = spark.range(n)
    bars = {r.death: r.n for r in spanning.deaths(nodes, forest).collect()}
    assert sum(bars.values()) == n and bars[None] == n - len(want)
    curve = {r.threshold: r.components for r in spanning.betti_curve(nodes, forest, [-1.0, 0.0, 5.0, 99.0]).collect()}
    assert curve == {t: n - sum(d <= t for *_, d in want) for t in (-1.0, 0.0, 5.0, 99.0)}


def test_spanning_forest_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long, dist double")
    assert spanning.spanning_forest(none).collect() == []
    assert [tuple(r) for r in spanning.single_linkage(spark.range(3), none, 2).orderBy("id").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_single_linkage_is_that_of_all_distances(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(80, 2)) + 6 * np.eye(2)[draw.integers(0, 2, 80)]
    m = apart(x)
    edges = pairs_of(spark, m).select(F.col("i").alias("src"), F.col("j").alias("dst"), "dist")
    z = clusters.linkage(m, "single")
    nodes = spark.range(80)
    for k in (1, 5):
        got = [r.cluster for r in spanning.single_linkage(nodes, edges, k).orderBy("id").collect()]
        assert got == clusters.cut(z, k).tolist()
    assert np.allclose(sorted(d for *_, d in spanning.spanning_forest(edges).collect()), z[:, 2])
    forest = spanning.spanning_forest(edges)
    assert spanning.chosen_k(forest, 1) == clusters.choose_k(m, z, by="elbow")
    assert spanning.chosen_k(forest, 1, "inconsistency") >= 2


def test_thinning_in_parallel_is_thinning_one_by_one(spark):
    draw = random.Random(5)
    n = 6000
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(20_000)] + [(0, k) for k in range(1, 2000)]
    priority = [draw.choice([None, 0.0, 1.0, draw.random()]) for _ in range(n)]
    near = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = set()
    for v in sorted(range(n), key=lambda v: (-(-math.inf if priority[v] is None else priority[v]), v)):
        if not (near[v] - {v}) & want:
            want.add(v)
    points = spark.createDataFrame(list(enumerate(priority)), "id long, priority double")
    got = grids.thinned(points, spark.createDataFrame(edges, "i long, j long"))
    assert {r.id for r in got.collect() if r.chosen} == want


def test_intervals_of_all_lengths(spark):
    draw = random.Random(6)
    spans = [(k, draw.uniform(-1e6, 1e6)) for k in range(300)]
    spans = [(k, s, s + 2 ** draw.uniform(0, 28) * draw.choice([1, 1, 0, -1])) for k, s in spans] + [(300, -3.2e8, 3.2e8), (301, 5.0, None), (302, 64.0, 128.0), (303, None, 9.0)]
    times = [draw.uniform(-2e6, 2e6) for _ in range(400)] + [64.0, 128.0, 127.99, None]
    events = spark.createDataFrame(list(enumerate(times)), "id long, t double")
    intervals = spark.createDataFrame(spans, "name long, start double, end double")
    want = sorted((i, k) for i, t in enumerate(times) for k, s, e in spans if None not in (t, s, e) and s <= t < e)
    for indexed in (True, False):
        assert sorted((r.id, r.name) for r in series.in_intervals(events, intervals, "t", indexed=indexed).collect()) == want
        outside = sorted(r.id for r in series.in_intervals(events, intervals.where("name < 250"), "t", outside=True, indexed=indexed).collect())
        assert outside == sorted(set(range(len(times))) - {i for i, k in want if k < 250})
    index, levels = series._levels(intervals)
    assert index.groupBy("name").count().agg(F.max("count")).first()[0] <= 2 and len(levels) < 40
    none = intervals.where("false")
    assert series.in_intervals(events, none, "t", indexed=True).count() == 0
    assert series.in_intervals(events, none, "t", outside=True, indexed=True).count() == len(times)


@pytest.mark.parametrize("sigma", [0.5, 100.0, 3000.0])
def test_smoothing_of_any_width(spark, sigma):
    draw = random.Random(7)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(-20_000, 20_000), draw.choice([1.0, 2.5, None])) for _ in range(500)] + [("a", None, 1.0), ("a", 4096, 1.0), ("a", 4096, 2.0), ("a", 4095, 7.0), ("a", 8191, 1.0)]
    got = series.gaussian_smoothed(spark.createDataFrame(rows, "k string, at long, v double"), "k", "at", "v", sigma).collect()
    reach = math.ceil(5 * sigma)

    def value(k, at):
        if at is None:
            return None
        return sum((v or 0) * math.exp(-((a - at) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi)) for q, a, v in rows if q == k and a is not None and abs(a - at) <= reach)

    assert len(got) == len(rows)
    assert all((r.smooth is None and r["at"] is None) or abs(r.smooth - value(r.k, r["at"])) < 1e-9 for r in got)


def test_rolling_keeps_null_keys(spark):
    rows = [(None, 1, 10), (None, 2, 20), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3)]
    got = series.rolled(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", "v", 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, 10, 20), (None, 2, 20, 10), ("a", 1, 1, 3), ("a", 2, 2, 1), ("a", 3, 3, 2)], key=str)


def test_communities_are_planted_blocks(spark):
    draw = random.Random(8)
    block = [k % 6 for k in range(240)]
    edges = [(a, b, 1.0) for a in range(240) for b in range(a) if draw.random() < (0.35 if block[a] == block[b] else 0.01)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r.id: r.community for r in communities.communities(df).collect()}
    assert len(got) == 240 and len({(block[v], c) for v, c in got.items()}) == len(set(got.values())) == 6
    assert all(c == min(v for v in got if got[v] == c) for c in set(got.values()))
    finer = communities.communities(df, resolution=8.0).select("community").distinct().count()
    assert finer > 6
    graph = communities.symmetric(df)
    labels = spark.createDataFrame(list(enumerate(block)), "id long, community long")
    m = np.zeros((240, 240))
    for a, b, w in edges:
        m[a, b] += w
        m[b, a] += w
    k = m.sum(1)
    same = np.equal.outer(block, block)
    want = ((m - 0.5 * np.outer(k, k) / m.sum()) * same).sum() / m.sum()
    assert abs(communities.modularity(graph, labels, 0.5).first()[0] - want) < 1e-9
    assert communities.communities(df.where("false")).collect() == []


def test_planted_doublets_score_above_the_rest(spark):
    draw = np.random.default_rng(9)
    kind = draw.integers(0, 4, 300)
    x = draw.normal(size=(300, 8)) * 0.3 + 6 * np.eye(8)[kind]
    other = np.array([draw.choice(np.flatnonzero(kind != kind[k])) for k in range(20)])
    x = np.vstack([x, (x[:20] + x[other]) / 2])
    scores = doublets.doublet_scores(cloud(spark, x), k=20).persist()
    found = {r.id: r.score for r in scores.collect()}
    assert len(found) == 320 and np.mean([found[i] for i in range(300, 320)]) > 3 * np.mean([found[i] for i in range(300)])
    flagged = {r.id for r in doublets.doublets(scores).collect() if r.doublet}
    assert len(flagged & set(range(300, 320))) >= 15
    assert [r["rank"] for r in doublets.ranked(scores, 3).collect()] == [1, 2, 3]
    made = doublets.simulated(cloud(spark, x), 1, seed=3)
    assert {tuple(r) for r in made.select("id", "a", "b").collect()} == {tuple(r) for r in doublets.simulated(cloud(spark, x).repartition(7), 1, seed=3).select("id", "a", "b").collect()}


def test_training_stops_and_keeps_the_best(spark):
    draw = np.random.default_rng(10)
    label = draw.integers(0, 3, 400)
    x = draw.normal(size=(400, 5)) + 4 * np.eye(5)[label]
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i]) * 10) for i in range(400)] + [(900, None, 10), (901, [0.0] * 5, None)], "id long, features array<double>, label long")
    model = training.train(rows, rounds=40, patience=3)
    checks = [c for _, c in model.losses]
    assert model.best == int(np.argmin(np.round(checks, 12))) or checks[model.best] - min(checks) < 1e-4
    assert len(checks) <= 40 and set(model.labels) == {0, 10, 20}
    right = training.predicted(rows.where("id < 400"), model).select(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.95
    ring = [(i, [math.cos(i) * (1 + i % 2), math.sin(i) * (1 + i % 2)], i % 2) for i in range(300)]
    wide = training.train(spark.createDataFrame(ring, "id long, features array<double>, label long"), hidden=[12], rounds=40, share=1.0)
    assert wide.losses[wide.best][1] < 0.35 < training.train(spark.createDataFrame(ring, "id long, features array<double>, label long"), rounds=10).losses[-1][1]


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(11)
    model = training.Classifier([(draw.normal(size=(3, 4)), draw.normal(size=4)), (draw.normal(size=(4, 2)), draw.normal(size=2))], np.arange(2), np.zeros(3), np.ones(3))
    x, y = draw.normal(size=(6, 3)), draw.integers(0, 2, 6)
    _, grads = model.gradient(x, y)
    w = model.layers[0][0]
    w[1, 2] += 1e-6
    up = model.gradient(x, y)[0]
    w[1, 2] -= 2e-6
    assert abs((up - model.gradient(x, y)[0]) / 2e-6 - grads[0][0][1, 2]) < 1e-4


def _grid_edges(spark):
    draw = np.random.default_rng(5)
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(draw.integers(0, 40, 120), draw.integers(0, 40, 120), draw.uniform(size=120), strict=True)], "src long, dst long, dist double")


def test_relaxed_paths_of_a_graph_that_is_sent_store_no_pairs(spark, monkeypatch):
    stored = []
    kept = paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, name: stored.append(df.columns) or kept(df, name))
    graph = paths.undirected(_grid_edges(spark))
    got = {(r.i, r.j): r.dist for r in paths.relaxed(graph, spark.createDataFrame([(1,), (7,), (99,)], "i long")).collect()}
    assert got[99, 99] == 0.0 and {i for i, _ in got} == {1, 7, 99}  # a source without an edge, too
    assert not any("i" in columns and "j" in columns for columns in stored)
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
    assert {(r.i, r.j): round(r.dist, 9) for r in paths.relaxed(graph, spark.createDataFrame([(1,), (7,), (99,)], "i long")).collect()} == {p: round(v, 9) for p, v in got.items()}


def test_paths_by_joins_hold_some_sources_at_a_time(spark, monkeypatch):
    graph = paths.undirected(_grid_edges(spark))
    sources = spark.range(0, 40, 12).select(F.col("id").alias("i"))
    want = {(r.i, r.j): round(r.dist, 9) for r in paths.relaxed(graph, sources).collect()}
    rows = []
    kept = paths.materialise
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(paths, "JOINED_PAIRS", 80)  # two sources of 40 nodes
    monkeypatch.setattr(paths, "materialise", lambda df, name: (out := kept(df, name)) is not None and (rows.append(out.count()) if name == "part" else None) or out)
    assert {(r.i, r.j): round(r.dist, 9) for r in paths.relaxed(graph, sources).collect()} == want
    assert max(rows) <= 80


def _sequential_sample(x, k, now=0):
    left, chosen = np.arange(len(x)), []
    while True:
        chosen.append(now)
        d = np.sqrt(((x[left] - x[now]) ** 2).sum(1))
        beyond = d > np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]
        left, d = left[beyond], d[beyond]
        if len(left) <= k:
            return chosen
        now = int(left[d.argmin()])


@pytest.mark.parametrize("kind", ["cloud", "equal points"])
def test_radial_sample_of_any_number_of_points(spark, monkeypatch, kind):
    monkeypatch.setattr(grids, "DENSE", 50)
    draw = np.random.default_rng(11)
    x = draw.normal(size=(300, 3)) if kind == "cloud" else draw.integers(0, 3, (300, 2)).astype(float)
    for start in (None, 17):
        got = grids.radial_sample(cloud(spark, x), 3, start).orderBy("id").collect()
        assert [r.id for r in got if r.chosen] == sorted(_sequential_sample(x, 3, start or 0)) and len(got) == 300


def test_nearest_by_few_is_nearest_of(spark):
    points = cloud(spark, np.random.default_rng(2).integers(0, 4, (200, 3)))
    asked = points.where("id % 7 = 0")
    assert sorted(nearest_by_few(asked, points, 9).collect()) == sorted(nearest_of(asked, points, 9).collect())


def test_descent_brings_a_vector_to_each_part_once(spark, monkeypatch):
    points = cloud(spark, np.random.default_rng(4).normal(size=(500, 6)))
    want = sorted(descent.knn_descent(points, 5, pool=8, leaf=50).collect())
    tables = {}
    kept = descent.materialise

    def noted(df, name):
        tables[name] = kept(df, name)
        return tables[name]

    monkeypatch.setattr(descent, "materialise", noted)
    monkeypatch.setattr(descent, "drop", lambda *tables: None)
    monkeypatch.setattr(descent, "SENT_BYTES", 0)
    monkeypatch.setattr(descent, "PART", 100)
    assert sorted(descent.knn_descent(points, 5, pool=8, leaf=50).collect()) == want
    lists = tables["members"]  # a row a point, not one with a vector for each of its neighbours
    assert lists.count() == lists.select("v").distinct().count() and "vec" not in lists.columns and lists.select("part").distinct().count() > 2


def test_embeddings_of_several_dimensions_share_one_landmark_table(spark, monkeypatch):
    points = cloud(spark, sheet(150, 3))
    how = {"normalise": False, "beyond": False}
    want = [sorted((r.id, tuple(round(v, 6) for v in r.init)) for r in embed.embed(points, 8, d, metric=False, way="landmarks", landmarks=20, **how).collect()) for d in (1, 2)]
    made = embed._landmark_table(points, 8, 20, **how)
    monkeypatch.setattr(embed, "build_graph", None)
    got = [sorted((r.id, tuple(round(v, 6) for v in r.init)) for r in embed.embed(points, 8, d, metric=False, way="landmarks", landmarks=20, made=made, **how).collect()) for d in (1, 2)]
    assert got == want
