"""Known answers and properties of the manifold operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.functions import phi as phis
from graticule.functions import tconorms
from graticule.operators import clusters, counts, evaluate, fuzzy, grids, mds, paths, separation, series
from graticule.operators.knn import knn, pairwise, top_k
from graticule.plans import embed
from graticule.sources import generators, tables
from graticule.streaming import windows


def cloud(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, features array<double>")


def table(spark, m):
    return spark.createDataFrame([(i, j, float(m[i][j])) for i in range(len(m)) for j in range(len(m)) if np.isfinite(m[i][j])], "i long, j long, dist double")


def distances(x):
    x = np.asarray(x, float)
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_path_graph_geodesics(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(3)], "src long, dst long, dist double")
    got = {(r.i, r.j): r.dist for r in paths.geodesics(edges).collect()}
    assert got == {(i, j): abs(i - j) for i in range(4) for j in range(4)}
    relaxed = paths.relaxed(paths.undirected(edges), spark.range(4).select(F.col("id").alias("i")))
    assert {(r.i, r.j): r.dist for r in relaxed.collect()} == got
    directed = {(r.i, r.j): r.dist for r in paths.geodesics(edges, directed=True).collect()}
    assert directed == {(i, j): j - i for i in range(4) for j in range(i, 4)}


def test_geodesics_satisfy_the_triangle_inequality(spark):
    x = np.random.default_rng(0).normal(size=(40, 3))
    m = np.full((40, 40), np.inf)
    for r in embed.distance_table(cloud(spark, x), 6).collect():
        m[r.i, r.j] = r.dist
    assert np.allclose(m, m.T) and (m[:, None, :] <= m[:, :, None] + m[None] + 1e-9).all()


def test_two_cliques_are_two_components(spark):
    x = [(a, b) for a in range(2) for b in range(3)] + [(a + 100, b) for a in range(2) for b in range(3)]
    out = embed.embed(cloud(spark, x), 5, 2, metric=False).collect()
    assert {r.id: r.component for r in out} == {i: 0 if i < 6 else 6 for i in range(12)}
    y = np.array([r.init for r in sorted(out, key=lambda r: r.id)])
    assert abs(np.linalg.norm(y[:6].mean(0) - y[6:].mean(0)) - 100) < 1
    with pytest.raises(ValueError, match="2 components"):
        embed.embed(cloud(spark, x), 5, 2, split=False)


def test_classical_scaling_recovers_a_square():
    x = np.array([(0, 0), (0, 1), (1, 0), (1, 1)], float)
    y = mds.classical(distances(x) ** 2, 2)
    assert np.allclose(distances(y), distances(x))
    assert mds.classical(distances(x[:2]) ** 2, 4).shape == (2, 4)


def test_descent_lowers_the_loss():
    x = np.random.default_rng(1).normal(size=(60, 4))
    target, start = distances(x), np.random.default_rng(2).normal(size=(60, 2))
    for loss in ("MSE", "Sammon", "Sammon2", "ratio"):
        end = mds.descend(target + np.eye(60) * 0, start, epochs=60, loss=loss, batch=20)
        off = ~np.eye(60, dtype=bool)
        assert mds.losses(target[off], distances(end)[off], loss)[0] < mds.losses(target[off], distances(start)[off], loss)[0]
    assert mds.descend(target[:4, :4], start[:4]) is not None


@pytest.mark.parametrize("kind", ["MSE", "Sammon", "Sammon2", "ratio"])
def test_derivatives_of_losses(kind):
    draw = np.random.default_rng(3)
    t, f = draw.uniform(0.5, 2, 9), draw.uniform(0.5, 2, 9)
    _, slope = mds.losses(t, f, kind)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        assert abs((mds.losses(t, f + step, kind)[0] - mds.losses(t, f - step, kind)[0]) / 2e-6 - slope[k]) < 1e-4


def merged(spark, values, **options):
    rows = [(k, 0, 1, float(v)) for k, v in enumerate(values)]
    return fuzzy.merge(spark.createDataFrame(rows, "owner long, src long, dst long, dist double"), **options).first().dist


WANT = {"canonical": 0.9, "probabilistic sum": 0.944, "bounded sum": 1.0, "drastic sum": 1.0, "nilpotent maximum": 1.0, "Einstein sum": math.tanh(math.atanh(0.2) + math.atanh(0.3) + math.atanh(0.9))}


@pytest.mark.parametrize("name", WANT)
def test_tconorms(spark, name):
    same = (lambda d: d, lambda w: w)
    assert abs(merged(spark, [0.2, 0.3, 0.9], tconorm=name, by=same) - WANT[name]) < 1e-12
    assert abs(merged(spark, [0.4], tconorm=name, by=same) - 0.4) < 1e-12
    some = merged(spark, [0.2, 0.3], tconorm=name, by=same)
    assert 0.3 - 1e-12 <= some <= 1.0


def test_m_schemes(spark):
    assert merged(spark, [0.7], tconorm="m_scheme_Hyperbolic") == 1.0
    assert abs(merged(spark, [0.7, 0.5, 0.25], tconorm="m_scheme_Hyperbolic") - 1 / (1 + 2 + 4)) < 1e-12
    assert merged(spark, [0.7, 0.0], tconorm="m_scheme_Hyperbolic") == 0.0
    assert merged(spark, [0.7, 0.9], tconorm="m_scheme", m=0.5) == pytest.approx(0.45)
    for name in ("m_scheme_Wiener_Shannon", "m_scheme_Composition"):
        assert merged(spark, [0.7], tconorm=name, m=2.0) == pytest.approx(0.7)
        assert merged(spark, [0.7, 0.9], tconorm=name, m=2.0) < 0.7
    with pytest.raises(ValueError):
        merged(spark, [0.7], tconorm="m_scheme", m=0.0)
    with pytest.raises(ValueError):
        merged(spark, [0.7], tconorm="no such")


@pytest.mark.parametrize("name", ["exp", "half_normal", "log_normal", "pareto", "identity"])
def test_phi_inverts(spark, name):
    there, back = phis.phi(name)
    df = spark.createDataFrame([(x,) for x in (0.05, 0.3, 1.0, 1.7)], "x double")
    rows = df.select("x", there(F.col("x")).alias("w")).select("x", "w", back(F.col("w")).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-6 for r in rows)
    if name != "identity":
        assert sorted((r.w for r in rows), reverse=True) == [r.w for r in rows]


def test_phi_rejects():
    with pytest.raises(ValueError):
        phis.phi("other")
    with pytest.raises(TypeError):
        phis.phi((lambda d: d, None))


def test_own_tconorm(spark):
    tconorms.register("mean", F.avg)
    assert merged(spark, [0.2, 0.4], tconorm="mean", by=(lambda d: d, lambda w: w)) == pytest.approx(0.3)


def test_duplicate_points_and_k_of_one(spark):
    twice = cloud(spark, [(0, 0), (0, 0), (1, 1)])
    assert {r.i: r.j for r in knn(twice, 3).where("rank = 1").collect()} == {0: 0, 1: 1, 2: 2}
    local = fuzzy.normalise(knn(twice, 3))
    assert all(r.dist >= 0 for r in local.collect())
    assert embed.build_graph(twice, 1).count() == 0


def test_stars_are_among_cliques_and_ids_may_be_any(spark):
    x = np.random.default_rng(5).normal(size=(30, 3))
    near = knn(cloud(spark, x), 5)
    star = {(r.owner, r.src, r.dst) for r in fuzzy.star_edges(near).collect()}
    assert star <= {(r.owner, r.src, r.dst) for r in fuzzy.clique_edges(near).collect()}
    order = np.random.default_rng(6).permutation(30)
    moved = spark.createDataFrame([(int(order[i]), [float(v) for v in x[i]]) for i in range(30)], "id long, features array<double>")
    a = {(int(order[r.src]), int(order[r.dst])): r.dist for r in embed.build_graph(cloud(spark, x), 5).collect()}
    b = {(r.src, r.dst): r.dist for r in embed.build_graph(moved, 5).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_directed_distances(spark):
    m = generators.asymmetric_distances(spark)
    graph = embed.build_graph(m, 3, distances=True, directed=True, normalise=False, beyond=False)
    want = {(r.i, r.j): r.dist for r in top_k(m, 3).where("i <> j").collect()}
    assert {(r.src, r.dst): r.dist for r in graph.collect()} == want


def test_knn_of_blocks_is_knn(spark, monkeypatch):
    from graticule.operators import knn as module

    monkeypatch.setattr(module, "BLOCK", 7)
    x = np.random.default_rng(8).normal(size=(50, 4))
    got = {(r.i, r.j, r.rank) for r in knn(cloud(spark, x), 6).collect()}
    order = np.argsort(distances(x), axis=1, kind="stable")[:, :6]
    assert got == {(i, int(j), k + 1) for i in range(50) for k, j in enumerate(order[i])}
    assert pairwise(cloud(spark, x)).count() == 2500


def blobs():
    draw = np.random.default_rng(42)
    return np.concatenate([draw.normal(c, 0.4, (n, 2)) for c, n in (((0, 0), 15), ((6, 0), 20), ((0, 7), 15))])


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_of_many_copies_orders_ties_by_id(spark, metric):
    x = np.random.default_rng(5).normal(size=(1100, 32))
    x[::3] = x[0]
    x[1::50] = x[0] + 1e-9  # nearer than the product form can tell
    got = {}
    for r in knn(cloud(spark, x).repartition(2), 15, metric).collect():
        got.setdefault(r.i, {})[r["rank"]] = r.j
    for i in range(len(x)):
        m = np.sqrt(((x[i] - x) ** 2).sum(-1)) if metric == "l2" else 1 - (x[i] * x).sum(-1) / (np.linalg.norm(x[i]) * np.linalg.norm(x, axis=-1))
        assert [got[i][n + 1] for n in range(15)] == sorted(range(len(x)), key=lambda j: (m[j], i != j, j))[:15]


@pytest.mark.parametrize("method", ["single", "average", "complete", "ward"])
def test_linkage_finds_blobs(method):
    x = blobs()
    z = clusters.linkage(distances(x), method)
    assert np.all(np.diff(z[:, 2]) >= -1e-9) and z[-1, 3] == 50
    assert clusters.cut(z, 3).tolist() == [1] * 15 + [2] * 20 + [3] * 15
    assert clusters.choose_k(distances(x), z, by="silhouette", method=method) == 3
    assert clusters.choose_k(distances(x), z, by="elbow", method=method) in (2, 3)
    assert 2 <= clusters.choose_k(distances(x), z, by="all", method=method) <= 15


def test_linkage_rejects_infinite_distances():
    with pytest.raises(ValueError, match="finite"):
        clusters.linkage(np.array([[0, np.inf], [np.inf, 0]]))


def test_medoids_silhouettes_and_dispersion(spark):
    x = blobs()
    d = table(spark, distances(x))
    labels = clusters.linkage_clusters(d, 3)
    own = {r.id: r.cluster for r in labels.collect()}
    y = np.array([own[i] for i in range(50)])
    want = {c: int(np.flatnonzero(y == c)[distances(x)[np.ix_(y == c, y == c)].sum(0).argmin()]) for c in (1, 2, 3)}
    assert {r.cluster: r.medoid for r in clusters.medoids(d, labels).collect()} == want
    mean = np.mean([r.silhouette for r in clusters.silhouettes(d, labels).collect()])
    assert abs(mean - clusters.silhouette_of(distances(x), y)) < 1e-9
    assert clusters.linkage_clusters(d, None, by="silhouette").select("cluster").distinct().count() == 3


def test_hull_and_violations(spark):
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    inner = np.random.default_rng(1).uniform(0.1, 0.9, (30, 2))
    assert sorted(map(tuple, clusters.hull(np.concatenate([inner, square])))) == sorted(map(tuple, square))
    assert len(clusters.hull(square[:2])) == 2
    points = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 0.5, 0.0), (1, 2, 2.0, 0.5), (1, 3, 2.0, 2.0)], "cluster int, id long, x double, y double")
    sides = spark.createDataFrame([(2, *map(float, a), *map(float, b)) for a, b in zip(square, np.roll(square, -1, 0))], "other int, ax double, ay double, bx double, by double")
    got = {r.id: (r.inside, round(r.dist, 9), round(r.violation, 9)) for r in separation.violations(points, sides, 0.2).collect()}
    assert got == {0: (True, 0.5, round(math.tanh(0.7), 9)), 1: (True, 0.0, round(math.tanh(0.2), 9)), 2: (False, 1.0, 0.0), 3: (False, round(math.sqrt(2), 9), 0.0)}
    everything = spark.createDataFrame([("a", float(x), float(y)) for x, y in np.concatenate([inner, square])], "cluster string, x double, y double")
    assert clusters.hulls(everything).count() == 4


def test_separation_moves_overlapping_clusters_apart():
    draw = np.random.default_rng(42)
    parts = [draw.normal(c, 0.8, (n, 2)) for c, n in (((2, 2), 15), ((3, 1), 12), ((1, 3), 10))]
    medoids = np.array([(2, 2), (3, 1), (1, 3)], float)
    done = separation.separate(parts, medoids, distances(medoids))
    assert done.losses[-1] < 0.5 * done.losses[0] and len(done.paths) == len(done.losses)
    for before, after in zip(parts, done.points):
        assert np.allclose(distances(before), distances(after))


def test_violation_derivative():
    draw = np.random.default_rng(4)
    points, corners = draw.normal(0, 1, (20, 2)), clusters.hull(draw.normal(0.5, 1, (12, 2)))
    _, slope = separation._one_violation(points, corners, 0.4)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        numeric = (separation._one_violation(points + step, corners, 0.4)[0] - separation._one_violation(points - step, corners, 0.4)[0]) / 2e-6
        assert abs(numeric - slope[k]) < 1e-4


def test_moves(spark):
    points = spark.createDataFrame([(1, 0, 2.0, 1.0)], "cluster int, id long, x double, y double")
    moves = spark.createDataFrame([(1, 1.0, 1.0, math.pi / 2, 5.0, 0.0)], "cluster int, mx double, my double, angle double, tx double, ty double")
    r = separation.moved(points, moves).first()
    assert (round(r.x, 9), round(r.y, 9)) == (6.0, 2.0)
    chosen = separation.nearest_points(points, spark.createDataFrame([(2, 0.0, 0.0)], "other int, mx double, my double"), 1)
    assert chosen.count() == 1


def test_cluster_embedding(spark):
    out = embed.cluster_embed(cloud(spark, blobs()), 25, 3)
    rows = out.points.collect()
    assert len(rows) == 50 and len({r.cluster for r in rows}) == 3 and out.medoids.count() == 3 and out.losses


def test_empty_text_is_at_distance_one_of_all(spark):
    docs = spark.createDataFrame([(0, "a cat sat"), (1, "a cat sat"), (2, "")], "doc long, text string")
    got = {(r.i, r.j): round(r.dist, 6) for r in counts.hellinger(counts.terms(docs), docs.select("doc")).collect()}
    assert got[0, 1] == 0 and got[2, 2] == got[0, 2] == got[2, 1] == 1 and len(got) == 9


def test_marker_labels_need_markers(spark):
    values = spark.createDataFrame([(1, "a", 3.0), (1, "b", 9.0), (2, "a", 1.0), (3, "c", 1.0)], "doc long, term string, value double")
    assert {r.doc: r.label for r in counts.marker_labels(values, [("a", "A"), ("b", "B")], share=0.0).collect()} == {1: "A", 2: "Other", 3: "Other"}
    with pytest.raises(ValueError):
        counts.marker_labels(values, [])


def test_pair_sets_index(spark):
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    assert evaluate.pair_sets_index(same, "a", "b") == pytest.approx(1.0)
    other = spark.createDataFrame([(i % 3, i // 3 % 3) for i in range(27)], "a int, b int")
    assert evaluate.pair_sets_index(other, "a", "b") < 0.1


def test_assignment_is_best():
    import itertools

    draw = np.random.default_rng(9)
    for _ in range(20):
        g = draw.uniform(size=(4, 5))
        best = max(sum(g[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
        assert sum(g[i, j] for i, j in enumerate(evaluate.assignment(g))) == pytest.approx(best)


def test_shapes(spark):
    at = lambda df: np.array([r.features for r in df.collect()])
    t = at(generators.torus(spark, 200))
    assert np.allclose((np.hypot(t[:, 0], t[:, 1]) - 2) ** 2 + t[:, 2] ** 2, 1)
    h = at(generators.hemisphere(spark, 200))
    assert np.allclose((h**2).sum(1), 1) and (h[:, 2] >= 0).all()
    s = at(generators.s_curve(spark, 300, hole=0.5))
    assert (((s - [0, 1, 0]) ** 2).sum(1) > 0.25).all()
    assert generators.four_gaussians(spark, 300).count() == 300 and generators.moons(spark, 50).count() == 50
    assert generators.swiss_roll(spark, 300).count() < 300 and generators.swiss_roll(spark, 300, turns=8).count() == 300
    assert generators.moebius(spark, 20).collect() == generators.moebius(spark, 20).collect()


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "points")
    tables.write_points(cloud(spark, [(1, 2), (3, 4)]), path, "csv")
    back = tables.csv_points(spark, path, "id long, x0 double, x1 double")
    assert {r.id: r.features for r in back.collect()} == {0: [1.0, 2.0], 1: [3.0, 4.0]}
    both = tables.concatenated({"a": back, "b": back})
    assert {r.id for r in both.collect()} == {"a-0", "a-1", "b-0", "b-1"}


def test_grid_neighbours(spark):
    assert paths.grid_neighbours(spark, 3).count() == 20 and paths.grid_neighbours(spark, 4, periodic=True).count() == 64


def test_unreachable_pairs_are_filled(spark):
    d = spark.createDataFrame([(0, 1, 2.0)], "i long, j long, dist double")
    got = {(r.i, r.j): r.dist for r in paths.filled(d, spark.range(2), 3.0).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 2.0, (1, 0): 100.0, (1, 1): 0.0}


def test_landmarks_place_points(spark):
    x = np.random.default_rng(3).normal(size=(60, 2))
    d = distances(x)
    near = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(60) for j in range(10)], "i long, j long, dist double")
    y = np.array([r.embedding for r in mds.landmarks(near, 2).orderBy("id").collect()])
    assert np.allclose(distances(y), d, atol=1e-6)


def test_stream_windows(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10) AS ts, id % 2 AS key, 1.0D AS value FROM range(20)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "key", "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hours").select("key", "n").collect())) == sorted(map(tuple, windows.tumbling(events, "ts", "key", "1 hour").select("key", "n").collect()))
    assert windows.sessions(events, "ts", "key", "30 minutes").count() == 2


def test_lag_histogram_meets_neighbouring_buckets(spark):
    t = np.sort(np.random.default_rng(2).uniform(0, 50, 60))
    df = spark.createDataFrame([(1, float(v)) for v in t], "k int, t double")
    lags = (t[None] - t[:, None])[np.triu_indices(60, 1)]
    want = np.bincount((lags[(lags > 0) & (lags < 5)] * 10 / 5).astype(int))
    assert {r.bin: r.n for r in series.lag_histogram(df, "k", "t", 5.0, 10).collect()} == {i: int(n) for i, n in enumerate(want) if n}


def test_smoothing_of_maps(spark):
    flat = np.full((9, 9), 3.0)
    flat[4, 4] = np.nan
    assert np.allclose(grids.smooth(flat, 1.0), 3.0)
    wide = np.full((9, 9), 2.0)
    wide[2:7, 2:7] = np.nan
    assert np.isnan(grids.smooth(wide, 1.0)[4, 4])
    assert np.allclose(grids.smooth_torus(np.full((10, 10), 5.0), 1.5), 5.0)
    cells = spark.createDataFrame([("a", x, y, 1.0) for x in range(4) for y in range(4)], "key string, bx long, by long, value double")
    assert {round(r.value, 9) for r in grids.smooth_maps(cells, 1.0, 4).collect()} == {1.0}


def test_wave_fit():
    draw = np.random.default_rng(0)
    x, y = draw.uniform(0, 3, (2, 400))
    p, error = grids.fit_wave(x, y, 3.3 * (np.cos(0.7) * x + np.sin(0.7) * y) + 1.1)
    assert error < 1e-6


def test_circular_coordinates():
    n = 12
    edges = np.array([(i, (i + 1) % n) for i in range(n)])
    _, angles = grids.circular_coordinates(edges, (edges[:, 1] == 0).astype(float))
    steps = np.diff(angles) % 1
    assert np.allclose(np.minimum(steps, 1 - steps), 1 / n)


def test_greedy_samples(spark):
    x = np.random.default_rng(1).normal(size=(60, 2))
    weights = fuzzy.smooth_weights(knn(cloud(spark, x), 8))
    rows = grids.denoised_sample(fuzzy.fuzzy_union(weights), 20).collect()
    assert len({r.id for r in rows}) == 20 and rows[0].strength == max(r.strength for r in rows)
    chosen = [r.id for r in grids.radial_sample(cloud(spark, x), 5).collect() if r.chosen]
    assert 0 in chosen and 3 < len(chosen) < 20


def test_weights_of_neighbours_add_up(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    sums = fuzzy.smooth_weights(knn(cloud(spark, x), 9)).groupBy("src").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - math.log2(9)) < 1e-3 for r in sums)


def test_spectral_parts_clusters(spark):
    x = np.concatenate([np.random.default_rng(3).normal(c, 0.3, (20, 2)) for c in (0, 1.2)])
    y = np.array([r.embedding[0] for r in grids.spectral(knn(cloud(spark, x), 8), 1).orderBy("id").collect()])
    assert (y[:20].mean() < 0) != (y[20:].mean() < 0)


def test_density_modes(spark):
    v = np.concatenate([np.random.default_rng(4).normal(2, 0.1, 300), np.random.default_rng(5).normal(9, 2, 200)])
    assert abs(grids.density_mode(v) - 2) < 0.2 and grids.density_mode([4, 4]) == 4
    df = spark.createDataFrame([(1, float(a)) for a in v] + [(2, 7.0)], "k int, v double")
    got = {r.k: r["mode"] for r in grids.density_modes(df, "k", "v").collect()}
    assert abs(got[1] - grids.density_mode(v)) < 0.05 and got[2] == 7.0


def test_smooth_rates(spark):
    pairs = np.array([(i, i + 1) for i in range(9)])
    n, s = np.full(10, 50.0), 50.0 * np.arange(1, 11)
    assert np.allclose(grids.smooth_rates(n, s, pairs, 0.0), np.log(np.arange(1, 11)), atol=1e-6)
    assert np.allclose(grids.smooth_rates(n, s, pairs, 0.0, gaussian=True), np.arange(1, 11), atol=1e-6)
    assert np.ptp(grids.smooth_rates(n, s, pairs, 1e6)) < 0.1
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(10) for _ in range(5)], "b int, v double")
    out = grids.smooth_rate_map(df, "b", "v", spark.createDataFrame(pairs.tolist(), "a long, b long"), 0.0)
    assert np.allclose([r.parameter for r in out.orderBy("bin").collect()], np.log(np.arange(1, 11)), atol=1e-5)


def test_shuffled_correlation(spark):
    t = np.arange(200)
    a = np.random.default_rng(6).normal(size=200)
    df = spark.createDataFrame([(1, int(i), float(a[i]), float(a[i] * 2 + 1)) for i in t], "k int, t int, a double, b double")
    r = grids.shuffled_correlation(df, "k", "t", "a", "b", 200).first()
    assert abs(r.r - 1) < 1e-9 and r.above < 0.05


def test_many_intervals_are_bucketed(spark, monkeypatch):
    draw = np.random.default_rng(4)
    starts = np.sort(draw.uniform(0, 1000, 60))
    spans = [(f"n{k}", float(a), float(a + draw.uniform(0.5, 30))) for k, a in enumerate(starts)]
    times = [(k, float(t)) for k, t in enumerate(draw.uniform(-20, 1100, 500))]
    events, intervals = spark.createDataFrame(times, "id long, t double"), spark.createDataFrame(spans, "name string, start double, end double")
    inside = sorted((k, n) for k, t in times for n, a, b in spans if a <= t < b)
    outside = sorted(k for k, t in times if not any(a <= t < b for _, a, b in spans))
    for most in (10_000, 5):
        monkeypatch.setattr(series, "SENT", most)
        assert sorted((r.id, r.name) for r in series.in_intervals(events, intervals, "t").collect()) == inside
        assert sorted(r.id for r in series.in_intervals(events, intervals, "t", outside=True).collect()) == outside


def test_rows_are_numbered_over_partitions(spark):
    values = np.random.default_rng(2).permutation(1000).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert sorted((r["_rn"], r.v) for r in series.numbered(df, "v").collect()) == [(k, k) for k in range(1000)]
    first, second = tables.halves(df.where("v < 999"), "v")
    assert sorted(r.v for r in first.collect()) == list(range(499)) and sorted(r.v for r in second.collect()) == list(range(499, 998))


def test_error_function():
    x = np.concatenate([np.linspace(-7, 7, 400), [0.0, 1e-9, np.nan]])
    got = phis.erf(x)
    assert np.allclose(got[:-1], [math.erf(v) for v in x[:-1]], rtol=0, atol=2e-15) and np.isnan(got[-1])
    assert np.allclose(phis.erf(phis.erf_inverse(np.linspace(-0.999, 0.999, 99))), np.linspace(-0.999, 0.999, 99), atol=1e-12)


def test_npz_and_csv_cells(spark, tmp_path):
    np.savez(tmp_path / "a.npz", one=np.arange(6.0).reshape(2, 3), two=np.array([4, 5]))
    rows = sorted((r.name, r.place, r["values"]) for r in tables.npz_arrays(spark, str(tmp_path / "*.npz")).collect())
    assert rows == [("one", 0, [0.0, 1.0, 2.0]), ("one", 1, [3.0, 4.0, 5.0]), ("two", 0, [4.0]), ("two", 1, [5.0])]
    (tmp_path / "c.csv").write_text("1,x\n2.5,\n")
    cells = sorted((r.place, r.text or "", r.number) for r in tables.typed_cells(spark, str(tmp_path / "c.csv")).collect())
    assert cells == [(0, "1", 1.0), (0, "2.5", 2.5), (1, "", None), (1, "x", None)]


def test_landmarks_stand_for_dense_scaling(spark, monkeypatch):
    """Places by landmarks against those by all distances, of the same points."""
    draw = np.random.default_rng(3)
    x = draw.uniform(0, 1, (400, 2)) * [4, 1]
    data = cloud(spark, np.hstack([x, 0.05 * np.sin(3 * x[:, :1])]))
    at = lambda df, c: np.array([r[c] for r in df.orderBy("id").collect()])
    apart = lambda y: np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    plain = embed.embed(data, 12, 2, normalise=False, beyond=False).cache()
    monkeypatch.setattr(mds, "DENSE", 300)
    monkeypatch.setattr(mds, "LANDMARKS", 80)
    monkeypatch.setattr(mds, "CHUNK", 64)
    by_marks = embed.embed(data, 12, 2, normalise=False, beyond=False).cache()
    assert by_marks.count() == 400
    for c, least in (("init", 0.999), ("embedding", 0.995)):
        a, b = apart(at(plain, c)), apart(at(by_marks, c))
        assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > least and abs(b.mean() / a.mean() - 1) < 0.03
    with pytest.raises(ValueError, match="landmarks"):
        embed.embed(data, 12, 2, init="random")
    done = embed.cluster_embed(data, 12, 4, normalise=False, beyond=False)
    assert done.points.count() == 400 and done.medoids.count() == 4


def test_initialisations_and_losses_of_ones_own(spark):
    x = np.random.default_rng(1).normal(0, 1, (30, 2))
    target = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    table = pairwise(cloud(spark, x))
    labels = cloud(spark, x).select("id", F.lit(0).cast("long").alias("component"))
    given = cloud(spark, x + 0.01).select("id", F.col("features").alias("init"))
    own = lambda t, f: (float(((f - t) ** 2).mean()), 2 * (f - t) / f.size)
    wrong = lambda y: np.mean((distances(y) - target) ** 2)
    for init in ("classical", "spectral", "random", given):
        out, named = (mds.embed_components(table, labels, 2, True, init, loss=loss, epochs=400, patience=400, batch=15).orderBy("id").collect() for loss in (own, "MSE"))
        assert out == named
        start, end = (np.array([r[c] for r in out]) for c in ("init", "embedding"))
        assert wrong(end) < 0.01 if init in ("classical", given) else wrong(end) < wrong(start) / 2
    assert np.allclose(start, x + 0.01)
    with pytest.raises(Exception, match="shape"):
        mds.embed_components(table, labels, 3, True, given).collect()
    with pytest.raises(Exception, match="initialisation"):
        mds.embed_components(table, labels, 2, True, "none").collect()


def test_smooth_weights_options(spark):
    near = knn(cloud(spark, np.random.default_rng(5).normal(0, 1, (40, 3))), 8)
    rows = near.orderBy("i", "rank").collect()
    for connectivity, bandwidth, alpha in ((1.0, 1.0, 1.0), (1.5, 1.0, 1.0), (0.0, 1.2, 1.0), (1.0, 0.8, 0.5)):
        sums: dict = {}
        for r in fuzzy.smooth_weights(near, local_connectivity=connectivity, bandwidth=bandwidth, alpha=alpha).collect():
            sums[r.src] = sums.get(r.src, 0) + r.weight
        assert all(abs(s - bandwidth * 3) < 1e-4 for s in sums.values())
    d = [r.dist for r in rows if r.i == 0][1:]
    w = {r.dst: r.weight for r in fuzzy.smooth_weights(near, local_connectivity=1.5).where("src = 0").collect()}
    rho = (d[0] + d[1]) / 2
    assert all((w[r.j] == 1.0) == (r.dist <= rho) for r in rows if r.i == 0 and r.j != 0)


def test_series_are_cut_in_buckets(spark):
    """Buckets of any width give the same; keys may be null, and buckets empty."""
    draw = np.random.default_rng(6)
    rows = [(k, float(t), float(draw.normal()), float(draw.normal())) for k in ("a", "b", None) for t in np.sort(draw.choice(np.arange(0, 3000, 7), 60, replace=False))]
    df = spark.createDataFrame(rows, "k string, t double, x double, y double")
    at = lambda out, c: {(r.k, round(r.t, 6)): r[c] and round(r[c], 9) for r in out.collect()}
    one, many = (at(series.speeds(df, "k", "t", "x", "y", bucket=b), "speed") for b in (1e9, 20.0))
    assert one == many and len(one) == 180 and sum(v is None for v in one.values()) == 3
    one, many = (at(series.resampled(df, "k", "t", "x", 10.0, bucket=b), "value") for b in (10**6, 3))
    assert one == many and None not in one.values() and {k for k, _ in one} == {"a", "b", None}
    for (k, t), v in one.items():
        own = [(r[1], r[2]) for r in rows if r[0] == k]
        assert abs(v - np.interp(t, *zip(*own))) < 1e-6


def test_waves_of_maps(spark):
    x, y = np.meshgrid(np.linspace(0, 3, 12), np.linspace(0, 3, 12))
    rows = [(k, float(a), float(b), float((f * (np.cos(g) * a + np.sin(g) * b) + o) % (2 * np.pi))) for k, (g, o, f) in {"p": (0.5, 1.0, 2.0), "q": (2.0, 3.0, 3.5)}.items() for a, b in zip(x.ravel(), y.ravel())]
    out = {r.k: r for r in grids.fit_waves(spark.createDataFrame(rows, "k string, x double, y double, phase double"), "k", "x", "y", "phase").collect()}
    assert set(out) == {"p", "q"} and all(r.error < 1e-6 for r in out.values()) and abs(out["p"].frequency - 2) < 1e-3


def test_hellinger_in_blocks(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(d, f"t{t}", int(draw.integers(1, 9))) for d in range(40) for t in {0, *draw.integers(0, 30, draw.integers(0, 12)).tolist()} if d % 7]
    counts_of = {}
    for d, t, c in rows:
        counts_of.setdefault(d, {})[t] = c
    monkeypatch.setattr(counts, "CELLS", 60)
    got = {(r.i, r.j): r.dist for r in counts.hellinger(spark.createDataFrame(rows, "doc long, term string, cnt long"), spark.range(40).withColumnRenamed("id", "doc")).collect()}
    root = lambda d, t: math.sqrt(counts_of.get(d, {}).get(t, 0) / max(1, sum(counts_of.get(d, {}).values())))
    assert len(got) == 1600
    for (i, j), v in got.items():
        s = sum(root(i, t) * root(j, t) for t in counts_of.get(i, {}))
        assert abs(v - math.sqrt(max(0.0, 1 - s))) < 1e-6
