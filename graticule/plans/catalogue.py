"""Named queries over the driver's tables, with the same in SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import clusters, counts, evaluate, fuzzy, grids, mds, paths, separation, series
from ..operators.knn import distance_sums, knn, knn_lsh, linked, pairwise
from ..sources.tables import sample, scaled_by_max, standardised, table
from ..streaming import windows
from . import embed
from .storage import materialise

K = 15
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return materialise(knn(points(spark, d), K), "neighbours")


def rounded(df: DataFrame, *columns: str, to: int = 5) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), to) + F.lit(0.0) for c in columns})


P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
PAIRS = f"{P}, pairs AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM p a, p b)"
NEAR = f"{PAIRS}, ranked AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, i <> j, j)::INT AS rank FROM pairs), near AS (SELECT * FROM ranked WHERE rank <= {K})"
STEPS = f"""{NEAR}, rho AS (SELECT i, max(dist) FILTER (rank = 2) AS rho FROM near GROUP BY i),
moved AS (SELECT i, j, rank, CASE WHEN rank = 1 THEN 0.0 ELSE dist - rho END AS b, dist AS a FROM near JOIN rho USING (i)),
top AS (SELECT i, max(a) AS ma, max(b) AS mb FROM moved GROUP BY i)"""
LOCAL = f"{STEPS}, loc AS (SELECT i, j, rank, CASE WHEN mb > 1e-10 THEN b / mb ELSE b END AS dist FROM moved JOIN top USING (i))"
STAR = f"{LOCAL}, star AS (SELECT i AS owner, i AS src, j AS dst, dist FROM loc WHERE i <> j UNION ALL SELECT i, j, i, dist FROM loc WHERE i <> j)"


@query(f"WITH {PAIRS} SELECT i, j, round(dist, 5) + 0.0 AS dist FROM pairs")
def pairwise_l2(spark, d):
    return pairwise(points(spark, d), to=5)


@query(f"WITH {NEAR} SELECT i, j, rank, round(dist, 5) + 0.0 AS dist FROM near")
def knn_exact(spark, d):
    return rounded(knn(points(spark, d), K), "dist")


@query(f"WITH {P}, pairs AS (SELECT a.id AS i, b.id AS j, list_cosine_distance(a.v, b.v) AS dist FROM p a, p b), ranked AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY i <> j, dist, j)::INT AS rank, dist FROM pairs) SELECT i, j, rank, round(dist, 5) + 0.0 AS dist FROM ranked WHERE rank <= {K} AND i <> j")
def knn_cosine(spark, d):
    return rounded(knn(points(spark, d), K, "cosine").where("i <> j"), "dist")


@query()
def knn_lsh_l2(spark, d):
    return rounded(knn_lsh(points(spark, d), K, width=1.0, tables=6), "dist")


for _divide, _beyond, _name, _expr in (
    (True, True, "tt", "CASE WHEN mb > 1e-10 THEN b / mb ELSE b END"),
    (False, True, "ft", "b"),
    (True, False, "tf", "CASE WHEN ma > 1e-10 THEN a / ma ELSE a END"),
    (False, False, "ff", "a"),
):
    @query(f"WITH {STEPS} SELECT i, j, rank, round({_expr}, 5) + 0.0 AS dist FROM moved JOIN top USING (i)", name=f"normalize_{_name}")
    def _normalised(spark, d, divide=_divide, beyond=_beyond):
        return rounded(fuzzy.normalise(knn(points(spark, d), K), divide, beyond), "dist")


def local(spark, d):
    return fuzzy.normalise(neighbours(spark, d))


@query(f"WITH {STAR} SELECT owner, src, dst, round(dist, 5) + 0.0 AS dist FROM star")
def star_edges(spark, d):
    return rounded(fuzzy.star_edges(local(spark, d)), "dist")


CLIQUE = f"{LOCAL}, own AS (SELECT i AS owner, j AS a, dist AS da FROM loc WHERE i <> j)"


@query(f"WITH {CLIQUE} SELECT owner, a AS src, b AS dst, round(da + db, 5) + 0.0 AS dist FROM (SELECT x.owner, x.a, y.a AS b, x.da, y.da AS db FROM own x JOIN own y ON x.owner = y.owner AND x.a <> y.a) UNION ALL SELECT owner, owner, a, round(da, 5) + 0.0 FROM own UNION ALL SELECT owner, a, owner, round(da, 5) + 0.0 FROM own")
def clique_edges_canonical(spark, d):
    return rounded(fuzzy.clique_edges(local(spark, d)), "dist")


@query(f"WITH {CLIQUE} SELECT owner, a AS src, b AS dst, round((da + db) / sqrt(2), 5) + 0.0 AS dist FROM (SELECT x.owner, x.a, y.a AS b, x.da, y.da AS db FROM own x JOIN own y ON x.owner = y.owner AND x.a <> y.a) UNION ALL SELECT owner, owner, a, round(da, 5) + 0.0 FROM own UNION ALL SELECT owner, a, owner, round(da / sqrt(2), 5) + 0.0 FROM own")
def clique_edges_freed(spark, d):
    return rounded(fuzzy.clique_edges(local(spark, d), "freed"), "dist")


RAY = "list_transform(generate_series(1, len(o.v)), lambda k: ({0}.v[k] - o.v[k]) * {1} / greatest(list_distance({0}.v, o.v), 1e-300))"


@query(f"""WITH {CLIQUE}, e AS (SELECT x.owner, x.a, y.a AS b, x.da, y.da AS db FROM own x JOIN own y ON x.owner = y.owner AND x.a <> y.a)
SELECT e.owner, e.a AS src, e.b AS dst, round(list_distance({RAY.format('pa', 'da')}, {RAY.format('pb', 'db')}), 5) + 0.0 AS dist
FROM e JOIN p o ON o.id = e.owner JOIN p pa ON pa.id = e.a JOIN p pb ON pb.id = e.b
UNION ALL SELECT owner, owner, a, round(da, 5) + 0.0 FROM own UNION ALL SELECT owner, a, owner, round(da, 5) + 0.0 FROM own""")
def clique_edges_euclidean(spark, d):
    return rounded(fuzzy.clique_edges(local(spark, d), "euclidean", points(spark, d)), "dist")


def _merge(name: str, tconorm: str, sql: str, **options) -> None:
    @query(f"WITH {STAR} SELECT src, dst, round({sql}, 5) + 0.0 AS dist FROM star GROUP BY src, dst", name=name)
    def merged(spark, d):
        return rounded(fuzzy.merge(fuzzy.star_edges(local(spark, d)), tconorm, **options), "dist")


_W = "exp(-dist)"
_merge("tconorm_canonical", "canonical", "min(dist)")
_merge("tconorm_probsum", "probabilistic sum", f"-ln(1 - product(1 - {_W}))")
_merge("tconorm_bounded", "bounded sum", f"-ln(least(sum({_W}), 1.0))")
_merge("tconorm_drastic", "drastic sum", f"-ln(CASE WHEN count(*) FILTER ({_W} <> 0) > 1 THEN 1.0 ELSE max({_W}) END)")
_merge("tconorm_einstein", "Einstein sum", f"-ln(CASE WHEN max({_W}) >= 1 THEN 1.0 ELSE tanh(sum(CASE WHEN dist > 0 THEN atanh({_W}) ELSE 0 END)) END)")
_merge("tconorm_nilpotent", "nilpotent maximum", f"-ln(CASE WHEN count(*) > 1 AND list_sum(max({_W}, 2)) >= 1 THEN 1.0 ELSE max({_W}) END)")
_merge("mscheme_min", "m_scheme", "CASE WHEN count(*) = 1 THEN min(dist) ELSE least(min(dist), 0.5 * (SELECT max(dist) FROM star)) END", m=0.5)
_merge("mscheme_wiener", "m_scheme_Wiener_Shannon", "greatest(0.0, -ln(sum(exp(-2.0 * dist))) / 2.0)", m=2.0)
_merge("mscheme_composition", "m_scheme_Composition", "greatest(0.0, -ln(1 - product(1 - exp(-2.0 * dist))) / 2.0)", m=2.0)
_merge("mscheme_hyperbolic", "m_scheme_Hyperbolic", "CASE WHEN count(*) = 1 THEN 1.0 WHEN max_by(dist, owner) = 0 THEN 0.0 ELSE 1 / (1 + 1 / max_by(dist, owner)) END")
_merge("phi_exp", "probabilistic sum", "-ln(1 - product(1 - exp(-dist / 0.5))) * 0.5", by="exp", scale=0.5)
_merge("phi_pareto", "probabilistic sum", "(pow(1 - product(1 - pow(1 + dist, -3.0)), -1 / 3.0) - 1)", by="pareto", shape=3.0)
_merge("phi_uniform", "bounded sum", "1 - least(least(sum(1 - least(dist, 1.0)), 1.0), 1.0)", by="uniform")
_merge("phi_identity", "canonical", "max(dist)", by="identity")


@query()
def phi_half_normal(spark, d):
    return rounded(fuzzy.merge(fuzzy.star_edges(local(spark, d)), "probabilistic sum", "half_normal"), "dist", to=4)


@query()
def phi_log_normal(spark, d):
    return rounded(fuzzy.merge(fuzzy.star_edges(local(spark, d)), "probabilistic sum", "log_normal"), "dist", to=4)


@query(f"WITH {STAR}, g AS (SELECT src, dst, exp(-min(dist)) AS w FROM star WHERE owner = src GROUP BY src, dst), b AS (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) SELECT src, dst, round(sum(w) - CASE WHEN count(*) = 2 THEN product(w) ELSE 0 END, 5) AS weight FROM b GROUP BY src, dst")
def fuzzy_union(spark, d):
    graph = fuzzy.merge(fuzzy.star_edges(local(spark, d), directed=True)).select("src", "dst", F.exp(-F.col("dist")).alias("weight"))
    return rounded(fuzzy.fuzzy_union(graph), "weight")


GRAPH = f"{STAR}, g AS (SELECT src, dst, min(dist) AS dist FROM star GROUP BY src, dst)"


def graph(spark, d):
    return materialise(fuzzy.merge(fuzzy.star_edges(local(spark, d))), "graph")


@query(f"""WITH RECURSIVE {GRAPH}, r(i, j, dist) USING KEY (i, j) AS (SELECT id, id, 0.0::DOUBLE FROM p WHERE id % 20 = 0
UNION SELECT r.i, g.dst, min(r.dist + g.dist) FROM r JOIN g ON g.src = r.j LEFT JOIN recurring.r k ON k.i = r.i AND k.j = g.dst WHERE k.dist IS NULL OR r.dist + g.dist < k.dist GROUP BY r.i, g.dst)
SELECT i, j, round(dist, 4) + 0.0 AS dist FROM r""")
def geodesic_landmarks(spark, d):
    sources = points(spark, d).where("id % 20 = 0").select(F.col("id").alias("i"))
    return paths.geodesics(graph(spark, d), sources, to=4)


@query(SQL["geodesic_landmarks"])
def geodesic_relaxed(spark, d):
    sources = points(spark, d).where("id % 20 = 0").select(F.col("id").alias("i"))
    return paths.relaxed(paths.undirected(graph(spark, d)), sources, to=4)


LINKED = f"{PAIRS}, e AS (SELECT i, j FROM pairs WHERE dist < 0.75 AND i <> j)"


@query(f"WITH RECURSIVE {LINKED}, r(id, component) AS (SELECT id, id FROM p UNION SELECT e.j, r.component FROM r JOIN e ON e.i = r.id WHERE r.component < e.j) SELECT id, min(component) AS component FROM r GROUP BY id")
def components(spark, d):
    own = points(spark, d)
    return paths.components(own.select("id"), linked(own, 0.75))


@query(f"WITH {PAIRS}, s AS (SELECT i, j, dist * dist AS s FROM pairs) SELECT i, j, round(s - avg(s) OVER (PARTITION BY i) - avg(s) OVER (PARTITION BY j) + avg(s) OVER (), 5) + 0.0 AS value FROM s")
def double_center(spark, d):
    return mds.centred_of(points(spark, d), to=5)


FOUND = f"{P}, x AS (SELECT list_distance(a.v, b.v) AS t, sqrt(pow(a.v[1] - b.v[1], 2) + pow(a.v[2] - b.v[2], 2)) AS f FROM p a, p b WHERE a.id <> b.id)"


@query(f"WITH {FOUND} SELECT round(avg(pow(f - t, 2)), 5) AS mse, round(avg(pow(f - t, 2) / t), 5) AS sammon, round(sum(pow(f - t, 2) / (t + 1e-8)) / sum(t), 5) AS sammon2, round(sum(pow(f / (t + 1e-8) - 1, 2)), 2) AS ratio FROM x")
def stress(spark, d):
    own = points(spark, d).select("id", "features", F.slice("features", 1, 2).alias("found"))
    return mds.stress_of(own).select(F.round("mse", 5).alias("mse"), F.round("sammon", 5).alias("sammon"), F.round("sammon2", 5).alias("sammon2"), F.round("ratio", 2).alias("ratio"))


LABELLED = f"{PAIRS}, w AS (SELECT pairs.i, pairs.j, pairs.dist, a.label AS la, b.label AS lb FROM pairs JOIN p a ON a.id = i JOIN p b ON b.id = j)"


@query(f"WITH {LABELLED}, s AS (SELECT la AS cluster, i, sum(dist) AS t FROM w WHERE la = lb GROUP BY la, i) SELECT cluster, arg_min(i, (round(t, 9), i)) AS medoid FROM s GROUP BY cluster")
def medoid_by_label(spark, d):
    return clusters.medoids_of(distance_sums(points(spark, d), labels(spark, d), within=True), labels(spark, d))


@query(f"WITH {LABELLED}, n AS (SELECT label, count(*) AS n FROM p GROUP BY label) SELECT la AS cluster, any_value(n) AS n, round(sum(dist) / (2 * any_value(n)), 5) AS dispersion FROM w JOIN n ON label = la WHERE la = lb GROUP BY la HAVING any_value(n) >= 2")
def dispersion(spark, d):
    return rounded(clusters.dispersion_of(distance_sums(points(spark, d), labels(spark, d), within=True), labels(spark, d)), "dispersion")


@query(f"WITH {LABELLED}, m AS (SELECT i, la, lb, avg(dist) AS m FROM w WHERE i <> j GROUP BY ALL), b AS (SELECT i, la, max(m) FILTER (la = lb) AS own, min(m) FILTER (la <> lb) AS near FROM m GROUP BY i, la) SELECT i AS id, la AS cluster, round(CASE WHEN own IS NULL THEN 0.0 ELSE (near - own) / greatest(near, own) END, 5) + 0.0 AS silhouette FROM b")
def silhouette(spark, d):
    return rounded(clusters.silhouettes_of(distance_sums(points(spark, d), labels(spark, d)), labels(spark, d)), "silhouette")


SQUARE = [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]
_SIDES = [(*a, *b) for a, b in zip(SQUARE, SQUARE[1:] + SQUARE[:1], strict=True)]


@query(f"""WITH {P}, h(ax, ay, bx, b_y) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for a, b, c, e in _SIDES)}),
e AS (SELECT id, label, bx - ax AS ex, b_y - ay AS ey, v[1] - ax AS px, v[2] - ay AS py FROM p, h),
s AS (SELECT id, label, (ex * py - ey * px) / sqrt(ex * ex + ey * ey) AS signed, ex, ey, px, py, greatest(least((px * ex + py * ey) / (ex * ex + ey * ey), 1.0), 0.0) AS t FROM e),
g AS (SELECT id, label, min(signed) >= -1e-8 OR max(signed) <= 1e-8 AS inside, min(abs(signed)) AS line, min(sqrt(pow(px - t * ex, 2) + pow(py - t * ey, 2))) AS apart FROM s GROUP BY id, label)
SELECT label AS cluster, id, -1 AS other, inside, round(CASE WHEN inside THEN line ELSE apart END, 5) + 0.0 AS dist, round(CASE WHEN inside THEN tanh(0.05 + line) ELSE tanh(greatest(0.0, 0.05 - apart)) END, 5) + 0.0 AS violation FROM g""")
def hull_violation(spark, d):
    own = points(spark, d).select(F.col("label").alias("cluster"), "id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    sides = spark.createDataFrame([(-1, *s) for s in _SIDES], "other int, ax double, ay double, bx double, by double")
    return rounded(separation.violations(own, F.broadcast(sides), 0.05), "dist", "violation")


@query()
def cluster_hulls(spark, d):
    return clusters.hulls(points(spark, d).select(F.col("label").alias("cluster"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y")))


TERMS = "t AS (SELECT item_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM benchmark), c AS (SELECT doc, term, count(*) AS cnt FROM t GROUP BY doc, term), q AS (SELECT doc, term, sqrt(cnt / sum(cnt) OVER (PARTITION BY doc)) AS p FROM c)"


def benchmark_terms(spark, d, least=1):
    return counts.terms(table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text"), least)


@query(f"WITH {TERMS}, s AS (SELECT a.doc AS i, b.doc AS j, sum(a.p * b.p) AS s FROM q a JOIN q b USING (term) GROUP BY ALL) SELECT x.item_id AS i, y.item_id AS j, round(sqrt(greatest(0.0, least(1.0, 1 - coalesce(s, 0)))), 4) + 0.0 AS dist FROM benchmark x CROSS JOIN benchmark y LEFT JOIN s ON s.i = x.item_id AND s.j = y.item_id")
def hellinger_items(spark, d):
    dist = counts.hellinger(materialise(benchmark_terms(spark, d), "terms"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc")))
    # The root of a difference near 0 is uncertain by 1e-8.
    return rounded(dist, "dist", to=4)


@query("WITH t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents), c AS (SELECT doc, term, count(*) AS cnt FROM t GROUP BY doc, term), k AS (SELECT term FROM c GROUP BY term HAVING count(*) >= 5) SELECT doc, term, cnt FROM c SEMI JOIN k USING (term)")
def document_terms(spark, d):
    return counts.terms(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), "text"), 5)


LINES = "l AS (SELECT l_orderkey AS doc, l_partkey AS term, sum(l_quantity) AS cnt FROM lineitem GROUP BY ALL)"


def order_lines(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("term")).agg(F.sum("l_quantity").alias("cnt"))


@query(f"WITH {LINES} SELECT doc, count(*) FILTER (cnt > 0) AS n_terms, sum(cnt) AS total, round(ln(1 + sum(cnt)), 5) AS log_total, round(100 * sum(CASE WHEN term % 7 = 0 THEN cnt ELSE 0 END) / sum(cnt), 5) AS pct_seven, round(100 * sum(CASE WHEN term < 100 THEN cnt ELSE 0 END) / sum(cnt), 5) AS pct_low FROM l GROUP BY doc")
def qc_metrics(spark, d):
    return rounded(counts.quality(order_lines(spark, d), {"seven": F.col("term") % 7 == 0, "low": F.col("term") < 100}), "log_total", "pct_seven", "pct_low")


@query(f"WITH {LINES}, a AS (SELECT doc FROM l GROUP BY doc HAVING count(*) >= 3), f AS (SELECT * FROM l SEMI JOIN a USING (doc)), b AS (SELECT term FROM f GROUP BY term HAVING count(*) >= 20) SELECT doc, term, cnt FROM f SEMI JOIN b USING (term)")
def filter_counts(spark, d):
    return counts.filter_counts(order_lines(spark, d), 3, 20)


@query(f"WITH {LINES}, t AS (SELECT doc, sum(cnt) AS total FROM l GROUP BY doc), m AS (SELECT quantile_cont(total, 0.5) AS m FROM t) SELECT doc, term, cnt, round(ln(1 + cnt * m / total), 5) AS value FROM l JOIN t USING (doc), m")
def normalize_total_log1p(spark, d):
    return rounded(counts.normalise_total(materialise(order_lines(spark, d), "counts")), "value")


@query("WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.75) FILTER (l_extendedprice > 0) AS q FROM lineitem GROUP BY l_returnflag) SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, round(q, 4) AS \"limit\", l_extendedprice > q AS high FROM lineitem JOIN m USING (l_returnflag)")
def p75_threshold(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rounded(counts.above_percentile(lines, "l_returnflag", "l_extendedprice"), "limit", to=4)


@query("WITH c AS (SELECT l_partkey AS term, var_samp(l_quantity) / avg(l_quantity) AS v FROM lineitem GROUP BY l_partkey) SELECT term, round(v, 5) AS dispersion, row_number() OVER (ORDER BY v DESC NULLS LAST, term)::INT AS rank FROM c QUALIFY rank <= 50")
def variable_terms(spark, d):
    return rounded(counts.variable_terms(table(spark, d, "lineitem", "l_partkey", "l_quantity").select(F.col("l_partkey").alias("term"), F.col("l_quantity").alias("cnt")), 50), "dispersion")


@query("""WITH m(term, label, place) AS (VALUES ('login', 'in', 0), ('purchase', 'buyer', 1), ('click', 'clicker', 2), ('view', 'viewer', 3)),
s AS (SELECT user_id AS doc, event_type AS term, sum(value) AS value FROM events GROUP BY ALL),
q AS (SELECT term, quantile_cont(value, 0.75) FILTER (value > 0) AS q FROM s JOIN m USING (term) GROUP BY term),
h AS (SELECT doc, label, value, place FROM s JOIN m USING (term) JOIN q USING (term) WHERE value > q),
b AS (SELECT doc, arg_max(label, (value, -place)) AS label, count(*) AS n FROM h GROUP BY doc)
SELECT DISTINCT s.doc, coalesce(label, 'Other') AS label, coalesce(n, 0) AS n_positive FROM s LEFT JOIN b USING (doc)""")
def marker_argmax(spark, d):
    sums = table(spark, d, "events", "user_id", "event_type", "value").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("term")).agg(counts.steady_sum("value").alias("value"))
    return counts.marker_labels(materialise(sums, "sums"), [("login", "in"), ("purchase", "buyer"), ("click", "clicker"), ("view", "viewer")])


def events(spark, d):
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


T = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


@query(f"WITH {T}, c AS (SELECT event_type, floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT event_type, unnest(generate_series(min(bin), max(bin))) AS bin FROM c GROUP BY event_type) SELECT event_type, bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, bin)")
def event_bins(spark, d):
    return series.binned_counts(events(spark, d), "event_type", "t", 3600.0, fill=True)


@query(f"WITH {T} SELECT a.event_type, floor((b.t - a.t) * 20 / 600)::BIGINT AS bin, count(*) AS n FROM e a JOIN e b ON a.event_type = b.event_type AND b.t > a.t AND b.t < a.t + 600 AND b.t - a.t < 600 GROUP BY ALL")
def event_lag_band_join(spark, d):
    return series.lag_histogram(events(spark, d), "event_type", "t", 600.0, 20)


_DAYS = [("first", 1704067200.0 + 86400 * 2, 1704067200.0 + 86400 * 4), ("second", 1704067200.0 + 86400 * 9.5, 1704067200.0 + 86400 * 10), ("third", 1704067200.0 + 86400 * 20, 1704067200.0 + 86400 * 23)]
_IV = "iv(name, s, f) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in _DAYS) + ")"


def intervals(spark):
    return spark.createDataFrame(_DAYS, "name string, start double, end double")


@query(f"WITH {T}, {_IV} SELECT event_id, name FROM e JOIN iv ON t >= s AND t < f")
def event_interval_join(spark, d):
    return series.in_intervals(events(spark, d), intervals(spark), "t").select("event_id", "name")


@query(f"WITH {T}, {_IV} SELECT event_id, name FROM e JOIN iv ON t >= s AND t < f")
def event_interval_bucket_join(spark, d):
    return series.in_intervals(events(spark, d), intervals(spark), "t", indexed=True).select("event_id", "name")


@query(f"WITH {T}, {_IV} SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM iv WHERE t >= s AND t < f)")
def event_outside_intervals(spark, d):
    return series.in_intervals(events(spark, d), intervals(spark), "t", outside=True).select("event_id")


@query(f"""WITH {T}, k AS (SELECT event_type, t, avg(value) AS v FROM e GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(ceil(min(t) / 3600)::BIGINT, floor(max(t) / 3600)::BIGINT)) * 3600.0::DOUBLE AS t FROM k GROUP BY event_type),
a AS (SELECT g.event_type, g.t, k.t AS t0, k.v AS v0 FROM g ASOF JOIN k ON g.event_type = k.event_type AND g.t >= k.t),
b AS (SELECT g.event_type, g.t, k.t AS t1, k.v AS v1 FROM g ASOF JOIN k ON g.event_type = k.event_type AND g.t <= k.t)
SELECT event_type, t::DOUBLE AS t, round(CASE WHEN t0 = t THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 4) + 0.0 AS value FROM a JOIN b USING (event_type, t)""")
def asof_interp(spark, d):
    return rounded(series.resampled(events(spark, d), "event_type", "t", "value", 3600.0), "value", to=4)


@query(f"WITH {T}, c AS (SELECT event_type, floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM e GROUP BY ALL) SELECT a.event_type, a.bin, round(sum(b.n * exp(-pow(b.bin - a.bin, 2) / 8.0) / (2 * sqrt(2 * pi()))), 4) AS smooth FROM c a JOIN c b ON a.event_type = b.event_type AND abs(a.bin - b.bin) <= 10 GROUP BY a.event_type, a.bin")
def smoothed_bins(spark, d):
    return rounded(series.gaussian_smoothed(series.binned_counts(events(spark, d), "event_type", "t", 3600.0), "event_type", "bin", "n", 2.0).drop("n"), "smooth", to=4)


@query(f"WITH {T}, a AS (SELECT event_type, (t % 86400) / 86400 * 2 * pi() AS x FROM e) SELECT event_type, round(CASE WHEN atan2(avg(sin(x)), avg(cos(x))) < 0 THEN atan2(avg(sin(x)), avg(cos(x))) + 2 * pi() ELSE atan2(avg(sin(x)), avg(cos(x))) END, 5) AS direction FROM a GROUP BY event_type")
def circular_mean_by_type(spark, d):
    angle = F.col("t") % 86400 / 86400 * 2 * math.pi
    return rounded(events(spark, d).groupBy("event_type").agg(series.circular_mean(angle).alias("direction")), "direction")


@query("""WITH b AS (SELECT least(floor((l_discount - 0) * 10 / 0.1), 9)::BIGINT AS bx, least(floor((l_tax - 0) * 10 / 0.1), 9)::BIGINT AS "by", l_quantity AS q FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.1) SELECT bx, "by", count(*) AS n, round(avg(q), 5) AS mean FROM b GROUP BY ALL""")
def binned_mean(spark, d):
    lines = table(spark, d, "lineitem", "l_discount", "l_tax", "l_quantity")
    return rounded(series.binned_mean(lines, F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), 0.0, 0.1, 10).drop("direction"), "mean")


@query("WITH b AS (SELECT least(floor(o_totalprice * 30 / 500000), 29)::BIGINT AS bin FROM orders WHERE o_totalprice BETWEEN 0 AND 500000), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 5) AS fraction FROM c")
def cum_hist(spark, d):
    return rounded(series.cumulative_histogram(table(spark, d, "orders", "o_totalprice"), F.col("o_totalprice"), 0.0, 500000.0, 30), "fraction")


@query("WITH r AS (SELECT l_shipmode_key AS k, bin, avg(v) AS rate, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode_key, month(l_shipdate) AS bin, l_quantity AS v FROM lineitem) GROUP BY ALL), p AS (SELECT k, rate, n / sum(n) OVER (PARTITION BY k) AS p, sum(rate * n) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k) AS mu FROM r) SELECT k AS l_returnflag, round(sum(p * rate / mu * log2(rate / mu)), 7) + 0.0 AS information FROM p GROUP BY k")
def information_score(spark, d):
    lines = table(spark, d, "lineitem", "l_returnflag", "l_shipdate", "l_quantity").withColumn("bin", F.month("l_shipdate"))
    return rounded(series.information_score(lines, "l_returnflag", "bin", "l_quantity"), "information", to=7)


@query("WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem) SELECT round(1 - sum(pow(l_extendedprice - l_quantity * 1000, 2)) / sum(pow(l_extendedprice - m, 2)), 5) AS r2, round(corr(l_extendedprice, l_quantity * 1000), 5) AS pearson FROM lineitem, m")
def explained_variance(spark, d):
    lines = table(spark, d, "lineitem", "l_extendedprice", "l_quantity").withColumn("guess", F.col("l_quantity") * 1000)
    return rounded(series.explained(lines, "l_extendedprice", "guess"), "r2", "pearson")


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 5) + 0.0 AS scaled FROM customer")
def min_max_scaled(spark, d):
    return rounded(series.min_max_scaled(table(spark, d, "customer", "c_custkey", "c_acctbal"), "c_acctbal"), "scaled").select("c_custkey", "scaled")


@query("WITH b AS (SELECT DISTINCT user_id, floor(epoch_us(ts) / 1e6 / 86400)::BIGINT AS day FROM events), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS grp FROM b) SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, grp")
def active_runs(spark, d):
    return series.runs(events(spark, d).withColumn("day", F.floor(F.col("t") / 86400)), "user_id", "day")


@query(f"WITH {T}, s AS (SELECT event_id, user_id, t, value, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, round(CASE WHEN t > t0 THEN abs(value - v0) / (t - t0) END, 7) + 0.0 AS speed FROM s")
def speeds(spark, d):
    moving = events(spark, d).withColumn("y", F.lit(0.0))
    return rounded(series.speeds(moving, "user_id", "t", "value", "y", tie="event_id").select("event_id", "speed"), "speed", to=7)


@query("WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS rn, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS rolled FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.rn = (b.rn + 2) % b.c")
def rolled(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = lines.withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    return series.rolled(lines, "l_orderkey", "place", "l_quantity", 2).select("l_orderkey", "l_linenumber", "rolled")


VOTE = f"{NEAR}, v AS (SELECT i, p.label, count(*) AS n FROM near JOIN p ON p.id = j WHERE i <> j GROUP BY i, p.label), b AS (SELECT i, arg_max(label, (n, -label)) AS predicted FROM v GROUP BY i)"


def voted(spark, d):
    own = points(spark, d).select("id", "label")
    return evaluate.vote(knn(points(spark, d), K), own).join(own, "id")


@query(f"WITH {VOTE} SELECT label AS truth, predicted, count(*) AS n FROM b JOIN p ON p.id = i GROUP BY ALL")
def confusion(spark, d):
    return evaluate.confusion(voted(spark, d), "label", "predicted")


@query(f"WITH {VOTE} SELECT round(avg((label = predicted)::INT), 5) AS accuracy FROM b JOIN p ON p.id = i")
def accuracy(spark, d):
    return rounded(evaluate.accuracy(voted(spark, d), "label", "predicted"), "accuracy")


U = "u AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)"


def coordinates(df: DataFrame) -> DataFrame:
    """A row for each coordinate of each point."""
    return rounded(df.select("id", F.posexplode("features").alias("pos", "x")), "x")


@query(f"WITH {U} SELECT vec_id AS id, (k - 1)::INT AS pos, round(x / (SELECT max(x) FROM u), 5) + 0.0 AS x FROM u")
def scaled_features(spark, d):
    return coordinates(scaled_by_max(points(spark, d)))


@query(f"WITH {U}, m AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY k) SELECT vec_id AS id, (k - 1)::INT AS pos, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) + 0.0 AS x FROM u JOIN m USING (k)")
def standardized_features(spark, d):
    return coordinates(standardised(points(spark, d)))


@query("SELECT l_returnflag, l_linestatus, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def label_codes(spark, d):
    kinds = table(spark, d, "lineitem", "l_returnflag", "l_linestatus").distinct()
    codes = series.numbered(kinds.select("l_returnflag").distinct(), "l_returnflag").withColumnRenamed("_rn", "code")
    return kinds.join(codes, "l_returnflag").select("l_returnflag", "l_linestatus", "code")


@query("SELECT p_partkey, starts_with(p_type, 'PROMO') AS promo, regexp_matches(p_name, '^[a-m]') AS early, p_size BETWEEN 10 AND 20 AS middle FROM part")
def part_predicates(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_type", "p_name", "p_size")
    return p.select("p_partkey", F.col("p_type").startswith("PROMO").alias("promo"), F.col("p_name").rlike("^[a-m]").alias("early"), F.col("p_size").between(10, 20).alias("middle"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersection(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, d):
    placed = table(spark, d, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'")
    return table(spark, d, "customer", "c_custkey").join(placed, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    return rounded(windows.tumbling(table(spark, d, "events", "ts", "event_type", "value"), "ts", "event_type", "1 day"), "total", to=4)


@query("WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(spark, d):
    return windows.sessions(table(spark, d, "events", "ts", "user_id"), "ts", "user_id", "6 hours")


@query()
def embed_isomap(spark, d):
    return embed.isomap(points(spark, d).drop("label"), K, 2)


@query()
def embed_metric(spark, d):
    return embed.embed(points(spark, d).drop("label"), K, 2)


@query()
def cluster_embed(spark, d):
    return embed.cluster_embed(points(spark, d).drop("label"), K, 10).points


@query()
def linkage_clusters(spark, d):
    return clusters.average_clusters(points(spark, d), 10)


@query()
def kmeans(spark, d):
    return clusters.kmeans(points(spark, d), 10, 1)


@query()
def pca(spark, d):
    return evaluate.pca(points(spark, d), 8)


@query()
def pair_sets_index(spark, d):
    both = clusters.kmeans(points(spark, d), 10, 1).join(points(spark, d).select("id", "label"), "id")
    return spark.createDataFrame([(evaluate.pair_sets_index(both, "cluster", "label"),)], "psi double")


@query()
def classifier_accuracy(spark, d):
    return spark.createDataFrame([evaluate.classifier_accuracy(points(spark, d))], "train double, test double")


@query()
def poisson_regression(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return evaluate.poisson_regression(lines, "l_quantity", ["l_discount", "l_tax"])


@query("SELECT a.x * 5 + a.y AS a, b.x * 5 + b.y AS b FROM (SELECT x, y FROM range(5) t(x), range(5) u(y)) a, (SELECT x, y FROM range(5) t(x), range(5) u(y)) b WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.x * 5 + a.y < b.x * 5 + b.y")
def grid_neighbours(spark, d):
    return paths.grid_neighbours(spark, 5)


@query("""WITH b AS (SELECT least(floor(l_discount * 10 / 0.1), 9)::BIGINT AS bx, least(floor(l_tax * 10 / 0.1), 9)::BIGINT AS "by", l_quantity AS q FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 AND l_tax BETWEEN 0 AND 0.1), c AS (SELECT bx, "by", avg(q) AS v FROM b GROUP BY ALL),
g AS (SELECT DISTINCT x, y FROM range(-1, 11) r(x), range(-1, 11) s(y), c WHERE abs(x - bx) + abs(y - "by") <= 1), a AS (SELECT x, y FROM range(10) r(x), range(10) s(y) WHERE (SELECT count(*) FROM g WHERE abs(g.x - r.x) + abs(g.y - s.y) <= 1) = 5)
SELECT 'all' AS key, a.x AS bx, a.y AS "by", round(sum(c.v * exp(-(pow(a.x - c.bx, 2) + pow(a.y - c."by", 2)) / 2.0)) / sum(exp(-(pow(a.x - c.bx, 2) + pow(a.y - c."by", 2)) / 2.0)), 5) AS value FROM a, c GROUP BY a.x, a.y """)
def smoothed_map(spark, d):
    lines = table(spark, d, "lineitem", "l_discount", "l_tax", "l_quantity")
    cells = series.binned_mean(lines, F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), 0.0, 0.1, 10)
    return rounded(grids.smooth_maps(cells.select(F.lit("all").alias("key"), "bx", "by", F.col("mean").alias("value")), 1.0, 10), "value")


@query()
def spectral_embedding(spark, d):
    return grids.spectral(neighbours(spark, d), 2)


@query()
def denoised_sample(spark, d):
    return grids.denoised_sample(fuzzy.fuzzy_union(fuzzy.smooth_weights(neighbours(spark, d))), 100)


@query()
def radial_sample(spark, d):
    return grids.radial_sample(points(spark, d), 10)


@query("""WITH e AS (SELECT l_returnflag, min(l_extendedprice)::DOUBLE AS low, max(l_extendedprice)::DOUBLE AS high FROM lineitem GROUP BY l_returnflag),
c AS (SELECT l_returnflag, low, high, least(floor((l_extendedprice - low) * 4096 / (high - low)), 4095) AS cell, count(*) AS n, avg(l_extendedprice) AS x FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL),
m AS (SELECT l_returnflag, sum(n) AS whole, sum(n * x) / sum(n) AS mean FROM c GROUP BY l_returnflag), v AS (SELECT l_returnflag, any_value(whole) AS whole, sqrt(sum(n * pow(x - mean, 2)) / (any_value(whole) - 1)) * pow(0.75 * any_value(whole), -0.2) AS width FROM c JOIN m USING (l_returnflag) GROUP BY l_returnflag),
g AS (SELECT l_returnflag, low + (high - low) * unnest(range(0, 1000)) / 999 AS place FROM e), d AS (SELECT l_returnflag, place, sum(n * exp(-pow(place - x, 2) / (2 * width * width))) AS density FROM g JOIN c USING (l_returnflag) JOIN v USING (l_returnflag) GROUP BY ALL)
SELECT l_returnflag, round(arg_max(place, density), 2) AS mode FROM d GROUP BY l_returnflag""")
def density_modes(spark, d):
    return rounded(grids.density_modes(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice"), "mode", to=2)


@query()
def smooth_rate_map(spark, d):
    lines = table(spark, d, "lineitem", "l_discount", "l_tax", "l_quantity")
    cell = F.least(F.floor(F.col("l_discount") * 50), F.lit(4)) * 5 + F.least(F.floor(F.col("l_tax") * 50), F.lit(4))
    return grids.smooth_rate_map(lines.withColumn("bin", cell), "bin", "l_quantity", paths.grid_neighbours(spark, 5), 10.0)


@query("""WITH s AS (SELECT l_returnflag, l_orderkey % 400 AS slot, avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY slot) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS size FROM s),
r AS (SELECT x.l_returnflag, (x.k - y.k + x.size) % x.size AS shift, corr(x.a, y.b) AS r FROM n x JOIN n y USING (l_returnflag) GROUP BY ALL), o AS (SELECT l_returnflag, r AS r0 FROM r WHERE shift = 0)
SELECT l_returnflag, round(any_value(r0), 6) AS r, round(avg((r >= r0 - 1e-12)::INT), 6) AS above FROM r JOIN o USING (l_returnflag) GROUP BY l_returnflag""")
def shuffled_correlation(spark, d):
    """Against all circular shifts."""
    lines = table(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_quantity", "l_extendedprice")
    days = lines.groupBy("l_returnflag", (F.col("l_orderkey") % 400).alias("slot")).agg(F.avg("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"))
    return rounded(grids.shuffled_correlation(days, "l_returnflag", "slot", "a", "b", None), "r", "above", to=6)


@query(f"WITH {U} SELECT vec_id AS id, (k - 1)::INT AS pos, round(x, 5) + 0.0 AS x FROM u WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 100)")
def sampled_points(spark, d):
    return coordinates(sample(points(spark, d), 100))


@query(f"WITH {P}, q AS (SELECT id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, list_dot_product(v, v) AS s FROM p) SELECT id, round(n, 5) AS norm, round(s, 5) AS dot FROM q")
def vector_norms(spark, d):
    return points(spark, d).select("id", F.round(vectors.norm(F.col("features")), 5).alias("norm"), F.round(vectors.dot(F.col("features"), F.col("features")), 5).alias("dot"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: neighbours, local normalisation, star edges, canonical merge."""
    return QUERIES["tconorm_canonical"](spark, d)


from . import graph_queries, search_queries, shape_queries, table_queries  # noqa: E402, F401  they add their queries to QUERIES and SQL
