"""Further queries on tables, series, samples, labels, sinks and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import counts, evaluate, grids, series
from ..sources import tables
from ..sources.tables import table
from ..streaming import windows
from .catalogue import _IV, P, T, U, coordinates, events, intervals, points, query, rounded
from .storage import materialise, shared_dir


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 5 = 0")
def stride_sample(spark, d):
    return tables.every(table(spark, d, "orders", "o_orderkey"), 5, "o_orderkey")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () // 2 AS h FROM orders) SELECT o_orderkey, (n // h)::INT AS half FROM n WHERE n < 2 * h")
def split_halves(spark, d):
    first, second = tables.halves(table(spark, d, "orders", "o_orderkey"), "o_orderkey")
    return first.withColumn("half", F.lit(0)).unionByName(second.withColumn("half", F.lit(1)))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 150")
def most_active(spark, d):
    return series.most_active(table(spark, d, "orders", "o_orderkey", "o_totalprice"), 150, "o_totalprice", "o_orderkey")


_EDGES = [0.0, 0.025, 0.045, 0.075, 0.105]
_CELL = "CASE WHEN {0} >= 0 AND {0} < 0.105 THEN ({0} >= 0.025)::INT + ({0} >= 0.045)::INT + ({0} >= 0.075)::INT END"


@query(f"WITH b AS (SELECT ({_CELL.format('l_discount')}) * 4 + ({_CELL.format('l_tax')}) AS bin FROM lineitem) SELECT bin, bin + 1 AS hot, 16 AS size, count(*) AS n FROM b GROUP BY ALL")
def one_hot_bins(spark, d):
    lines = series.one_hot_bins(table(spark, d, "lineitem", "l_discount", "l_tax"), ["l_discount", "l_tax"], _EDGES)
    return lines.select("bin", F.array_position("hot", F.lit(1)).alias("hot"), F.size("hot").alias("size")).groupBy("bin", "hot", "size").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT l_quantity AS y, l_extendedprice / 1500 AS p FROM lineitem), m AS (SELECT avg(y) AS m FROM l), s AS (SELECT sum(y * ln(p) - p) AS ll, sum(y * ln(m) - m) AS ll0, sum(y * ln(y) - y) AS ls FROM l, m) SELECT round((ll - ll0) / (ls - ll0), 5) AS deviance FROM s")
def deviance_explained(spark, d):
    lines = table(spark, d, "lineitem", "l_quantity", "l_extendedprice").withColumn("guess", F.col("l_extendedprice") / 1500)
    return rounded(series.deviance_explained(lines, "l_quantity", "guess"), "deviance")


@query(f"WITH {T}, a AS (SELECT event_id, (t % 86400) / 86400 * 2 * pi() + 4 AS x FROM e) SELECT event_id, round(x - 2 * pi() * floor(x / (2 * pi())), 5) + 0.0 AS angle FROM a")
def circular_shift(spark, d):
    angle = F.col("t") % 86400 / 86400 * 2 * math.pi
    return rounded(events(spark, d).select("event_id", series.circular_shift(angle, 4.0).alias("angle")), "angle")


@query(f"WITH {T}, b AS (SELECT event_type, user_id, min(t) AS birth, max(t) AS death FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY death - birth DESC, birth)::INT AS rank FROM b) SELECT event_type, user_id, rank, round(death - birth, 3) AS lifetime FROM r WHERE rank <= 30")
def longest_bars(spark, d):
    bars = events(spark, d).groupBy("event_type", "user_id").agg(F.min("t").alias("birth"), F.max("t").alias("death"))
    return rounded(series.longest(bars, 30, "event_type", "birth", "death").select("event_type", "user_id", "rank", "lifetime"), "lifetime", to=3)


@query("WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_min(l_quantity, (-n, l_quantity)) AS mode FROM c GROUP BY l_suppkey")
def modes(spark, d):
    return series.modes(table(spark, d, "lineitem", "l_suppkey", "l_quantity"), "l_suppkey", "l_quantity")


_GRID = f"""WITH {T}, {_IV}, k AS (SELECT event_type, t, avg(value) AS v, avg(user_id) AS u FROM e GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(ceil(min(t) / 3600)::BIGINT, floor(max(t) / 3600)::BIGINT)) AS n FROM k GROUP BY event_type),
h AS (SELECT event_type, n, n * 3600.0::DOUBLE AS t FROM g),
a AS (SELECT h.event_type, h.n, h.t, k.t AS t0, k.v AS v0, k.u AS u0 FROM h ASOF JOIN k ON h.event_type = k.event_type AND h.t >= k.t),
b AS (SELECT h.event_type, h.n, k.t AS t1, k.v AS v1, k.u AS u1 FROM h ASOF JOIN k ON h.event_type = k.event_type AND h.t <= k.t),
r AS (SELECT event_type, n, t, CASE WHEN t0 = t THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS x, CASE WHEN t0 = t THEN u0 ELSE u0 + (u1 - u0) * (t - t0) / (t1 - t0) END AS y FROM a JOIN b USING (event_type, n)),
i AS (SELECT r.* FROM r JOIN iv ON t >= s AND t < f),
w AS (SELECT p.event_type, p.t, sum(q.x * exp(-pow(p.n - q.n, 2) / 4.5)) / sum(exp(-pow(p.n - q.n, 2) / 4.5)) AS x, sum(q.y * exp(-pow(p.n - q.n, 2) / 4.5)) / sum(exp(-pow(p.n - q.n, 2) / 4.5)) AS y FROM i p JOIN i q ON p.event_type = q.event_type AND abs(p.n - q.n) <= 8 GROUP BY ALL),
l AS (SELECT *, lag(t) OVER z AS t0, lag(x) OVER z AS x0, lag(y) OVER z AS y0 FROM w WINDOW z AS (PARTITION BY event_type ORDER BY t))"""


@query(f"{_GRID} SELECT event_type, t, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(sqrt(pow(x - x0, 2) + pow(y - y0, 2)) / (t - t0), 6) + 0.0 AS speed FROM l")
def position_track(spark, d):
    found = series.track(events(spark, d), "event_type", "t", "value", "user_id", 3600.0, intervals(spark), 1.5)
    return rounded(rounded(found, "x", "y", to=4), "speed", to=6)


@query(f"""WITH {T}, {_IV}, c AS (SELECT user_id FROM e GROUP BY user_id HAVING count(*) >= 8), k AS (SELECT user_id, floor(t / 43200)::BIGINT AS bin, count(*) AS n FROM e SEMI JOIN c USING (user_id) JOIN iv ON t >= s AND t < f GROUP BY ALL),
g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin))) AS bin FROM k GROUP BY user_id), b AS (SELECT user_id, bin, coalesce(n, 0) AS n FROM g LEFT JOIN k USING (user_id, bin))
SELECT p.user_id, p.bin, any_value(p.n) AS n, round(sum(q.n * exp(-pow(p.bin - q.bin, 2) / 2.0) / sqrt(2 * pi())), 5) AS smooth FROM b p JOIN b q ON p.user_id = q.user_id AND abs(p.bin - q.bin) <= 5 GROUP BY p.user_id, p.bin""")
def spike_rates(spark, d):
    return rounded(series.spike_rates(events(spark, d), "user_id", "t", 43200.0, intervals(spark), 1.0, 8), "smooth")


_SUMS = "s AS (SELECT user_id AS doc, event_type AS term, sum(value) AS value FROM events GROUP BY ALL), q AS (SELECT term, quantile_cont(value, 0.75) FILTER (value > 0) AS q FROM s GROUP BY term)"


def _sums(spark, d):
    return materialise(table(spark, d, "events", "user_id", "event_type", "value").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("term")).agg(counts.steady_sum("value").alias("value")), "sums")


@query(f"WITH {_SUMS} SELECT doc, bool_or(term = 'login' AND value > q) AS present, bool_or(term = 'purchase' AND value > q) AS buying FROM s JOIN q USING (term) GROUP BY doc")
def marker_masks(spark, d):
    return counts.marker_masks(_sums(spark, d), {"present": "login", "buying": "purchase"})


@query(f"""WITH {_SUMS}, m(term, label, place) AS (VALUES ('login', 'in', 0), ('purchase', 'buyer', 1), ('click', 'clicker', 2)),
h AS (SELECT doc, label, value, place FROM s JOIN m USING (term) JOIN q USING (term) WHERE value > q), b AS (SELECT doc, arg_max(label, (value, -place)) AS label, count(*) AS k FROM h GROUP BY doc),
l AS (SELECT DISTINCT s.doc, coalesce(label, 'Other') AS label, coalesce(k, 0) AS k FROM s LEFT JOIN b USING (doc)), n AS (SELECT label, count(*) AS n, count(*) FILTER (k > 1) AS n_multiple FROM l GROUP BY label)
SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS code, n, round(n / sum(n) OVER (), 6) AS share, n_multiple FROM n""")
def label_job(spark, d):
    markers = [("login", "in"), ("absent", "nobody"), ("purchase", "buyer"), ("click", "clicker")]
    return rounded(counts.label_job(_sums(spark, d), markers), "share", to=6)


_PARTS = "t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), ra AS (SELECT a, sum(n) AS na, row_number() OVER (ORDER BY sum(n) DESC) AS ka FROM t GROUP BY a), rb AS (SELECT b, sum(n) AS nb, row_number() OVER (ORDER BY sum(n) DESC) AS kb FROM t GROUP BY b)"


@query(f"""WITH RECURSIVE {_PARTS}, s AS (SELECT ka, kb, coalesce(n, 0) / greatest(na, nb) AS share FROM ra CROSS JOIN rb LEFT JOIN t USING (a, b)),
m(k, used, total) AS (SELECT 0::BIGINT, []::BIGINT[], 0.0::DOUBLE UNION ALL SELECT m.k + 1, list_append(used, kb), total + share FROM m JOIN s ON s.ka = m.k + 1 WHERE NOT list_contains(used, kb)),
best AS (SELECT max(total) AS s FROM m WHERE k = (SELECT count(*) FROM ra)), x AS (SELECT sum(na * nb / (SELECT sum(n) FROM t) / greatest(na, nb)) AS e FROM ra JOIN rb ON ka = kb), big AS (SELECT greatest((SELECT count(*) FROM ra), (SELECT count(*) FROM rb)) AS k)
SELECT round(CASE WHEN s >= e THEN (s - e) / (k - e) ELSE 0 END, 6) + 0.0 AS psi FROM best, x, big""")
def pair_sets_of_orders(spark, d):
    orders = table(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    return rounded(spark.createDataFrame([(evaluate.pair_sets_index(orders, "o_orderstatus", "o_orderpriority"),)], "psi double"), "psi", to=6)


@query("WITH w AS (SELECT event_type, value, epoch_us(ts) AS t, unnest(range(0, 4)) AS k FROM events), s AS (SELECT event_type, value, (t // 21600000000 - k) * 21600000000 AS start FROM w) SELECT make_timestamp(start) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL")
def sliding_windows(spark, d):
    return rounded(windows.tumbling(table(spark, d, "events", "ts", "event_type", "value"), "ts", "event_type", "1 day", slide="6 hours"), "total", to=4)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """The same windows from a stream of the table's files, run to its end."""
    schema = table(spark, d, "events").schema
    # A watermark needs times with a zone; windows of days are the session's, so that casting there and back is the identity.
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows.run_available(windows.tumbling(stream, "ts", "event_type", "1 day"), shared_dir(spark, "stream"), shared_dir(spark, "windows"))
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", to=4)


@query(f"WITH {U} SELECT vec_id AS id, (k - 1)::INT AS pos, round(x, 5) + 0.0 AS x, CASE label WHEN 1 THEN 10 WHEN 2 THEN 20 END AS label FROM u JOIN embeddings USING (vec_id) WHERE k <= 5")
def csv_points(spark, d):
    """Points written as CSV and read again, a column left out and labels mapped."""
    path = shared_dir(spark, "csv")
    own = points(spark, d).select("id", F.col("label").cast("string").alias("label"), F.slice("features", 1, 6).alias("features"))
    tables.write_points(own, path, "csv")
    schema = "id long, label string, " + ", ".join(f"x{k} double" for k in range(6))
    found = tables.csv_points(spark, path, schema, drop=["x5"], label="label", codes={"1": 10, "2": 20})
    return rounded(found.select("id", F.posexplode("features").alias("pos", "x"), "label"), "x")


@query("SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END || '-' || vec_id AS id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS sample, label FROM embeddings")
def concatenated_samples(spark, d):
    own = points(spark, d).select("id", "label")
    return tables.concatenated({"low": own.where("label < 5"), "high": own.where("label >= 5")}).select("id", "sample", "label")


@query(f"WITH {P}, u AS (SELECT id, unnest(v[1:6]) AS x, generate_subscripts(v[1:6], 1) AS k FROM p) SELECT id, (k - 1)::INT AS pos, round(x / 255, 7) + 0.0 AS x FROM u")
def image_points(spark, d):
    """Two tables of 2 by 3 images as points."""
    images = points(spark, d).select("id", F.array(F.slice("features", 1, 3), F.slice("features", 4, 3)).alias("image"), "label")
    found = tables.image_points([images.where("id % 2 = 0"), images.where("id % 2 = 1")])
    return rounded(found.select("id", F.posexplode("features").alias("pos", "x")), "x", to=7)


@query(f"WITH {U} SELECT vec_id AS id, (k - 1)::INT AS pos, round(x, 5) + 0.0 AS x FROM u")
def stored_points(spark, d):
    """Points in a table with the time in its name, read again."""
    return coordinates(spark.read.parquet(tables.write_stamped(points(spark, d), shared_dir(spark, "stored"), "points")))


_ANGLES = f"{T}, w AS (SELECT event_id, (t % 86400) / 86400 * 2 * pi() AS u, (t % 3600) / 3600 * 2 * pi() AS v FROM e)"
_MOD = "{0} - 2 * pi() * floor(({0}) / (2 * pi()))"


def _angles(spark, d):
    turn = lambda seconds: F.col("t") % seconds / seconds * 2 * math.pi
    return events(spark, d).select("event_id", turn(86400).alias("u"), turn(3600).alias("v"))


_CASES = [("u", "2 * pi() - v"), ("u", "v + pi() / 3 * u"), ("u", "v + pi() / 3 * u"), ("v", "u + pi() / 3 * v"), ("2 * pi() - u + pi() / 3 * v", "v")]
_AXES = " UNION ALL ".join(f"SELECT {k} AS k, event_id, round({_MOD.format(f'({a})')}, 4) + 0.0 AS u, round({_MOD.format(f'({b})')}, 4) + 0.0 AS v FROM w" for k, (a, b) in enumerate(_CASES))


@query(f"WITH {_ANGLES} {_AXES}")
def hexagonal_axes(spark, d):
    """Five pairs of axes: one reversed, swapped twice, more than a right angle on, as much back, and a little back."""
    cases = [((0.2, 1.2), (1, -1)), ((1.2, 2.9), (1, 1)), ((0.1, 2.0), (1, 1)), ((2.9, 1.2), (1, 1)), ((2.9, 1.8), (1, 1))]
    found = [grids.hexagonal_axes(_angles(spark, d), a, s, "u", "v").select(F.lit(k).alias("k"), "event_id", "u", "v") for k, (a, s) in enumerate(cases)]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return rounded(out, "u", "v", to=4)


@query(f"""WITH {_ANGLES}, o AS (SELECT event_id, u + 1.3 + 0.1 * sin(v) AS a, v - 0.4 AS b FROM w WHERE event_id % 2 = 0),
s AS (SELECT atan2(avg(sin(u - a)), avg(cos(u - a))) AS x, atan2(avg(sin(v - b)), avg(cos(v - b))) AS y FROM w JOIN o USING (event_id))
SELECT event_id, round({_MOD.format('(u - x)')}, 4) + 0.0 AS u, round({_MOD.format('(v - y)')}, 4) + 0.0 AS v FROM w, s""")
def shifted_sessions(spark, d):
    own = _angles(spark, d)
    other = own.where("event_id % 2 = 0").select("event_id", (F.col("u") + 1.3 + 0.1 * F.sin("v")).alias("u"), (F.col("v") - 0.4).alias("v"))
    return rounded(grids.shifted_onto(own, other, "event_id", ["u", "v"]), "u", "v", to=4)
