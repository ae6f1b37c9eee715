"""Time series and events: bins, interval, band and as-of joins, smoothing, circular statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Intervals that are sent to every executor at most, to be looked at one by one; rows of their index that are sent at most, about 80 bytes each.
SENT, SENT_SPANS = 200, 500_000


def binned_counts(events: DataFrame, key: str, ts: str, width: float, fill: bool = False) -> DataFrame:
    """(key, bin, n): events in bins of `width` seconds since the epoch; with fill also the empty ones between each key's first and last."""
    counts = events.groupBy(key, F.floor(F.col(ts) / width).alias("bin")).agg(F.count("*").alias("n"))
    if not fill:
        return counts
    grid = counts.groupBy(key).agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    return grid.join(counts, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def _levels(intervals: DataFrame) -> tuple[DataFrame, list[int]]:
    """Intervals that hold anything, with _level, the power of two that their length does not exceed, and _bucket, the one or two stretches of that
    length they lie in; and the levels there are (as many as lengths have binary exponents)."""
    some = intervals.where(F.col("end") > F.col("start"))
    # A little more, so that rounding never makes a bucket shorter than what lies in it.
    level = F.ceil(F.log2((F.col("end") - F.col("start")).cast("double")) + 1e-9).cast("int")
    size = F.pow(F.lit(2.0), F.col("_level"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    spans = some.withColumn("_level", level).withColumn("_bucket", F.explode(F.array_distinct(F.array(at("start"), at("end")))))
    return spans, sorted(r[0] for r in some.select(level.alias("level")).distinct().collect())


def in_intervals(events: DataFrame, intervals: DataFrame, ts: str, outside: bool = False, indexed: bool | None = None) -> DataFrame:
    """events in half-open intervals (name, start, end), with the name; or those in none. Intervals without a length, or with a null end, hold
    nothing; an event without a time is in none.

    Intervals are counted: up to SENT are sent to every executor, which looks at each. More of them, or indexed, are kept by levels: an interval lies
    in the level of its own length, in two
    buckets there at most, and an event looks into one bucket of each level. So long intervals do not fill the buckets of short ones, and what meets
    is in proportion to what is found.
    The index is sent too if it has SENT_SPANS rows at most.
    """
    inside = (F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("end"))
    if not (intervals.count() > SENT if indexed is None else indexed):
        return events.join(F.broadcast(intervals), inside, "left_anti" if outside else "inner")
    spans, levels = _levels(intervals)
    if not levels:
        return events if outside else events.join(F.broadcast(intervals.limit(0)), F.lit(True))
    spans = F.broadcast(spans) if spans.count() <= SENT_SPANS else spans
    looks = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col(ts) / 2.0**k).cast("long").alias("bucket")) for k in levels)))
    same = (F.col("_look.level") == F.col("_level")) & (F.col("_look.bucket") == F.col("_bucket")) & inside
    if not outside:
        return events.withColumn("_look", looks).join(spans, same).drop("_look", "_level", "_bucket")
    from ..plans.storage import materialise

    rows = materialise(events.withColumn("_row", F.monotonically_increasing_id()), "events")
    met = rows.select("_row", ts).withColumn("_look", looks).join(spans, same, "left_semi").select("_row").distinct()
    return rows.join(met, "_row", "left_anti").drop("_row")


def lag_histogram(events: DataFrame, key: str, ts: str, most: float, bins: int) -> DataFrame:
    """(key, bin, n): histogram of time lags in (0, most) between events of one key. Events meet only those in their own and the next bucket of that
    length."""
    bucket = F.floor(F.col(ts) / most)
    a = events.select(F.col(key), F.col(ts).alias("t1"), F.explode(F.array(bucket, bucket + 1)).alias("b"))
    c = events.select(F.col(key), F.col(ts).alias("t2"), bucket.alias("b"))
    lags = a.join(c, [key, "b"]).select(key, (F.col("t2") - F.col("t1")).alias("lag")).where((F.col("lag") > 0) & (F.col("lag") < most))
    return lags.groupBy(key, F.floor(F.col("lag") * bins / most).alias("bin")).agg(F.count("*").alias("n"))


def _beside(rows: DataFrame, key: str, bucket: str, point: Column) -> tuple[DataFrame, Column]:
    """(_key, _of, _before, _after): the last point of any earlier bucket of a key and the first of any later one, and the condition that joins them
    to rows; points are structs that begin with their order, null where a row is none. One row for each bucket is what a task orders."""
    ends = rows.groupBy(key, bucket).agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    w = lambda c: W.partitionBy(key).orderBy(c).rowsBetween(W.unboundedPreceding, -1)
    found = ends.select(F.col(key).alias("_key"), F.col(bucket).alias("_of"), F.last("_last", ignorenulls=True).over(w(F.col(bucket))).alias("_before"), F.last("_first", ignorenulls=True).over(w(F.desc(bucket))).alias("_after"))
    return found, F.col(key).eqNullSafe(F.col("_key")) & F.col(bucket).eqNullSafe(F.col("_of"))


def resampled(events: DataFrame, key: str, ts: str, value: str, step: float, bucket: int = 4096) -> DataFrame:
    """(key, t, value): linear interpolation on a grid of `step` seconds between each key's first and last event; of events at one time the mean
    counts.

    A task orders bucket steps of a key; points beyond the ends of its time come from the buckets beside.
    """
    known = events.groupBy(key, F.col(ts).alias("t")).agg(F.avg(value).alias("v"))
    ends = known.groupBy(key).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    grid = ends.select(key, F.explode(F.sequence(F.ceil(F.col("low") / step), F.floor(F.col("high") / step))).alias("g")).select(key, (F.col("g") * step).alias("t"))
    both = known.select(key, "t", "v", F.lit(False).alias("grid")).unionByName(grid.select(key, "t", F.lit(None).cast("double").alias("v"), F.lit(True).alias("grid")))
    both = both.withColumn("_b", F.floor(F.col("t") / (step * bucket)))
    own = F.when(~F.col("grid"), F.struct("t", "v"))
    # The next point is the last one in reverse order: a frame that only grows, where one to the end would be read anew for each row.
    w = lambda t: W.partitionBy(key, "_b").orderBy(t, "grid").rowsBetween(W.unboundedPreceding, 0)
    placed = both.withColumn("a", F.last(own, ignorenulls=True).over(w(F.col("t")))).withColumn("b", F.last(own, ignorenulls=True).over(w(F.desc("t")))).where("grid")
    placed = placed.join(*_beside(both, key, "_b", own)).withColumns({"a": F.coalesce("a", "_before"), "b": F.coalesce("b", "_after")})
    line = F.when(F.col("a.t") == F.col("t"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return placed.select(key, "t", line.alias("value"))


def gaussian_smoothed(counts: DataFrame, key: str, at: str, value: str, sigma: float, support: float = 5.0) -> DataFrame:
    """counts (whole numbers at) with smooth: the sum of values within support * sigma, weighted by a Gaussian of their distance.

    Values are summed by place, and places dealt to buckets of time that are longer than the kernel reaches; a place near a bucket's end is copied to
    the one beside it, so a row becomes two at most
    whatever sigma is, and no task holds more of a key than a bucket. Rows with a null place or value add nothing; the former have no smooth either.
    """
    import numpy as np
    import pandas as pd

    reach = int(math.ceil(support * sigma))
    width = max(4096, 2 * reach)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2.0 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
    kind = dict(counts.dtypes)[key]
    places = counts.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at")).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("_v"))
    bucket = F.floor(F.col("_at") / width).cast("long")
    beside = F.array_compact(F.array(bucket, F.when(F.col("_at") - bucket * width < reach, bucket - 1), F.when((bucket + 1) * width - F.col("_at") <= reach, bucket + 1)))
    dealt = places.withColumn("_bucket", F.explode(beside))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = int(rows["_bucket"].iloc[0]) * width
        line = np.zeros(width + 2 * reach)
        at_ = rows["_at"].to_numpy() - low
        line[at_ + reach] = rows["_v"]
        own = (at_ >= 0) & (at_ < width)
        smooth = np.convolve(line, kernel, "valid")[at_[own]]
        return pd.DataFrame({"_key": rows["_key"][own], "_at": rows["_at"][own], "smooth": smooth})

    sums = dealt.groupBy("_key", "_bucket").applyInPandas(run, f"_key {kind}, _at long, smooth double")
    return counts.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) == F.col("_at")), "left").drop("_key", "_at")


def speeds(positions: DataFrame, key: str, t: str, x: str, y: str, tie: str | None = None, bucket: float = 86400.0) -> DataFrame:
    """positions with speed: distance over time since the row before; null for a key's first and where no time passed. tie orders rows of one time. A
    task orders bucket seconds of a key; the row before comes from the bucket before where there is none."""
    order = [t, *([tie] if tie else [])]
    row = F.struct(*order, F.col(x).alias("_x"), F.col(y).alias("_y"))
    rows = positions.withColumn("_b", F.floor(F.col(t) / bucket))
    before = F.lag(row).over(W.partitionBy(key, "_b").orderBy(*order))
    placed = rows.withColumn("_own", before).join(*_beside(rows, key, "_b", row)).withColumn("_own", F.coalesce("_own", "_before"))
    step = F.sqrt((F.col(x) - F.col("_own._x")) ** 2 + (F.col(y) - F.col("_own._y")) ** 2)
    passed = F.col(t) - F.col(f"_own.{t}")
    return placed.withColumn("speed", F.when(passed > 0, step / passed)).select(*positions.columns, "speed")


def track(positions: DataFrame, key: str, ts: str, x: str, y: str, step: float, valid: DataFrame | None = None, sigma: float | None = None) -> DataFrame:
    """(key, t, x, y, speed): positions on a grid of step seconds, within valid intervals (name, start, end), smoothed over sigma steps, and their
    speed."""
    at = lambda c: resampled(positions, key, ts, c, step).withColumnRenamed("value", f"_{c}")
    grid = at(x).join(at(y), [key, "t"])
    if valid is not None:
        grid = in_intervals(grid, valid, "t").drop("name", "start", "end")
    if sigma:
        grid = grid.withColumn("_n", F.round(F.col("t") / step).cast("long"))
        weights = gaussian_smoothed(grid.withColumn("_one", F.lit(1.0)), key, "_n", "_one", sigma).select(key, "_n", F.col("smooth").alias("_w"))
        for c in (x, y):  # a mean of what is known around
            smooth = gaussian_smoothed(grid.select(key, "_n", f"_{c}"), key, "_n", f"_{c}", sigma).select(key, "_n", F.col("smooth").alias("_s"))
            grid = grid.join(smooth, [key, "_n"]).join(weights, [key, "_n"]).withColumn(f"_{c}", F.col("_s") / F.col("_w")).drop("_s", "_w")
        grid = grid.drop("_n")
    return speeds(grid.select(key, "t", F.col(f"_{x}").alias("x"), F.col(f"_{y}").alias("y")), key, "t", "x", "y")


def spike_rates(spikes: DataFrame, key: str, ts: str, width: float, valid: DataFrame | None = None, sigma: float | None = None, least: int = 1) -> DataFrame:
    """(key, bin, n[, smooth]): spikes of cells with least spikes or more, within valid intervals, in bins of width seconds, empty ones too, smoothed
    over sigma bins."""
    cells = spikes.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    kept = spikes.join(cells, key, "left_semi")
    if valid is not None:
        kept = in_intervals(kept, valid, ts)
    counts = binned_counts(kept, key, ts, width, fill=True)
    return gaussian_smoothed(counts, key, "bin", "n", sigma) if sigma else counts


def modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode): each key's most frequent value, the smallest on ties."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(key).agg(F.max("_n").alias("_most"))
    return counts.join(best, key).where(F.col("_n") == F.col("_most")).groupBy(key).agg(F.min(value).alias("mode"))


def runs(flags: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first, last, n): runs of consecutive integers `at` within a key."""
    w = W.partitionBy(key).orderBy(at)
    numbered = flags.select(key, at).distinct().withColumn("_island", F.col(at) - F.row_number().over(w))
    return numbered.groupBy(key, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_island")


def circular_mean(angle: Column) -> Column:
    """Mean direction of angles, in [0, 2 pi)."""
    return F.pmod(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))), F.lit(2 * math.pi))


def binned_mean(df: DataFrame, x: Column, y: Column, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bx, by, n, mean, direction) over an even grid: mean and circular mean of the values."""
    place = lambda c: F.least(F.floor((c - low) * bins / (high - low)), F.lit(bins - 1))
    inside = df.where((x >= low) & (x <= high) & (y >= low) & (y <= high))
    return inside.groupBy(place(x).alias("bx"), place(y).alias("by")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), circular_mean(value).alias("direction"))


def information_score(df: DataFrame, key: str, bin: str, value: str) -> DataFrame:
    """(key, information): sum over bins of occupancy * rate / mean * log2(rate / mean)."""
    cells = df.groupBy(key, bin).agg(F.avg(value).alias("rate"), F.count("*").alias("n"))
    w = W.partitionBy(key)
    part = cells.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("mu", F.sum(F.col("rate") * F.col("n")).over(w) / F.sum("n").over(w))
    return part.groupBy(key).agg(F.sum(F.when(F.col("rate") > 0, F.col("p") * F.col("rate") / F.col("mu") * F.log2(F.col("rate") / F.col("mu")))).alias("information"))


def cumulative_histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, fraction): even bins in [low, high] and the share of values up to each one's end."""
    at = F.least(F.floor((value - low) * bins / (high - low)), F.lit(bins - 1))
    counts = df.where((value >= low) & (value <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    w = W.orderBy("bin")  # at most `bins` rows
    return counts.select("bin", "n", (F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("fraction"))


def explained(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """One row: r2 = 1 - SSE / SST, and Pearson's r."""
    mean = df.agg(F.avg(observed).alias("mean"))
    joined = df.crossJoin(F.broadcast(mean))
    return joined.agg((1 - F.sum((F.col(observed) - F.col(predicted)) ** 2) / F.sum((F.col(observed) - F.col("mean")) ** 2)).alias("r2"), F.corr(observed, predicted).alias("pearson"))


def min_max_scaled(df: DataFrame, value: str) -> DataFrame:
    """df with scaled: the value between the least (0) and the largest (1)."""
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return df.crossJoin(F.broadcast(ends)).withColumn("scaled", (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).drop("_low", "_high")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with _rn, the row's number from 0 on in the order of columns, which must be of one kind for all rows.

    Rows are dealt out by range; each range is numbered by itself and moved by the sizes of those before it, of which there are as many as tasks.
    """
    from ..plans.storage import materialise

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("_rn", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_id")


def most_active(df: DataFrame, n: int, activity: str, at: str) -> DataFrame:
    """The n rows of largest activity, the earliest on ties, in the order of at."""
    return df.orderBy(F.desc(activity), at).limit(n).orderBy(at)


def one_hot_bins(df: DataFrame, values: list[str], edges: list[float]) -> DataFrame:
    """df with bin and hot: the number of the cell that the values fall in, edges[i - 1] <= x < edges[i] along each, the first value the slowest, and
    a row of 0 and 1 for all cells. Null outside."""
    n = len(edges) - 1
    cell = lambda c: F.when((F.col(c) >= edges[0]) & (F.col(c) < edges[-1]), sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)))
    place = F.lit(0)
    for c in values:
        place = place * n + cell(c)
    hot = F.transform(F.sequence(F.lit(0), F.lit(n ** len(values) - 1)), lambda k: F.when(k == F.col("bin"), 1).otherwise(0))
    return df.withColumn("bin", place).withColumn("hot", F.when(F.col("bin").isNotNull(), hot))


def deviance_explained(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """One row: the share of the Poisson deviance between a constant rate and a saturated model that predicted rates take away, (LL - LL0) / (LS -
    LL0)."""
    mean = df.agg(F.avg(observed).alias("_mean"))
    y, p = F.col(observed), F.greatest(F.col(predicted), F.lit(1e-12))
    likelihood = lambda rate: F.sum(F.when(y > 0, y * F.log(rate)).otherwise(0.0) - rate)
    joined = df.crossJoin(F.broadcast(mean))
    parts = joined.agg(likelihood(p).alias("ll"), likelihood(F.col("_mean")).alias("ll0"), likelihood(y).alias("ls"))
    return parts.select(((F.col("ll") - F.col("ll0")) / (F.col("ls") - F.col("ll0"))).alias("deviance"))


def circular_shift(angle: Column, by: Column | float) -> Column:
    """Angles moved by some, in [0, 2 pi)."""
    return F.pmod(angle + by, F.lit(2 * math.pi))


def longest(bars: DataFrame, n: int, key: str, birth: str, death: str) -> DataFrame:
    """bars with lifetime and rank: the n of longest life of each key, the earliest on ties."""
    lived = bars.withColumn("lifetime", F.col(death) - F.col(birth))
    order = W.partitionBy(key).orderBy(F.desc("lifetime"), birth)
    return lived.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rolled(df: DataFrame, key: str, at: str, value: str, shift: int) -> DataFrame:
    """df with rolled: each key's values moved by shift rows, round the end; a null key is a key. Rows are numbered over ranges of key and at, so a
    key's series is no one task's."""
    n = numbered(df, key, at)
    ends = n.groupBy(F.col(key).alias("_key")).agg(F.min("_rn").alias("_low"), F.count("*").alias("_n"))
    n = n.join(ends, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("_rn", F.col("_rn") - F.col("_low"))
    moved = n.select(F.col(key).alias("_key"), F.pmod(F.col("_rn") + shift, F.col("_n")).alias("_to"), F.col(value).alias("rolled"))
    return n.join(moved, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_rn") == F.col("_to"))).select(*df.columns, "rolled")
