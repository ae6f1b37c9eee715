"""Runs of a stream against the same over a table."""

import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from graticule.streaming import runs


def batch_runs(rows, gap):
    out = []
    by = defaultdict(list)
    for k, t in rows:
        by[k].append((t, t, 1))
    for k, own in by.items():
        out += [(k, *r) for r in runs.joined(own, gap)]
    return sorted(out, key=str)


def test_runs_of_a_stream_in_batches_with_late_rows(spark, tmp_path):
    draw = random.Random(0)
    folder, gap, delay = str(tmp_path / "in"), 30, 60
    batches, high, wanted, mark = [], 0, [], None
    for part in range(4):
        low = part * 400
        rows = [(draw.choice(["a", "b", None]), draw.randrange(low + 1, low + 400)) for _ in range(60)]
        if part:
            rows += [("a", low - 300), ("b", 5), ("late", 1), ("a", high - delay + 1)]
        batches.append(rows)
        wanted += [r for r in rows if mark is None or r[1] > mark]
        high = max(high, *(t for _, t in rows))
        mark = high - delay
    for k, rows in enumerate(batches):
        one = spark.createDataFrame([*rows, ("a", None)], "k string, t long").coalesce(1)
        one.write.parquet(f"{folder}/{k}")
        os.utime(next(f.path for f in os.scandir(f"{folder}/{k}") if f.name.endswith(".parquet")), (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("k string, t long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn("ts", F.timestamp_seconds("t"))
    found = runs.finished(runs.active_runs(stream, "k", "ts", gap, f"{delay} seconds"), str(tmp_path / "state"), str(tmp_path / "out"))
    got = sorted(((r.k, int(r.first.timestamp()), int(r.last.timestamp()), r.n) for r in found.collect()), key=str)
    # What ends within the delay stays open.
    assert got == [r for r in batch_runs(wanted, gap) if r[2] + gap <= mark]
    again = spark.createDataFrame([("a", 9000), ("b", 9000)], "k string, t long").coalesce(1)
    again.write.parquet(f"{folder}/9")
    stream = spark.readStream.schema("k string, t long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn("ts", F.timestamp_seconds("t"))
    more = runs.finished(runs.active_runs(stream, "k", "ts", gap, f"{delay} seconds"), str(tmp_path / "state"), str(tmp_path / "out"))
    assert more.count() == len(batch_runs(wanted, gap))
