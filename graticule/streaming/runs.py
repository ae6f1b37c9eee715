"""Runs of events in a stream, with state that shrinks: a run goes out once the watermark says that nothing can be added to it.

State holds a key's open runs only. Rows may come in any order within the watermark's delay, and join runs that were apart; later rows, not after the
watermark, are dropped. A timer for each run's
end closes it, in append mode, so what has been written stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of runs, of which those with less than gap between them are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(runs):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class _Runs(StatefulProcessor):
    """Times are milliseconds. A key's open runs are a map by their ends, so that a timer, one for each end, looks at one of them only."""

    def __init__(self, key: str, gap: int) -> None:
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "last long", "first long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        times = [int(t) for part in rows for t in part["event_ms"] if not pd.isna(t) and t > mark]
        if times:
            before = {last[0]: tuple(v) for last, v in self.open.iterator()} if self.open.exists() else {}
            runs = joined([(first, last, n) for last, (first, n) in before.items()] + [(t, t, 1) for t in times], self.gap)
            after = {last: (first, n) for first, last, n in runs}
            for last in before.keys() - after.keys():
                self.open.removeKey((last,))
            for last, run in after.items():
                if before.get(last) != run:
                    self.open.updateValue((last,), run)
                if last not in before:
                    self.handle.registerTimer(last + self.gap)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs() - self.gap
        if self.open.containsKey((last,)):  # else the run went on
            first, n = self.open.getValue((last,))
            self.open.removeKey((last,))
            yield pd.DataFrame({self.key: [key[0]], "first": [first], "last": [last], "n": [n]})

    def close(self) -> None:
        pass


def active_runs(events: DataFrame, key: str, ts: str, gap: float, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n) of a stream's events (ts: timestamp): runs of a key without a pause of gap seconds, each once it is over by the
    watermark. Rows without a time, or of 1970-01-01 00:00:00 and before, where watermarks begin, are in no run. Needs the RocksDB state store (see
    finished)."""
    kind = dict(events.dtypes)[key]
    own = events.select(key, ts, F.unix_millis(ts).alias("event_ms")).withWatermark(ts, late)
    found = own.groupBy(key).transformWithStateInPandas(_Runs(key, int(gap * 1000)), f"{key} {kind}, first long, last long, n long", "Append", "EventTime")
    return found.select(key, F.timestamp_millis("first").alias("first"), F.timestamp_millis("last").alias("last"), "n")


def finished(runs: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Run a stream in append mode over what is there, write its rows to a folder, and read it. A stream that is run again goes on from its checkpoint
    and adds to the folder."""
    spark = runs.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = runs.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(runs.schema).parquet(path)
