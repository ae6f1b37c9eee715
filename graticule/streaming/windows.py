"""Windows over event streams (an extension: batch operators have no counterpart here)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, key: str, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, key, n, total): counts and sums of value by window; works on streams, with a watermark, and on tables alike."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_available(counts: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Run an aggregating stream over what is there, each batch's whole result as a table of its own, and read the last one. A stream that is run again goes on from its checkpoint."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:010d}")

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.read.parquet(f"{path}/{query.lastProgress['batchId']:010d}")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of a key's events with no pause of `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
