"""Helpers shared by the corpus operators: Arrow batch sizes, shared folders, table access."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import drop, materialise, remove, shared_dir

__all__ = ["dealt_evenly", "discard", "file_system", "map_arrow", "materialise", "remove", "sent", "shared_dir", "table"]

#: Rows and bytes of one Arrow batch handed to a Python worker; together they bound its memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named Parquet table, with only the named columns read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def sent(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of materialise() with narrow rows, to be broadcast if it has `most` of them at most; beyond that Spark joins it by a shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more. Shuffle files of finished jobs go when the driver's JVM collects what they belonged to."""
    drop(*tables)
    tables[0].sparkSession._jvm.System.gc()


def release_others(owner: str) -> None:
    """Let go of what other operators remember in this Python worker: workers outlive operators, and each should hold one's memory only. What is free goes back to the system."""
    for name, module in list(sys.modules.items()):
        if name.startswith(__package__ + ".") and name != owner and hasattr(module, "release"):
            module.release()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS, n_bytes: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow with batches of bounded size (the settings hold from here on, until the next call)."""
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(owner)
        yield from fn(batches)

    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
    return df.mapInArrow(run, schema)


def file_system(uri: str) -> tuple:
    """(pyarrow file system, path) of a URI or local path, on driver and executors alike."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def dealt_evenly(df: DataFrame, n: int) -> DataFrame:
    """The rows of a small table, such as a list of files, dealt to n tasks in turn."""
    return df.coalesce(1).repartition(max(1, n))
