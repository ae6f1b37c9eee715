"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has asked for and not yet deleted.
_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, or below the context's checkpoint folder; only where neither is set and Spark runs in one process, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; drop() deletes it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        q = jvm.org.apache.hadoop.fs.Path(p)
        q.getFileSystem(conf).delete(q, True)
        if p in _made:
            _made.remove(p)


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def sweep(spark: SparkSession) -> None:
    """Delete every folder that this process has made below the shared one: call it when results have been read or written elsewhere."""
    remove(spark, *_made)
