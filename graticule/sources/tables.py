"""Readers and sinks for point tables."""

from __future__ import annotations

import io
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder, with only the named columns read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv_points(spark: SparkSession, path: str, schema: str, drop: list[str] | None = None, label: str | None = None, codes: dict[str, int] | None = None) -> DataFrame:
    """(id, features, label) of a CSV file with a header. The schema is stated, not inferred; id is a column or the hash of the row."""
    df = spark.read.csv(path, header=True, schema=schema).drop(*(drop or []))
    if codes:
        df = df.withColumn(label, F.element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.col(label)))
    features = [c for c in df.columns if c not in ("id", label)]
    ident = F.col("id").cast("long") if "id" in df.columns else F.xxhash64(*df.columns)
    return df.select(ident.alias("id"), F.array(*(F.col(c).cast("double") for c in features)).alias("features"), *([F.col(label).alias("label")] if label else []))


def sample(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by the MD5 of seed and id: the same for any partitioning."""
    return points.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(n)


def every(points: DataFrame, step: int, *order: str) -> DataFrame:
    """Every step-th row, the first one included, in the order of columns. Rows are numbered partition by partition, so no task holds them all."""
    from ..operators.series import numbered

    return numbered(points, *order).where(F.col("_rn") % step == 0).drop("_rn")


def halves(points: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first and the second half of the rows in the order of columns; of an odd number the last row is left out."""
    from ..operators.series import numbered

    half = points.count() // 2
    rows = numbered(points, *order)
    return rows.where(F.col("_rn") < half).drop("_rn"), rows.where((F.col("_rn") >= half) & (F.col("_rn") < 2 * half)).drop("_rn")


def scaled_by_max(points: DataFrame) -> DataFrame:
    """points with features over their global largest value."""
    largest = points.agg(F.max(F.array_max("features")).alias("_max"))
    return points.crossJoin(F.broadcast(largest)).withColumn("features", F.transform("features", lambda x: x / F.col("_max"))).drop("_max")


def standardised(points: DataFrame) -> DataFrame:
    """points with each coordinate less its mean, over its population deviation (1 where that is 0)."""
    each = points.select("id", F.posexplode("features").alias("pos", "x"))
    moments = each.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    array = moments.agg(F.sort_array(F.collect_list(F.struct("pos", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("_ms"))
    joined = points.crossJoin(F.broadcast(array))
    return joined.withColumn("features", F.zip_with("features", "_ms", lambda x, k: (x - k["m"]) / k["s"])).drop("_ms")


def image_points(parts: list[DataFrame], most: float = 255.0, n: int | None = None, seed: int = 42) -> DataFrame:
    """(id, features, label) of tables (id, image: rows of pixels, label) under one another, pixels over their largest value, rows joined; n of them, or all."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.select("id", F.transform(F.flatten("image"), lambda x: x.cast("double") / most).alias("features"), "label")
    return out if n is None else sample(out, n, seed)


def npz_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, place, values) of the numeric arrays in .npz files: a row for each along the first axis, flattened. Nothing is unpickled."""
    def run(batches):
        for files in batches:
            for where, content in zip(files["path"], files["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        rows = np.atleast_1d(arrays[name])
                        yield pd.DataFrame({"path": where, "name": name, "place": np.arange(len(rows)), "values": [r.astype(float).ravel() for r in rows]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, place long, values array<double>")


def write_stamped(df: DataFrame, folder: str, name: str) -> str:
    """df as Parquet below folder, under a name with the time; an existing table is never overwritten. Returns the path."""
    path = f"{folder.rstrip('/')}/{name}-{time.strftime('%Y%m%d-%H%M%S')}.parquet"
    df.write.mode("errorifexists").parquet(path)
    return path


def typed_cells(spark: SparkSession, path: str) -> DataFrame:
    """(row, place, text, number) of the cells of a CSV file without a header: number is null where a cell is none."""
    lines = spark.read.csv(path, header=False, inferSchema=False)
    cells = F.posexplode(F.array(*lines.columns)).alias("place", "text")
    return lines.select(F.xxhash64(*lines.columns).alias("row"), cells).select("row", "place", "text", F.expr("try_cast(text AS double)").alias("number"))


def concatenated(parts: dict[str, DataFrame], name: str = "sample") -> DataFrame:
    """Samples under one another, ids made unique by the sample's name."""
    frames = [df.withColumn(name, F.lit(k)).withColumn("id", F.concat_ws("-", F.lit(k), F.col("id").cast("string"))) for k, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_points(points: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Points as Parquet, or as CSV with a column for each coordinate."""
    if form == "csv":
        n = points.agg(F.max(F.size("features"))).first()[0] or 0
        points = points.select(*(c for c in points.columns if c != "features"), *(F.get("features", F.lit(k)).alias(f"x{k}") for k in range(n)))
        points.write.mode(mode).csv(path, header=True)
    else:
        points.write.mode(mode).parquet(path)
