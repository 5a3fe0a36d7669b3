"""Scans of the input tables and the sinks the pipeline writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; column pruning and filter pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallelism(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that has fewer input splits than the cluster has
    cores (e.g. one large unsplittable file); a no-op for the usual many-file
    input, where the scan is already parallel."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key)
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a declared schema (never inferred)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def list_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory listing of the input files (path, size, modification time)
    without reading their content into the driver."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
            .load(sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("file"),
                                 F.col("length").alias("bytes")))


def pasted_names(spark: SparkSession, text_df: DataFrame, col: str = "text") -> DataFrame:
    """Newline-separated names -> one trimmed, non-blank name per row."""
    return (text_df.select(F.explode(F.split(F.col(col), "\n")).alias("name"))
            .select(F.trim("name").alias("name")).where(F.length("name") > 0))
