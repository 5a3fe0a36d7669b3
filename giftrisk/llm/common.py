"""Helpers shared by the training-data operators: word splitting, scratch tables
in the shared folder, and the query registry."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from giftrisk.session import ensure_checkpoint_dir

#: Words are runs of anything but ASCII blanks. ``bytes.split()`` splits UTF-8
#: text at exactly these six bytes, so Python tasks use it.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/llm/{name}-{uuid.uuid4().hex[:10]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (``spark.checkpoint.dir``) and
    read it back: the lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove a scratch table made by ``stage`` that nothing reads any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> list:
    """The texts of a batch as UTF-8 bytes (None for null)."""
    return batch.column(column).cast(pa.binary()).to_pylist()
