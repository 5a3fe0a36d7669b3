"""Session helpers: a tuned SparkSession and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # wide generated projections (49 rule terms + features) exceed HotSpot's
    # 8 KB JIT limit and would run interpreted; allow JIT of huge methods
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (not needed in local mode,
    or where it is installed or given by --py-files)."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="giftrisk-py-"), "giftrisk.zip")  # read by the driver alone
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("giftrisk", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "giftrisk", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (tests,
    local runs) create a private scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="giftrisk-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def write_stage(df: DataFrame, name: str, paths: dict | None = None, plain: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back;
    ``paths`` gets the folder. The columns ``plain`` have no dictionary: where nearly all
    values differ, it only costs time, on every read as well."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/stages/{name}-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain or []}).parquet(path)
    if paths is not None:
        paths[name] = path
    return spark.read.parquet(path)


def cluster_conf(input_bytes: int, partition_bytes: int = 256 << 20, max_partitions: int = 200_000) -> dict:
    """Settings for a cluster run over ``input_bytes`` of Parquet.

    * scans split at ``partition_bytes`` (256 MB) so a task's input fits an
      executor core's memory share with room for decompression;
    * the initial shuffle partition count gives ~``partition_bytes`` per
      partition for a shuffle as large as the input, and AQE coalesces small
      ones at run time to the same advisory size (fewer, fuller tasks);
    * skew joins split partitions 5x the median and over 1 GB;
    * broadcasts stay at the 64 MB runtime threshold: only the bounded tables
      (dimensions, per-group totals, list grams) are hinted, everything else is
      left to AQE's runtime size check;
    * executors JIT the large generated rule / feature projections.
    """
    n = max(1, min(max_partitions, -(-input_bytes // partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
