"""Spark session settings shared by tests, the bench and local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Aggregates with medians keep hashing beyond the default of 128 groups before they sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, app: str = "convsignals", **overrides: str) -> SparkSession:
    """A single-JVM session; on a cluster the submitter's own settings apply instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        # Small test data would otherwise be merged into one task per stage.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.memory": "12g",
        **overrides,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a scratch one only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared checkpoint folder and read it back.

    For results that several later passes use: they survive lost executors, and the reader knows
    their size when it plans joins.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt_tasks(spark: SparkSession) -> int:
    """Tasks for groups that compute far more than they read; adaptive merging by bytes would leave them to one or two tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
