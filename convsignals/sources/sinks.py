"""Table writers and the readers of what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convsignals.schema import in_canonical_order
from convsignals.operators.decode import RAW_CHARS
from convsignals.sources.versions import publish


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Partitioned by model and prefix, so one experiment reads only its own files."""
    rounded = {
        c: F.bround(c, 6) for c in predictions.columns if c.startswith("probability_")
    }
    predictions.withColumns(rounded).write.mode("overwrite").partitionBy("model", "fraction").parquet(path)


def read_predictions(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("model") == model) if model else rows


def write_split(split: DataFrame, path: str) -> None:
    """The assignment, partitioned by split, and its counts."""
    split.write.mode("overwrite").partitionBy("split").parquet(f"{path}/ids")
    read_split(split.sparkSession, path).groupBy("split").count().coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/counts")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ids")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric rows; small, hence one file."""
    metrics.coalesce(1).write.mode("overwrite").parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Canonical field order. Overwriting deletes the old table before the new one is committed; ``versions.publish``
    replaces a table that others read."""
    in_canonical_order(corpus).write.mode("overwrite").parquet(path)


def combined_corpus(source: DataFrame, generated: DataFrame) -> DataFrame:
    """Source rows and new rows, in the canonical schema."""
    return in_canonical_order(source).unionByName(in_canonical_order(generated))


def append_rejections(rejected: DataFrame, path: str, raw: str = "raw") -> None:
    """Append to the rejection table; raw text is cut to the length a log row keeps."""
    rejected.withColumn(raw, F.substring(raw, 1, RAW_CHARS)).write.mode("append").parquet(path)


def write_statistics(path: str, **tables: DataFrame) -> None:
    """One table per result (bootstrap, tests, errors), each keyed by fraction."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def publish_corpus(corpus: DataFrame, path: str) -> int:
    """The next version of a corpus in canonical field order; see ``versions.publish``."""
    return publish(in_canonical_order(corpus), path)
