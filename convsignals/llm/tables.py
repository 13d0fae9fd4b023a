"""Stored intermediates: their shuffle files go as soon as a table is written, a table goes after its last reader."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from convsignals.session import checkpoint_dir, stored

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Spark deletes the shuffle files of a query at its end; a lost table would be computed anew from its input."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def released(df: DataFrame) -> DataFrame:
    """``stored``, with the shuffle files of the query deleted afterwards."""
    with shuffle_cleanup(df.sparkSession):
        return stored(df)


class Scratch:
    """Stored tables of one job. ``drop`` deletes those that no later step reads; the end of the block deletes the rest.

    A result that outlives the block is written with ``released`` before it ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.drop(*[table for table, _ in self.tables])

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/scratch-{uuid.uuid4().hex}"
        with shuffle_cleanup(self.spark):
            df.write.parquet(path)
        table = self.spark.read.parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for _, path in [t for t in self.tables if t[0] is table]:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.tables = [t for t in self.tables if not any(t[0] is table for table in tables)]
