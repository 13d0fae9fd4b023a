"""Features and sessions that update while conversations are still arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convsignals import schema as S
from convsignals.operators.behavior import SESSION_GAP_MINUTES, _aggregates, with_signal_defaults

# Medians and half-against-half values need the final length, so they are batch features.
RUNNING_FEATURES = [
    name
    for group, names in S.FEATURE_GROUPS.items()
    if group not in ("half_signals", "half_structure")
    for name in names
    if not name.startswith("median_")
]


def running_features(messages: DataFrame, names: list[str] = RUNNING_FEATURES) -> DataFrame:
    """Features of each conversation so far. Works on a stream (update or complete mode) and in batch.

    All of them are algebraic aggregates, so the state per conversation is one row. Without an event time
    nothing says that a conversation has ended, so its row stays in the state.
    """
    aggregates = _aggregates(F.lit(0))
    return (
        with_signal_defaults(messages)
        .groupBy("conversation_id")
        .agg(*[aggregates[n].alias(n) for n in names])
    )


def _named(time: str) -> Column:
    """Whether a row has a conversation. The event time is part of the one condition, so that it stays behind the watermark:
    a closing row without a conversation moves that and does nothing else."""
    return F.col("conversation_id").isNotNull() == (F.col(time) > F.timestamp_seconds(F.lit(-62_000_000_000)))


def ended_features(
    messages: DataFrame, time: str = "ts", idle: str = "1 day", late: str = "1 hour", names: list[str] = RUNNING_FEATURES
) -> DataFrame:
    """Features of conversations that have ended: no message for ``idle`` before the watermark, ``late`` behind the newest message.

    In append mode each conversation leaves the state with its one result; messages that come after that begin
    a new row, and messages behind the watermark are dropped (``late_rows`` keeps them). Rows without a time are left out.
    """
    aggregates = _aggregates(F.lit(0))
    return (
        with_signal_defaults(messages.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()))
        .withWatermark(time, late)
        .where(_named(time))
        .groupBy("conversation_id", F.session_window(time, idle).alias("w"))
        .agg(*[aggregates[n].alias(n) for n in names], F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
        .select("conversation_id", "first_ts", "last_ts", *names)
    )


def session_gap(gap: str | None = None) -> str:
    """A session window also merges a gap equal to its length, so one of 60 minutes 59.999999 seconds equals the batch rule on
    whole-minute delays over 60."""
    return gap or f"{SESSION_GAP_MINUTES} minutes 59.999999 seconds"


def stream_sessions(messages: DataFrame, time: str = "ts", late: str = "1 hour", gap: str | None = None) -> DataFrame:
    """Sessions per conversation. In append mode a session is given out once, when the watermark has passed its end, and
    leaves the state; rows whose own session would have ended before the watermark are dropped (``late_rows`` keeps them)."""
    return (
        messages.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .where(_named(time))
        .groupBy("conversation_id", F.session_window(time, session_gap(gap)).alias("w"))
        .agg(F.count(F.lit(1)).alias("messages"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
        .select("conversation_id", "messages", "first_ts", "last_ts")
    )


def _has(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def appended_table(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for append mode: one directory per batch, which a replay of the batch replaces."""

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def late_rows(path: str, time: str = "ts", late: str = "1 hour", gap: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that keeps the rows which ``stream_sessions`` drops, under ``{path}/late``.

    The watermark of a batch follows from the newest time of the batches before it, one stored row each under ``{path}/clock``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if _has(spark, f"{path}/clock"):
            clock = spark.read.parquet(f"{path}/clock").where(F.col("batch_id") < batch_id)
            newest = clock.agg(F.max("newest")).first()[0]
        rows = batch.withColumn(time, F.col(time).cast("timestamp"))
        ends = F.col(time) + F.expr(f"INTERVAL {session_gap(gap)}")
        mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        behind = rows.where(F.lit(newest is not None) & (ends <= mark))
        behind.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        rows.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{path}/clock/batch_id={batch_id}")

    return write


def run_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a ``foreachBatch`` body over all rows that are there, in append mode."""
    return (
        rows.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def latest_table(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for complete results; ``read_latest`` reads the newest. The version before it stays for readers that
    have begun, older ones are deleted."""

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        spark = result.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            if name.startswith("version=") and int(name.split("=")[1]) < batch_id - 1:
                fs.delete(entry.getPath(), True)

    return write


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result. An earlier version is an older state of the same rows, never to be added up."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def run_to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return (
        result.writeStream.outputMode(mode)
        .foreachBatch(latest_table(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
