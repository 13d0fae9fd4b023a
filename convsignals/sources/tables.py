"""Adapters from plain tables to the canonical message, text and prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convsignals.operators.blocks import BLOCK_SECONDS, with_block_totals

EVENT_ROLE = {
    "view": "customer",
    "click": "customer",
    "signup": "customer",
    "purchase": "business",
    "error": "business",
}
EVENT_OUTCOME = {
    "purchase": "converted",
    "signup": "appointment_set",
    "view": "pending",
    "click": "reengaged_pending",
    "error": "ghosted",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to process. One stored in fewer splits than there are cores is
    dealt out to all of them first; a table of many splits is read as it is."""
    rows = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def mapped(column: Column, pairs: dict[str, str], default: Column | None = None) -> Column:
    """A constant lookup inside the projection instead of a join."""
    chain = None
    for raw, value in pairs.items():
        test = column == raw
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain if default is None else chain.otherwise(default)


def turn_messages(conversations: DataFrame) -> DataFrame:
    """Chat turns as messages; roles other than user and assistant are kept as they are."""
    return conversations.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").cast("int").alias("pos"),
        mapped(F.col("role"), {"user": "customer", "assistant": "business"}, F.col("role")).alias("role"),
        F.col("text"),
        F.lit(0).alias("response_delay_minutes"),
    )


def timed_messages(events: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Events of a user as the messages of one conversation, ordered by (ts, event_id).

    Delay is the whole minutes since the previous message, 0 for the first. The position, the size
    and the previous time come from time blocks, so a very active user is never one task.
    """
    rows = events.select(
        F.col("user_id").alias("conversation_id"),
        F.col("event_id"),
        F.col("ts"),
        F.col("event_type"),
        F.col("props").alias("text"),
    ).withColumn("_block", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (block_seconds * 1_000_000)))
    rows = with_block_totals(rows, ["conversation_id"], "_block", {"block_end": F.max("ts")})
    inside = Window.partitionBy("_slot").orderBy("ts", "event_id")
    previous = F.coalesce(F.lag("ts").over(inside), F.col("block_end"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))
    return rows.select(
        "conversation_id",
        (F.col("rows_before") + F.row_number().over(inside) - 1).cast("int").alias("pos"),
        F.col("rows_total").cast("int").alias("n"),
        mapped(F.col("event_type"), EVENT_ROLE).alias("role"),
        "text",
        F.coalesce(F.floor(micros / 60_000_000), F.lit(0)).cast("int").alias("response_delay_minutes"),
        "event_id",
        "ts",
        "event_type",
    )


def event_outcomes(events: DataFrame) -> DataFrame:
    """Raw outcome of each user, taken from the last event; a map-side combined aggregate."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy(F.col("user_id").alias("conversation_id")).agg(
        mapped(last, EVENT_OUTCOME).alias("final_outcome")
    )


def labelled_text(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Flat labelled text; both sides are unique per document."""
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("record_id"),
        F.col("text").alias("raw_text"),
        F.col("quality").cast("string").alias("raw_label"),
        "n_chars",
        "toxic",
        "lang",
        "source",
    )


def rule_predictions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Two fixed rules as models A and B over text prefixes, with the label as truth.

    Model A asks for more than 1000 characters of the prefix, model B for more than 600.
    """
    rows = (
        labels.join(documents.select("doc_id", "n_chars"), "doc_id")
        .withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in (0.25, 0.5, 0.75, 1.0)])))
        .withColumn("size", F.ceil(F.col("n_chars") * F.col("fraction")).cast("long"))
    )
    models = F.explode(
        F.array(
            F.struct(F.lit("A").alias("model"), F.lit(1000.0).alias("cut")),
            F.struct(F.lit("B").alias("model"), F.lit(600.0).alias("cut")),
        )
    )
    rows = rows.select("*", models.alias("m")).select("*", "m.model", "m.cut")
    p = F.col("size") / (F.col("size") + F.col("cut"))
    predicted = F.when(F.col("size") > F.col("cut"), "interested").otherwise("losing_interest")
    actual = F.when(F.col("quality") == 1, "interested").otherwise("losing_interest")
    return rows.select(
        "model",
        F.col("doc_id").alias("conversation_id"),
        "fraction",
        actual.alias("actual_label"),
        predicted.alias("predicted_label"),
        p.alias("probability_interested"),
        (1 - p).alias("probability_losing_interest"),
        (actual == predicted).cast("int").alias("correct"),
    )
