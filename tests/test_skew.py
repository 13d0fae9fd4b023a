"""One user holds most of the rows: block-wise results equal plain windows over whole keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from convsignals.operators.behavior import session_numbers
from convsignals.operators.blocks import with_key_size
from convsignals.sources.tables import timed_messages


def hot_events(spark):
    rows = spark.range(900)
    user = F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id") % 11)
    seconds = 1_700_000_000 + F.col("id") * 37 + F.when(F.col("id") % 50 == 0, 9000).otherwise(0)
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "purchase", "error", "signup")])
    return rows.select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("ts"),
        user.cast("long").alias("user_id"),
        F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        F.lit("{}").alias("props"),
    )


def test_blocks_equal_plain_windows(spark):
    events = hot_events(spark)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    plain = events.select(
        "event_id",
        (F.row_number().over(w) - 1).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"),
        F.coalesce(F.floor((micros - F.lag(micros).over(w)) / 60_000_000), F.lit(0)).alias("delay"),
    )
    expected = {r["event_id"]: (r["pos"], r["n"], r["delay"]) for r in plain.collect()}
    for seconds in (60, 3600, 10**9):
        got = timed_messages(events, seconds)
        assert {r["event_id"]: (r["pos"], r["n"], r["response_delay_minutes"]) for r in got.collect()} == expected
    timed = timed_messages(events, 600)
    whole = {r["event_id"]: r["session"] for r in session_numbers(timed, 10**9).collect()}
    assert {r["event_id"]: r["session"] for r in session_numbers(timed, 5).collect()} == whole
    sized = with_key_size(timed.drop("n"), "conversation_id", block_size=16)
    assert all(r["n"] == expected[r["event_id"]][1] for r in sized.collect())


def test_null_keys_keep_their_rows(spark):
    rows = spark.range(100).selectExpr(
        "id AS event_id",
        "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 3 END AS user_id",
        "timestamp_seconds(1700000000 + id * 1800) AS ts",
        "'click' AS event_type",
        "'{}' AS props",
    )
    timed = timed_messages(rows)
    assert timed.count() == 100
    assert timed.where("conversation_id IS NULL").selectExpr("max(pos)", "max(n)").first()[:] == (9, 10)
    assert session_numbers(timed).where("conversation_id IS NULL").count() == 10
