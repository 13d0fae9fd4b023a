import uuid

import pytest
from pyspark.sql import functions as F

from convsignals.operators.behavior import behavioral_features
from convsignals.plans.catalog import streams
from convsignals.streaming import intake, running

SCHEMA = "row_id long, conversation_id long, pos int, role string, text string"


def file_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(df, folder, number):
    """One file per call, so that files arrive in order."""
    df.coalesce(1).write.mode("append").parquet(folder)


def test_intake_accepts_rejects_and_survives_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = [
        (1, 1, 0, "customer", "אני מחפש ספה פינתית לסלון"),
        (2, 1, 1, "business", "אני מחפש ספה פינתית לסלון"),
        (3, 1, 2, "bot", "x"),
        (4, 1, 3, "customer", "  "),
        (5, 1, 4, "customer", "כן"),
    ]
    second = [
        (6, 2, 0, "customer", "אני מחפש ספה פינתית לסלון!"),
        (7, 2, 1, "business", "אני מחפש ספה פינתית לסלון שלי"),
        (8, 2, 2, "customer", "כן"),
        (9, 2, 3, "customer", "משהו אחר לגמרי ומקורי"),
    ]
    put(spark.createDataFrame(first, SCHEMA), source, 1)
    intake.start_intake(file_stream(spark, source, SCHEMA), out, checkpoint).awaitTermination()
    put(spark.createDataFrame(second, SCHEMA), source, 2)
    # A new query on the same checkpoint continues with the second file only.
    intake.start_intake(file_stream(spark, source, SCHEMA), out, checkpoint).awaitTermination()
    got = {r["row_id"]: r["issue"] for r in intake.read_decisions(spark, out).collect()}
    assert got == {
        1: None,
        2: "repeated_in_conversation",
        3: "invalid_role",
        4: "empty_text",
        5: None,
        6: "exact_duplicate",
        7: "fuzzy_duplicate",
        8: None,
        9: None,
    }
    # Replaying a batch overwrites its own directory and nothing else.
    intake.batch_writer(out)(spark.createDataFrame(second, SCHEMA), 1)
    again = {r["row_id"]: r["issue"] for r in intake.read_decisions(spark, out).collect()}
    assert again == got


def test_intake_tells_rows_apart_by_row_id(spark):
    ids = "row_id long, conversation_id string, pos int, role string, text string"
    rows = [
        (1, "he_sales_000001", 0, "customer", "a first text about a corner sofa for the living room"),
        (2, "he_sales_000002", 0, "customer", "a wholly different question on delivery times"),
        (3, "he_sales_000002", 0, "customer", "a first text about a corner sofa for the living rooms"),
        (4, "he_sales_000003", 1, "customer", "a wholly different question on delivery times"),
    ]
    index = spark.createDataFrame([], intake.INDEX_SCHEMA)
    got = {r["row_id"]: (r["issue"], r["match"]) for r in intake.judge_batch(spark.createDataFrame(rows, ids), index).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: ("fuzzy_in_batch", "1"), 4: ("duplicate_in_batch", "2")}


def test_intake_compares_with_accepted_rows_only(spark):
    """In a chain A ~ B ~ C without A ~ C, B goes and C stays; copies follow their speaker."""
    a = "we would like to order forty chairs for the office"
    b = a + " by june"
    c = b + " or july"
    ids = "row_id long, conversation_id string, pos int, role string, text string"
    rows = [(i, f"c{i}", 0, "customer", t) for i, t in enumerate([a, b, c, b, c], 1)]
    index = spark.createDataFrame([], intake.INDEX_SCHEMA)
    got = {r["row_id"]: (r["issue"], r["match"]) for r in intake.judge_batch(spark.createDataFrame(rows, ids), index, 91.0).collect()}
    assert got == {
        1: (None, None),
        2: ("fuzzy_in_batch", "1"),
        3: (None, None),
        4: ("fuzzy_in_batch", "1"),
        5: ("duplicate_in_batch", "3"),
    }


def test_running_features_equal_batch(spark, tmp_path):
    rows = spark.range(60).select(
        (F.col("id") % 4).alias("conversation_id"),
        F.floor(F.col("id") / 4).cast("int").alias("pos"),
        F.when(F.col("id") % 3 == 0, "business").otherwise("customer").alias("role"),
        (F.col("id") * 7 % 90).cast("int").alias("response_delay_minutes"),
        (F.col("id") * 5 % 41).cast("int").alias("message_length_chars"),
    )
    folder = str(tmp_path / "in")
    rows.repartition(3).write.parquet(folder)
    stream = file_stream(spark, folder, rows.schema)
    running.run_to_table(running.running_features(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = running.read_latest(spark, str(tmp_path / "out"))
    names = running.RUNNING_FEATURES
    got = {r["conversation_id"]: [r[n] for n in names] for r in last.collect()}
    want = {r["conversation_id"]: [r[n] for n in names] for r in behavioral_features(rows, names).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k])


def test_stream_sessions(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "2025-01-01 10:00:00"), (1, "2025-01-01 11:00:00"), (1, "2025-01-01 12:00:59"), (1, "2025-01-01 13:01:59"), (2, "2025-01-01 10:00:00")],
        "conversation_id long, t string",
    ).select("conversation_id", F.to_timestamp("t").alias("ts"))
    folder = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(folder)
    result = running.stream_sessions(file_stream(spark, folder, rows.schema))
    running.run_to_table(result, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("conversation_id").count().collect()
    # Gaps of 60:00 and 60:59 stay in one session, 61:00 starts another.
    assert {r["conversation_id"]: r["count"] for r in got} == {1: 2, 2: 1}


def test_ended_conversations_leave_the_state(spark, tmp_path):
    """Three deliveries; each conversation is given out once, and the state is empty after a closing row."""
    def at(minute):
        return f"2025-01-01 {10 + minute // 60:02d}:{minute % 60:02d}:00"

    schema = "conversation_id long, pos int, role string, t string, message_length_chars int, response_delay_minutes int"
    deliveries = [
        [(1, 0, "customer", at(0), 10, 0), (2, 0, "customer", at(5), 7, 0)],
        [(1, 1, "business", at(20), 30, 20), (1, 2, "customer", at(30), 20, 10)],
        # Much later; the watermark has not moved there yet, so conversation 2 still takes a row.
        [(3, 0, "customer", at(600), 5, 0), (2, 1, "customer", at(6), 99, 1)],
        # A batch works with the watermark of the one before it.
        [(None, None, None, "2026-01-01 00:00:00", None, None)],
        [(None, None, None, "2026-01-01 00:00:00", None, None)],
    ]
    folder, out, late = (str(tmp_path / n) for n in ("in", "out", "late"))
    rows, names = None, ["total_messages", "customer_messages", "total_customer_chars", "max_response_delay_customer"]
    left, dropped = [], 0
    for part in deliveries:
        frame = spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("t")).drop("t")
        frame.coalesce(1).write.mode("append").parquet(folder)
        rows = file_stream(spark, folder, frame.schema)
        result = running.ended_features(rows, idle="2 hours", late="10 minutes", names=names)
        query = running.run_batches(result, running.appended_table(out), str(tmp_path / "cp"))
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        dropped += sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)
        running.run_batches(rows, running.late_rows(late, late="10 minutes", gap="2 hours"), str(tmp_path / "lp")).awaitTermination()
    got = {r["conversation_id"]: tuple(r[n] for n in names) for r in running.read_appended(spark, out).collect()}
    assert got == {1: (3, 2, 30, 10), 2: (2, 2, 106, 1), 3: (1, 1, 5, 0)}
    assert left[-1] == 0 and max(left) > 0
    assert running.read_appended(spark, out).count() == 3
    assert [(r["conversation_id"], r["pos"]) for r in spark.read.parquet(f"{late}/late").collect()] == []
    assert dropped == 0


def test_late_rows_are_kept_aside(spark, tmp_path):
    def rows(*items):
        frame = spark.createDataFrame(list(items), "conversation_id long, t string")
        return frame.select("conversation_id", F.to_timestamp("t").alias("ts"))

    folder, out, late = (str(tmp_path / n) for n in ("in", "out", "late"))
    dropped = 0
    for part in (
        rows((1, "2025-01-01 10:00:00"), (2, "2025-01-01 20:00:00")),
        rows((1, "2025-01-01 10:10:00"), (2, "2025-01-01 20:10:00"), (3, "2025-01-01 19:00:00")),
        rows((None, "2025-02-01 00:00:00")),
        rows((None, "2025-02-01 00:00:00")),
    ):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, part.schema)
        query = running.run_batches(running.stream_sessions(stream), running.appended_table(out), str(tmp_path / "cp"))
        query.awaitTermination()
        dropped += sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)
        running.run_batches(stream, running.late_rows(late), str(tmp_path / "lp")).awaitTermination()
    got = sorted((r["conversation_id"], r["messages"]) for r in running.read_appended(spark, out).collect())
    assert got == [(1, 1), (2, 2), (3, 1)]
    aside = [(r["conversation_id"], str(r["ts"])) for r in spark.read.parquet(f"{late}/late").collect()]
    assert aside == [(1, "2025-01-01 10:10:00")] and dropped == len(aside)
    # Replaying a batch replaces its own directory only.
    running.appended_table(out)(spark.createDataFrame([], "conversation_id long, messages long, first_ts timestamp, last_ts timestamp"), 0)


def test_stream_copies(spark, tmp_path):
    rows = spark.createDataFrame([("same text",), ("same  text.",), ("other",)], "text string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    folder = str(tmp_path / "in")
    rows.repartition(3).write.parquet(folder)
    name = f"copies_{uuid.uuid4().hex}"
    stream = intake.drop_stream_copies(file_stream(spark, folder, rows.schema), "ts").select("norm")
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["norm"] for r in spark.table(name).collect()) == ["other", "same text"]


def test_plans_of_a_batch_stay_small(spark, monkeypatch):
    rows = [(k, k, 0, "customer", f"a message of some length number {k}") for k in range(4)]
    batch = spark.createDataFrame(rows, "row_id long, conversation_id long, pos int, role string, text string")
    index = spark.createDataFrame([], intake.INDEX_SCHEMA)
    plans, kept = [], intake.stored

    def watched(df):
        plans.append(len(df._jdf.queryExecution().toString()))
        return kept(df)

    monkeypatch.setattr(intake, "stored", watched)
    plans.append(len(intake.judge_batch(batch, index)._jdf.queryExecution().toString()))
    assert max(plans) < 100_000, plans


def test_turns_beyond_a_thousand_are_told_apart(spark, tmp_path):
    """Turn 3000 of conversation 0 and turn 0 of conversation 3 have one number and come in one batch; one's reason became the other's."""
    near = "where is the large red parcel that was sent on monday morning"
    rows = [(0, 0, "user", near), (0, 3000, "user", near + " x"), (3, 0, "user", "an entirely different question about nothing like it")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in streams.incremental_accept(spark, str(tmp_path)).collect())
    assert got == [(0, "accepted"), (3000, "accepted"), (3000, "fuzzy_in_batch")]
