import statistics

import pytest
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.operators import behavior as bh
from convsignals.operators import conversation as cv

COLUMNS = "conversation_id string, pos int, role string, response_delay_minutes int, message_length_chars int, question_count int, contains_commitment boolean, contains_price boolean"


def make(spark, *conversations):
    rows = []
    for cid, messages in conversations:
        for pos, m in enumerate(messages):
            rows.append(
                (cid, pos, m.get("role", "customer"), m.get("delay"), m.get("len"), m.get("q", 0), m.get("com", False), m.get("price", False))
            )
    return spark.createDataFrame(rows, COLUMNS)


def features(df, names=S.FEATURES):
    return {r["conversation_id"]: r.asDict() for r in bh.behavioral_features(df, names).collect()}


def test_names():
    assert (len(S.FEATURES), len(S.LEXICAL_FEATURES), len(S.PURE_FEATURES)) == (51, 25, 26)
    assert len(set(S.FEATURES)) == 51
    assert "last_role_is_customer" in S.PURE_FEATURES


def test_counts_lengths_and_delays(spark):
    customer = [{"delay": 30, "len": 20 + i, "q": int(i == 0)} for i in range(3)]
    business = [{"role": "business", "delay": 15, "len": 99} for _ in range(2)]
    f = features(make(spark, ("a", customer + business)))["a"]
    assert (f["total_messages"], f["customer_messages"], f["business_messages"]) == (5, 3, 2)
    assert f["ratio_customer_to_business"] == pytest.approx(1.5)
    assert f["mean_customer_msg_length"] == pytest.approx(21)
    assert f["median_customer_msg_length"] == 21
    assert f["std_customer_msg_length"] == pytest.approx(statistics.stdev([20, 21, 22]))
    assert (f["min_customer_msg_length"], f["max_customer_msg_length"], f["total_customer_chars"]) == (20, 22, 63)
    assert f["question_rate"] == pytest.approx(1 / 3)
    assert (f["mean_response_delay_customer"], f["mean_response_delay_business"]) == (30, 15)
    assert f["last_response_delay"] == 15
    assert f["last_role_is_customer"] == 0
    # Halves: positions 0-1 and 2-4.
    assert (f["first_half_customer_message_count"], f["second_half_customer_message_count"]) == (2, 1)
    assert f["customer_length_change"] == pytest.approx(22 - 20.5)
    assert f["response_delay_change"] == pytest.approx(20 - 30)


def test_sessions_need_more_than_an_hour(spark):
    delays = [500, 60, 61, 10]
    f = features(make(spark, ("a", [{"delay": d, "len": 1} for d in delays])))["a"]
    # The delay of the first message never counts.
    assert (f["session_count"], f["max_session_gap_minutes"]) == (2, 61)
    numbered = bh.session_numbers(make(spark, ("a", [{"delay": d, "len": 1} for d in delays])), block_size=2)
    assert [r["session"] for r in numbered.orderBy("pos").collect()] == [1, 1, 2, 2]


def test_half_signals_and_ending(spark):
    messages = [
        {"delay": 0, "len": 5, "com": True},
        {"delay": 1, "len": 5, "role": "business"},
        {"delay": 1, "len": 5, "price": True},
        {"delay": 1, "len": 5, "com": True, "q": 2},
    ]
    f = features(make(spark, ("a", messages)))["a"]
    assert (f["first_half_commitment_count"], f["commitment_in_second_half"], f["price_in_second_half"]) == (1, 1, 1)
    assert (f["last_role_is_customer"], f["last_customer_has_commitment"], f["last_customer_has_question"]) == (1, 1, 1)
    assert f["last_customer_has_price"] == 0
    assert f["total_customer_bool_signals"] == 3


def test_edge_cases_are_zero_not_null(spark):
    df = make(
        spark,
        ("one", [{"delay": None, "len": None}]),
        ("business", [{"role": "business", "delay": 7, "len": 3}] * 2),
    )
    got = features(df)
    for f in got.values():
        assert all(v is not None for v in f.values())
    assert got["one"]["std_customer_msg_length"] == 0
    # One message belongs to the second half.
    assert (got["one"]["first_half_customer_message_count"], got["one"]["second_half_customer_message_count"]) == (0, 1)
    assert got["business"]["customer_messages"] == 0
    assert got["business"]["ratio_customer_to_business"] == 0
    assert got["business"]["min_customer_msg_length"] == 0


def test_signals_absent_from_the_table_count_as_zero(spark):
    df = make(spark, ("a", [{"delay": 1, "len": 4}])).select("conversation_id", "pos", "role", "message_length_chars")
    f = features(df)["a"]
    assert f["total_customer_emojis"] == 0 and f["mean_customer_msg_length"] == 4


def test_nested_corpus_gives_the_same_features(spark):
    message = ", ".join(
        f"named_struct('role', '{r}', 'text', '{t}', 'response_delay_minutes', {d}, 'interest_label', null, 'interest_score', null, "
        f"'timestamp', null, 'message_index', {i}, 'behavioral_features', named_struct('message_length_chars', {len(t)}, 'question_count', 0, "
        "'emoji_count', 0, 'contains_price', false, 'contains_negotiation', false, 'contains_objection', false, 'contains_commitment', false, "
        "'contains_delay_signal', false))"
        for i, (r, t, d) in enumerate([("customer", "abc", 0), ("business", "de", 70), ("customer", "fghij", 5)])
    )
    corpus = spark.sql(f"SELECT 'a' AS conversation_id, array({message}) AS messages")
    f = bh.corpus_features(corpus).first()
    assert (f["total_messages"], f["session_count"], f["total_customer_chars"]) == (3, 2, 8)


def test_feature_rows_fill_zeros(spark):
    df = make(spark, ("a", [{"delay": 1, "len": 4}]))
    ids = spark.createDataFrame([("b",), ("a",)], "conversation_id string")
    got = {r["conversation_id"]: r["total_messages"] for r in bh.feature_rows(ids, bh.behavioral_features(df)).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_leakage_guard(spark):
    S.assert_no_leakage(spark.createDataFrame([(1.0,)], "x double"))
    with pytest.raises(S.DataError):
        S.assert_no_leakage(spark.createDataFrame([(1.0, "a")], "x double, final_outcome string"))


def test_future_messages_never_reach_prefix_features(spark):
    base = [{"delay": 10 + i, "len": 20 + i, "role": "customer" if i % 2 == 0 else "business"} for i in range(9)]
    changed = [dict(m) for m in base]
    for i in range(5, 9):
        changed[i].update(delay=9999, len=5000, role="customer", com=True)
    got = []
    for messages in (base, changed):
        rows = bh.prefix_features(make(spark, ("a", messages)), [0.5, 1.0], S.FEATURES)
        got.append({r["fraction"]: r.asDict() for r in rows.collect()})
    assert got[0][0.5] == got[1][0.5]
    assert got[0][1.0] != got[1][1.0]
    assert got[0][0.5]["total_messages"] == 5


def test_full_prefix_equals_whole_conversation(spark):
    df = make(spark, ("a", [{"delay": i, "len": i * 3} for i in range(7)]), ("b", [{"delay": 3, "len": 1}]))
    whole = {r["conversation_id"]: r.asDict() for r in bh.behavioral_features(df).collect()}
    full = {r["conversation_id"]: r.asDict() for r in bh.prefix_features(df, [1.0], S.FEATURES).drop("fraction").collect()}
    assert whole == full


def test_prefix_lengths(spark):
    cases = [(12, 0.25, 3), (9, 0.5, 5), (9, 0.75, 7), (1, 0.25, 1), (3, 0.25, 1), (9, 1.0, 9)]
    rows = spark.createDataFrame([(n, f, e) for n, f, e in cases], "n int, f double, e int")
    assert all(r["e"] == r["k"] for r in rows.withColumn("k", cv.prefix_length(F.col("n"), F.col("f"))).collect())
    grid = spark.range(1, 50).select(F.col("id").cast("int").alias("n"), F.explode(F.array(*[F.lit(f) for f in S.FRACTIONS])).alias("f"))
    sizes = grid.withColumn("k", cv.prefix_length(F.col("n"), F.col("f"))).groupBy("n").agg(F.sort_array(F.collect_list(F.struct("f", "k"))).alias("x"))
    for r in sizes.collect():
        ks = [x["k"] for x in r["x"]]
        assert ks == sorted(ks) and ks[-1] == r["n"] and ks[0] >= 1


def test_prefix_text(spark):
    rows = [("a", 0, "business", "hello"), ("a", 1, "customer", "one"), ("a", 2, "customer", ""), ("a", 3, "customer", "two")]
    df = spark.createDataFrame(rows, "conversation_id string, pos int, role string, text string")
    got = {r["fraction"]: (r["text"], r["n_total"], r["n_customer"]) for r in cv.prefix_text(df).collect()}
    assert got == {0.25: ("", 1, 0), 0.5: ("one", 2, 1), 0.75: ("one", 3, 1), 1.0: ("one [SEP] two", 4, 2)}
    assert cv.conversation_text(df, roles=()).first()["text"] == "hello [SEP] one [SEP] two"
    stats = {r["fraction"]: r for r in cv.prefix_statistics(cv.prefix_text(df)).collect()}
    assert stats[0.25]["pct_zero_customer"] == 100 and stats[1.0]["avg_customer_msgs"] == 2


def test_nested_text_and_prefix(spark):
    df = spark.sql(
        "SELECT array(named_struct('role','customer','text','a'), named_struct('role','business','text','b'), named_struct('role','customer','text','c')) AS m"
    )
    row = df.select(
        cv.nested_text(F.col("m")).alias("t"),
        cv.nested_text(F.col("m"), ()).alias("all"),
        cv.nested_text(cv.nested_prefix(F.col("m"), F.lit(0.5))).alias("p"),
    ).first()
    assert (row["t"], row["all"], row["p"]) == ("a [SEP] c", "a [SEP] b [SEP] c", "a")


def test_dotted_fields(spark):
    df = spark.sql("SELECT named_struct('b', named_struct('c', 5)) AS a")
    row = df.select(cv.field(df, "a.b.c").alias("x"), cv.field(df, "a.z.c").alias("y"), cv.field(df, "q").alias("z")).first()
    assert (row["x"], row["y"], row["z"]) == (5, None, None)
