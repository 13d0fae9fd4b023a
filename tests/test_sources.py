import json

import pytest
from pyspark.sql import functions as F
from test_corpus import conversation

from convsignals import schema as S
from convsignals.sources import corpus as cp
from convsignals.sources import sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines_skip_blanks_and_stop_on_bad_lines(spark, tmp_path):
    good = json.dumps(conversation(), ensure_ascii=False)
    path = write(tmp_path / "a.jsonl", good + "\n\n" + good + "\n")
    assert cp.read_corpus(spark, path).count() == 2
    bad = write(tmp_path / "b.jsonl", good + "\n{broken\n")
    with pytest.raises(Exception):
        cp.read_corpus(spark, bad).collect()
    rows, rejects = cp.read_json_lines_with_rejects(spark, bad)
    assert rows.count() == 1
    assert [r["line"] for r in rejects.collect()] == ["{broken"]


@pytest.mark.parametrize("wrap", ["list", "single", "data", "records", "conversations", "items"])
def test_json_shapes(spark, tmp_path, wrap):
    rows = [conversation(), conversation(conversation_id="he_sales_000002")]
    body = {"list": rows, "single": rows[0]}.get(wrap, {wrap: rows})
    path = write(tmp_path / "a.json", json.dumps(body, ensure_ascii=False))
    got = cp.read_corpus(spark, path)
    assert got.count() == (1 if wrap == "single" else 2)
    assert got.first()["messages"][0]["behavioral_features"]["emoji_count"] == 0


def test_strict_array_and_formats(spark, tmp_path):
    array = write(tmp_path / "a.json", json.dumps([conversation()], ensure_ascii=False))
    assert cp.read_json_array(spark, array).count() == 1
    with pytest.raises(S.DataError):
        cp.read_json_array(spark, write(tmp_path / "b.json", json.dumps({"data": []})))
    with pytest.raises(S.DataError):
        cp.read_corpus(spark, "x.xml")
    with pytest.raises(S.DataError):
        cp.require_rows(cp.read_corpus(spark, write(tmp_path / "c.jsonl", "\n")), "c.jsonl")


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,text,label\n1,"שלום, ""עולם""",x\n2,b,y\n')
    got = cp.read_corpus(spark, path, schema=S.FLAT_TEXT_SCHEMA).orderBy("id").collect()
    assert (got[0]["text"], got[1]["label"]) == ('שלום, "עולם"', "y")


def test_prefix_prediction_files(spark, tmp_path):
    header = ",".join(S.PREDICTION_SCHEMA.fieldNames())
    for tag in ("025pct", "100pct"):
        write(tmp_path / f"predictions_{tag}.csv", f"{header}\nc1,interested,interested,0.9,0.1,1\n")
    write(tmp_path / "other.csv", "x\n1\n")
    got = cp.read_prefix_predictions(spark, str(tmp_path))
    assert sorted(r["fraction"] for r in got.collect()) == [0.25, 1.0]


def test_predictions_round_trip_reads_one_partition(spark, tmp_path):
    rows = spark.createDataFrame(
        [("A", 0.25, "c1", 0.1234567), ("B", 1.0, "c1", 0.5)],
        "model string, fraction double, conversation_id string, probability_interested double",
    )
    sinks.write_predictions(rows, str(tmp_path / "p"))
    got = sinks.read_predictions(spark, str(tmp_path / "p"), "A")
    assert [(r["probability_interested"], r["fraction"]) for r in got.collect()] == [(0.123457, 0.25)]
    assert len(got.inputFiles()) == 1 or "PartitionFilters: [isnotnull(model" in plan(got)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_split_corpus_and_rejections(spark, tmp_path):
    split = spark.createDataFrame([("c1", "a", "train"), ("c2", "b", "test")], "conversation_id string, label string, split string")
    sinks.write_split(split, str(tmp_path / "s"))
    assert {tuple(r) for r in sinks.read_split(spark, str(tmp_path / "s")).select(*split.columns).collect()} == {tuple(r) for r in split.collect()}
    assert spark.read.parquet(str(tmp_path / "s/counts")).count() == 2
    one = spark.createDataFrame([conversation()], S.CONVERSATION_SCHEMA)
    both = sinks.combined_corpus(one, one.select(*reversed(one.columns)))
    sinks.write_corpus(both, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 2 and back.columns == S.CONVERSATION_SCHEMA.fieldNames()
    rejected = spark.createDataFrame([("r1", "x" * 900)], "id string, raw string")
    for _ in range(2):
        sinks.append_rejections(rejected, str(tmp_path / "r"))
    log = spark.read.parquet(str(tmp_path / "r"))
    assert log.count() == 2 and log.select(F.max(F.length("raw"))).first()[0] == 500
    sinks.write_statistics(str(tmp_path / "t"), bootstrap=split, errors=split)
    sinks.write_metrics(split, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "t/errors")).count() == spark.read.parquet(str(tmp_path / "m")).count() == 2
