import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convsignals.schema import DataError
from convsignals.sources import lines as ln
from convsignals.sources import versions as vs

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def write(folder):
    folder.mkdir()
    first = ["", '{"id": 1, "t": "שלום"}', "{broken", "  ", '{"t": "no id"}', '{"id": 1, "t": "again"}']
    second = ['{"t": "x"}' if i % 3 else "{bad é" for i in range(400)]
    (folder / "a.jsonl").write_bytes("\n".join(first).encode() + b"\n")
    (folder / "b.jsonl").write_bytes("\n".join(second).encode())
    return {"a.jsonl": first, "b.jsonl": second}


def expected(files):
    places, record = [], 0
    for name, lines in sorted(files.items()):
        at = 0
        for i, line in enumerate(lines):
            blank = not line.strip()
            places.append((name, i, at, None if blank else record, line))
            record += not blank
            at += len(line.encode()) + 1
    return places


@pytest.mark.parametrize("split", ["128m", "512", "64"])
def test_places_do_not_depend_on_splits(spark, tmp_path, split):
    files = write(tmp_path / "in")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = ln.placed_lines(spark, str(tmp_path / "in")).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
        assert sorted(map(tuple, got.collect())) == sorted(expected(files))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_report_and_record_ids(spark, tmp_path):
    files = write(tmp_path / "in")
    report = ln.read_json_lines_report(spark, str(tmp_path / "in"), SCHEMA)
    bad = {(r["file"].rsplit("/", 1)[1], r["line"], r["offset"]) for r in report.bad.collect()}
    whole = expected(files)
    assert bad == {(f, i, at) for f, i, at, r, line in whole if r is not None and (line.startswith("{b"))}
    counts = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in report.counts.collect()}
    assert counts == {"a.jsonl": (3, 1, 2), "b.jsonl": (266, 134, 0)}
    named, errors = ln.with_record_ids(report.rows, "id")
    ids = {r["record"]: r["record_id"] for r in named.collect()}
    for _, _, _, record, line in whole:
        if record in ids:
            known = json.loads(line).get("id")
            assert ids[record] == (f"row_{record}" if known is None else str(known))
    assert [tuple(r) for r in errors.collect()] == [("1", 2, 0, 3)]


def test_empty_folder_has_no_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b"")
    report = ln.read_json_lines_report(spark, str(tmp_path / "in"), SCHEMA)
    assert report.rows.count() == report.bad.count() == 0


def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(DataError):
        vs.read_published(spark, path)
    assert vs.publish(spark.range(5).toDF("x"), path) == 1
    one = vs.read_published(spark, path)
    # The next version is computed from the one that is read.
    assert vs.publish(one.select((F.col("x") + 10).alias("x")), path) == 2
    assert sorted(r["x"] for r in vs.read_published(spark, path).collect()) == [10, 11, 12, 13, 14]
    assert sorted(r["x"] for r in one.collect()) == [0, 1, 2, 3, 4]
    # A write that fails leaves the table as it was.
    broken = one.select(F.raise_error(F.lit("stopped")).cast("long").alias("x"))
    with pytest.raises(Exception, match="stopped"):
        vs.publish(broken, path)
    assert vs.read_published(spark, path).count() == 5 and len(vs.manifest(spark, path)) == 2
    vs.publish(spark.range(1).toDF("x"), path, keep=2)
    assert set(vs.manifest(spark, path)) == {"2", "3"}
    with pytest.raises(DataError):
        vs.read_published(spark, path, 1)
    assert vs.read_published(spark, path, 2).count() == 5
    left = {p.name for p in (tmp_path / "table").iterdir() if not p.name.startswith(".")}
    assert "manifest.json" in left and not any(n.endswith(".tmp") for n in left)
