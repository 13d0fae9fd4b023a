"""Round trips of the given tables through files of the library's sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from convsignals.plans.catalog import common as c
from convsignals.session import checkpoint_dir
from convsignals.sources import lines as ln
from convsignals.sources import tables as tb
from convsignals.sources import versions as vs

FILES = 3
RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("size", T.LongType())])


def _folder(spark):
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _written(spark, folder):
    """Documents as JSON lines in FILES files. A seventh has no id, every fiftieth line breaks off, every ninetieth is blank."""
    docs = tb.text_table(spark, folder, "documents")
    whole = F.format_string(
        '{"id": %s, "lang": "%s", "size": %s}',
        F.when(F.col("doc_id") % 7 == 0, "null").otherwise(F.col("doc_id").cast("string")),
        F.col("lang"),
        F.length("text").cast("string"),
    )
    line = F.when(F.col("doc_id") % 50 == 0, F.expr("left(line, length(line) - 3)")).when(F.col("doc_id") % 90 == 1, "  ").otherwise(F.col("line"))
    rows = docs.select("doc_id", whole.alias("line"), (F.col("doc_id") % FILES).alias("part"))
    rows = rows.select("doc_id", line.alias("value"), "part")
    path = _folder(spark)
    rows.repartition(FILES, "part").sortWithinPartitions("part", "doc_id").select("value", "part").write.partitionBy("part").text(path)
    return path


def _part(column="file"):
    return F.regexp_extract(column, r"part=(\d+)", 1).cast("long").alias("part")


def bad_lines(spark, folder):
    """Malformed lines with their file, line number and byte offset."""
    report = ln.read_json_lines_report(spark, f"{_written(spark, folder)}/*", RECORD)
    return report.bad.select(_part(), "line", "offset", "text")


def line_counts(spark, folder):
    report = ln.read_json_lines_report(spark, f"{_written(spark, folder)}/*", RECORD)
    return report.counts.select(_part(), "good", "bad", "blank")


def record_ids(spark, folder):
    """Id of every good row: its own, or its number among all records of the files."""
    report = ln.read_json_lines_report(spark, f"{_written(spark, folder)}/*", RECORD)
    return ln.with_record_ids(report.rows, "id")[0].select("record_id", "lang", "size")


def published_versions(spark, folder):
    """Documents published twice, the second version computed from the first at the same path; rows of both."""
    path = _folder(spark)
    vs.publish(tb.text_table(spark, folder, "documents").select("doc_id", F.length("text").cast("long").alias("size")), path)
    grown = vs.read_published(spark, path).withColumn("size", F.col("size") * 2)
    vs.publish(grown, path)
    one, two = (vs.read_published(spark, path, v).withColumn("version", F.lit(v)) for v in (1, 2))
    return c.rounded(one.unionByName(two))


QUERIES = {f.__name__: f for f in [bad_lines, line_counts, record_ids, published_versions]}

_LINES = f"""lines AS (SELECT doc_id, doc_id % {FILES} AS part, lang, length(text) AS size,
  CASE WHEN doc_id % 50 = 0 THEN left(whole, length(whole) - 3) WHEN doc_id % 90 = 1 THEN '  ' ELSE whole END AS value,
  CASE WHEN doc_id % 50 = 0 THEN 'bad' WHEN doc_id % 90 = 1 THEN 'blank' ELSE 'good' END AS kind
  FROM (SELECT *, '{{"id": ' || CASE WHEN doc_id % 7 = 0 THEN 'null' ELSE CAST(doc_id AS VARCHAR) END || ', "lang": "' || lang
    || '", "size": ' || length(text) || '}}' AS whole FROM documents)),
placed AS (SELECT *, row_number() OVER w - 1 AS line, coalesce(sum(strlen(value) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM lines WINDOW w AS (PARTITION BY part ORDER BY doc_id))"""

ORACLES = {
    "bad_lines": f'WITH {_LINES} SELECT part, line, CAST(place AS BIGINT) AS "offset", value AS text FROM placed WHERE kind = \'bad\'',
    "line_counts": f"""WITH {_LINES} SELECT part, count(*) FILTER (WHERE kind = 'good') AS good, count(*) FILTER (WHERE kind = 'bad') AS bad,
  count(*) FILTER (WHERE kind = 'blank') AS blank FROM lines GROUP BY part""",
    "record_ids": f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (ORDER BY part, doc_id) - 1 AS record FROM lines WHERE kind <> 'blank')
SELECT CASE WHEN doc_id % 7 = 0 THEN 'row_' || record ELSE CAST(doc_id AS VARCHAR) END AS record_id, lang, size FROM r WHERE kind = 'good'""",
    "published_versions": """SELECT doc_id, length(text) * v AS size, CAST(v AS BIGINT) AS version FROM documents, (VALUES (1), (2)) t(v)""",
}
