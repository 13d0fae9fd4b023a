"""Lines of text files with their place: line number, byte offset and record number, whatever the splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convsignals.schema import CONVERSATION_SCHEMA
from convsignals.session import stored

CORRUPT = "_corrupt_record"
_PLACED = "file string, block long, line long, record long, offset long, size long, value string"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of lines, records and bytes before each line of its split; a task reads the lines of a split in order.

    A record is a line that is not blank. Rows are (file, block, value).
    """
    held, before = None, np.zeros(3, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        file, block, value = b.column(0), b.column(1), b.column(2)
        size = pc.binary_length(value.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.not_equal(pc.utf8_trim_whitespace(value), "").to_numpy(zero_copy_only=False)
        code = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        start = block.to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (start[1:] != start[:-1])]))
        steps = np.stack([np.ones(len(size), np.int64), full.astype(np.int64), size + 1])
        total = np.cumsum(steps, axis=1) - steps
        length = np.diff(np.append(edge, len(size)))
        # What lies before a split in this batch is taken off; what it had in earlier batches is put on.
        total -= np.repeat(total[:, edge], length, axis=1)
        key = (file[0].as_py(), int(start[0]))
        if key == held:
            total[:, : length[0]] += before[:, None]
        held, before = (file[-1].as_py(), int(start[-1])), total[:, -1] + steps[:, -1]
        yield pa.RecordBatch.from_arrays(
            [file, block, pa.array(total[0]), pa.array(np.where(full, total[1], -1)), pa.array(total[2]), pa.array(size), value],
            names=["file", "block", "line", "record", "offset", "size", "value"],
        )


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, offset, record, value)``: number and byte offset of each line in its file, from 0, and its number
    among all records, files taken in order of their paths; null for a blank line.

    Lines end with a line feed. The result does not depend on how files are split: each split counts for itself, and one row
    per split carries the counts of what lies before it.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    placed = rows.mapInArrow(_place, _PLACED)
    blocks = placed.groupBy("file", "block").agg(
        (F.max("line") + 1).alias("lines"), (F.max("record") + 1).alias("records"), F.max(F.col("offset") + F.col("size") + 1).alias("bytes")
    )
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = {
        "lines_before": F.coalesce(F.sum("lines").over(own), F.lit(0)),
        "bytes_before": F.coalesce(F.sum("bytes").over(own), F.lit(0)),
        "records_before": F.coalesce(F.sum("records").over(order), F.lit(0)),
    }
    # One row per split of the input.
    blocks = stored(blocks.withColumns(before).drop("lines", "records", "bytes"))
    out = placed.join(blocks, ["file", "block"])
    return out.select(
        "file",
        (F.col("line") + F.col("lines_before")).alias("line"),
        (F.col("offset") + F.col("bytes_before")).alias("offset"),
        F.when(F.col("record") >= 0, F.col("record") + F.col("records_before")).alias("record"),
        "value",
    )


@dataclass
class LineReport:
    """``rows`` are the good rows with their ``record`` number, ``bad`` the malformed lines with file, line, offset and text,
    ``counts`` good, bad and blank lines per file."""

    rows: DataFrame
    bad: DataFrame
    counts: DataFrame


def read_json_lines_report(spark: SparkSession, path: str, schema: T.StructType = CONVERSATION_SCHEMA) -> LineReport:
    """JSON lines with a quarantine of malformed lines. Lines are parsed once, in the scan that places them."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = stored(placed_lines(spark, path).withColumn("r", parsed))
    good = F.col("record").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
    broken = F.col("record").isNotNull() & F.col(f"r.{CORRUPT}").isNotNull()
    rows = lines.where(good).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema], "record")
    bad = lines.where(broken).select("file", "line", "offset", F.col("value").alias("text"))
    counts = lines.groupBy("file").agg(
        F.count_if(good).alias("good"), F.count_if(broken).alias("bad"), F.count_if(F.col("record").isNull()).alias("blank")
    )
    return LineReport(rows, bad, counts)


def with_record_ids(rows: DataFrame, key: str, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Rows with ``record_id``, the key as text or ``row_{number}`` where it is null, and one error row per id that repeats:
    ``(record_id, n, first, second)`` with the two lowest record numbers."""
    named = rows.withColumn("record_id", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row_"), F.col(record).cast("string"))))
    ids = named.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.min(record).alias("first"))
    twice = ids.where("n > 1")
    later = named.join(twice, "record_id").where(F.col(record) > F.col("first"))
    second = later.groupBy("record_id").agg(F.min(record).alias("second"))
    return named, twice.join(second, "record_id", "left").select("record_id", "n", "first", "second")
