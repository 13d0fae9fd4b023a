"""Corpus readers with explicit schemas; nothing is inferred on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convsignals.schema import CONVERSATION_SCHEMA, PREDICTION_SCHEMA, DataError

FORMATS = {".jsonl": "jsonl", ".json": "json", ".csv": "csv"}
WRAPPERS = ["data", "records", "conversations", "items"]
CORRUPT = "_corrupt_record"


def format_of(path: str) -> str:
    for suffix, name in FORMATS.items():
        if path.lower().endswith(suffix):
            return name
    raise DataError(f"unsupported corpus format: {path}")


def read_corpus(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType = CONVERSATION_SCHEMA
) -> DataFrame:
    """Read JSON lines, JSON or CSV, by extension unless ``fmt`` says otherwise."""
    readers = {"jsonl": read_json_lines, "json": read_json, "csv": read_csv}
    fmt = fmt or format_of(path)
    if fmt not in readers:
        raise DataError(f"unsupported corpus format: {fmt}")
    return readers[fmt](spark, path, schema)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = CONVERSATION_SCHEMA) -> DataFrame:
    """Blank lines are skipped; a malformed line stops the job with its file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lines_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType = CONVERSATION_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the malformed lines with their file. Blank lines count as neither."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.withColumn("r", F.from_json("value", wide, options))
    good = rows.where(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema])
    bad = rows.where(F.col(f"r.{CORRUPT}").isNotNull()).select("file", F.col("value").alias("line"))
    return good, bad


def read_json(spark: SparkSession, path: str, schema: T.StructType = CONVERSATION_SCHEMA) -> DataFrame:
    """A top-level list, an object that wraps the list, or one object.

    A single JSON document is one task by nature; large corpora belong in JSON lines or parquet.
    """
    own = [f.name for f in schema]
    wrapper = T.ArrayType(schema)
    wide = T.StructType([*schema.fields, *[T.StructField(w, wrapper) for w in WRAPPERS if w not in own]])
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "FAILFAST").json(path)
    wrapped = F.coalesce(*[F.col(w) for w in WRAPPERS if w not in own])
    alone = F.array(F.struct(*[F.col(n) for n in own]))
    return rows.select(F.inline(F.coalesce(wrapped, alone)))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = CONVERSATION_SCHEMA) -> DataFrame:
    """Only a top-level JSON list is accepted."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).first()
    if first is None or not first["value"].lstrip().startswith("["):
        raise DataError(f"expected a JSON array in {path}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def require_rows(corpus: DataFrame, path: str) -> DataFrame:
    """An empty corpus is an error."""
    if corpus.isEmpty():
        raise DataError(f"no records in {path}")
    return corpus


def read_prefix_predictions(
    spark: SparkSession, folder: str, schema: T.StructType = PREDICTION_SCHEMA
) -> DataFrame:
    """All ``predictions_025pct.csv``-style files of a folder, with ``fraction`` from the name."""
    tag = F.regexp_extract(F.col("_metadata.file_name"), r"predictions_(\d{3})pct", 1)
    rows = spark.read.schema(schema).option("header", True).csv(f"{folder}/predictions_*pct.csv")
    return rows.withColumn("fraction", tag.cast("double") / 100)
