"""Published tables: each write is a version of its own, and one small manifest names the version that readers see."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from convsignals.schema import DataError

MANIFEST = "manifest.json"
KEPT = 3


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each version that is kept, by its number; empty before the first publish."""
    _, place, fs = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(place):
        return {}
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()["value"])


def _switch(spark: SparkSession, path: str, content: dict[str, str]) -> None:
    """Write the manifest beside the old one and rename it over that: readers see the old or the new one, never neither."""
    jvm, new, fs = _hadoop(spark, f"{path}/manifest-{uuid.uuid4().hex}.tmp")
    out = fs.create(new, False)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(target), options)


def publish(table: DataFrame, path: str, keep: int = KEPT) -> int:
    """Write the next version of a table and switch to it; returns its number, from 1.

    The table may be computed from an earlier version at the same path. A write that fails leaves the manifest as it was.
    The newest ``keep`` versions stay readable; older folders are deleted after the switch. One writer at a time: a
    version published meanwhile stops the switch. The rename is atomic on HDFS and local file systems.
    """
    spark = table.sparkSession
    known = manifest(spark, path)
    number = max(map(int, known), default=0) + 1
    folder = f"version-{number:06d}-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{folder}")
    if manifest(spark, path) != known:
        raise DataError(f"another version of {path} was published meanwhile")
    whole = known | {str(number): folder}
    stay = {k: v for k, v in whole.items() if int(k) > number - keep}
    _switch(spark, path, stay)
    for version, old in whole.items():
        if version not in stay:
            _, place, fs = _hadoop(spark, f"{path}/{old}")
            fs.delete(place, True)
    return number


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a published table, or one that is still kept."""
    known = manifest(spark, path)
    if not known:
        raise DataError(f"nothing is published at {path}")
    number = version or max(map(int, known))
    if str(number) not in known:
        raise DataError(f"version {number} of {path} is not kept")
    return spark.read.parquet(f"{path}/{known[str(number)]}")
