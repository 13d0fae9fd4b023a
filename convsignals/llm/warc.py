"""WARC archives with revisit resolution.

Groups of equal payloads are found from headers alone: (digest, page id, length) is aggregated before any shuffle. One record of each payload stays a response, the others become revisit records that refer to it. Archives are written
by Spark's own committer as compressed text parts, each record with fresh headers, and read back by the length that a
record's header states.
"""

from __future__ import annotations

import datetime
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convsignals.session import checkpoint_dir, stored

LEAST_BYTES = 1000
#: Archives are closed after so many records.
RECORDS_PER_FILE = 20_000
HEAVY = 1000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """page_id, url, payload (UTF-8 bytes, empty for null), payload_bytes, payload_digest (hex SHA-1) of every page."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
    )


def resolve(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds record_type and refers_to to rows of ``headers``.

    Of the records with one digest and at least ``least_bytes`` bytes, that with the largest page_id is the response and
    every other id revisits it; rows that repeat the largest id are responses too. A row without an id has nothing to be
    referred by: alone it is a response, beside numbered ones a revisit. The digests that HEAVY or fewer groups share
    most are matched by broadcast (a bounded list), the rest, each then at most a 1/HEAVY part, by shuffled headers.
    """
    long = F.col("payload_bytes") >= least_bytes
    groups = stored(
        records.filter(long)
        .groupBy("payload_digest")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("largest"))
        .filter((F.col("copies") > 1) & F.col("largest").isNotNull())
    )
    heavy = groups.orderBy(F.desc("copies"), "payload_digest").limit(HEAVY).select("payload_digest", F.col("largest").alias("top"))
    light = groups.join(F.broadcast(heavy), "payload_digest", "left_anti").select("payload_digest", "largest")
    known = records.join(F.broadcast(heavy), "payload_digest", "left")
    if "payload" in records.columns:  # what is a revisit already travels without its payload
        settled = long & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
        known = known.withColumn("payload", F.when(settled, F.lit(b"")).otherwise(F.col("payload")))
    shared = F.when(long & F.col("top").isNull(), F.col("payload_digest"))
    # Rows that cannot match are spread by their id instead of meeting at one null key.
    out = known.withColumn("key", F.coalesce(shared, F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    out = out.join(light.withColumnRenamed("payload_digest", "key"), "key", "left")
    owner = F.when(long, F.coalesce(F.col("top"), F.col("largest")))
    revisit = owner.isNotNull() & ~F.col("page_id").eqNullSafe(owner)
    return out.select(
        *records.columns,
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, owner).alias("refers_to"),
    )


def _uri(id_col: Column) -> Column:
    """A record id that depends on the page id alone, so that a retried task writes the same bytes."""
    h = F.md5(F.concat(F.lit("page-"), F.coalesce(id_col.cast("string"), F.lit("none"))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(records: DataFrame, path: str, date: datetime.datetime | None = None) -> None:
    """Writes rows of ``resolve`` as gzip WARC/1.1 archives below ``path``. Revisit records carry no payload.

    Line breaks in a URL are percent-encoded, since they would end the header. An empty table writes no record.
    """
    stamp = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.col("page_id"))),
        line("WARC-Date", F.lit(stamp)),
        line("WARC-Target-URI", url),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", _uri(F.col("refers_to"))),
                line("X-Refers-To-Page", F.col("refers_to")),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(END),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    (
        records.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", END)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def _records(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of one archive, plain or gzip (one or many members)."""
    if blob[:2] == b"\x1f\x8b":
        parts = []
        while blob:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(blob) + d.flush())
            blob = d.unused_data
        blob = b"".join(parts)
    at = 0
    while at < len(blob):
        cut = blob.index(b"\r\n\r\n", at)
        names = {}
        for entry in blob[at:cut].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = entry.partition(":")
            names[name.strip().lower()] = value.strip()
        length = int(names["content-length"])
        yield names, blob[cut + 4 : cut + 4 + length]
        at = cut + 4 + length + len(END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives below ``path`` with the columns of COLUMNS, one archive at a time per task.

    ``payload_bytes`` and ``payload_digest`` describe the full payload: of a response they are computed from what was
    read, of a revisit taken from its header. An archive is held in memory as a whole, so archives should be closed
    after a bounded number of bytes, as ``write_warc`` does by RECORDS_PER_FILE.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for blob in batch["content"]:
                rows = []
                for names, body in _records(bytes(blob)):
                    response = names.get("warc-type") == "response"
                    length = len(body) if response else int(names.get("x-payload-length", len(body)))
                    digest = hashlib.sha1(body).hexdigest() if response else names.get("warc-payload-digest", "")[5:]
                    page, refers = names.get("x-page-id"), names.get("x-refers-to-page")
                    rows.append((page, names.get("warc-target-uri"), body, length, digest, names.get("warc-type"), refers))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
                yield pd.DataFrame(rows, columns=COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kinds = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    read = files.mapInPandas(parse, kinds)
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes every page as a WARC record, revisits resolved, and returns what reading the archives gives.

    Columns: page_id, payload_bytes (long), payload_digest, record_type, refers_to. A null html is an empty payload, a
    null id comes back as null, repeated rows are records of their own, an empty table gives no rows. ``path`` defaults
    to a new folder in the shared checkpoint folder.
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(resolve(headers(pages)), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")



def oracle(least_bytes: int = LEAST_BYTES) -> str:
    """The rows of ``archive`` in DuckDB."""
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= {least_bytes} THEN max(page_id) OVER (PARTITION BY digest, n) END AS top FROM h)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m"""
