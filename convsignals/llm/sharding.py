"""Jump consistent hashing of stable keys to shards, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from convsignals.session import stored

BLOCK_ROWS = 200_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of unsigned 64-bit keys (Lamping and Veach), all keys at once."""
    key = keys.astype(np.uint64)
    last = np.zeros(len(key), np.int64)
    at = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            last[live] = at[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            at[live] = ((last[live] + 1) * step).astype(np.int64)
            live = live[at[live] < shards]
    return last.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a non-null long key."""

    @F.pandas_udf(T.IntegerType())
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return shard(key)


def stable_key(id_col: Column) -> Column:
    """60 bits of the MD5 of the id as text; the empty text stands for a null id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the number of shards alone decide the shard, so equal ids go together and one more shard
    (``grown_shard``) takes rows only into itself. ``size`` is the UTF-8 length of the text plus 16; a null text counts
    as empty, a null id has a key of its own. ``slot`` numbers the rows of a shard without gaps from 0, by (block, id,
    crc32, size); rows alike in all of these are interchangeable. Blocks hold about BLOCK_ROWS rows and are ranked apart,
    so no task sorts a shard; only one count per (shard, block) is summed over. An empty table gives an empty result.
    Only ids, sizes and checksums are shuffled, never texts; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        stable_key(F.col(id_col)).alias("key"),
    )
    d = stored(
        d.select(
            "*", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard")
        )
    )
    blocks = block_count(d.count(), shards)
    d = d.withColumn("block", (F.col("key") % blocks).cast("int"))
    before = (
        d.groupBy("shard", "block")
        .count()
        .select(
            "shard",
            "block",
            (F.sum("count").over(W.Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"),
        )
    )
    ranked = d.withColumn(
        "rank",
        F.row_number().over(W.Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1,
    )
    return ranked.join(before, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("rank") + F.col("before")).alias("slot"),
        "grown_shard",
    )


def block_count(rows: int, shards: int) -> int:
    """Blocks per shard so that each has about BLOCK_ROWS rows."""
    return max(1, -(-rows // (shards * BLOCK_ROWS)))


def oracle(shards: int = 40, documents: str = "documents") -> str:
    """The same rows in DuckDB, the jumps as a recursive query. A crc32 is taken byte by byte."""
    step = "(({k}::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616)"
    return f"""WITH RECURSIVE
poly AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(i)),
crcs AS (SELECT list(v ORDER BY i) AS v FROM poly),
k AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM {documents}),
h AS (SELECT r, hex(b) AS x, octet_length(b) AS n FROM k),
sums AS MATERIALIZED (SELECT r, n + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT) for i in range(n)]),
      lambda c, y: xor(c >> 8, crcs.v[xor(c % 256, y) + 1])), 4294967295) AS text_crc32 FROM h, crcs),
j AS (SELECT n, r, key::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS a FROM k, (VALUES ({shards}), ({shards + 1})) s(n)
  UNION ALL
  SELECT n, r, {step.format(k="key")}, a,
    CAST(floor((a + 1) * (2147483648.0::DOUBLE / (({step.format(k="key")} // 8589934592) + 1)::DOUBLE)) AS BIGINT) FROM j WHERE a < n),
s AS (SELECT n, r, max(b) AS shard FROM j GROUP BY n, r)
SELECT k.doc_id, sums.size, sums.text_crc32, 'key' AS law, CAST(s.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY k.doc_id, text_crc32, size) - 1 AS slot, CAST(g.shard AS INTEGER) AS grown_shard
FROM k JOIN sums USING (r) JOIN s ON s.r = k.r AND s.n = {shards} JOIN s g ON g.r = k.r AND g.n = {shards + 1}"""
