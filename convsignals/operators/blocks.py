"""Ordered and keyed work that stays bounded when one key holds a large share of the rows.

A plain window over a hot key sorts that whole key in one task. Here the rows of a key are cut into
ordered blocks; windows run inside (key, block), and a summary with one row per block carries the
running totals across blocks. Joins on (key, block) spread a hot key over many tasks as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_BLOCK = 1024
BLOCK_SECONDS = 6 * 3600
HEAVY_KEYS = 1000


def with_block_totals(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``rows_before`` (rows of the key in earlier blocks), ``rows_total``, and for every
    ``carry`` aggregate its value over the nearest earlier block.

    Adds ``_slot``, the struct of keys and block, as well: windows inside a block partition by it and so
    reuse the join's exchange. A struct is never null, so rows with a null key keep together.
    """
    carry = carry or {}
    by_key = Window.partitionBy(*keys)
    in_order = by_key.orderBy(block)
    df = df.withColumn("_slot", F.struct(*keys, block))
    summary = df.groupBy("_slot").agg(
        F.count(F.lit(1)).alias("_n"), *[c.alias(f"_{n}") for n, c in carry.items()]
    )
    summary = summary.select("*", "_slot.*").select(
        "_slot",
        F.coalesce(
            F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("rows_before"),
        F.sum("_n").over(by_key).alias("rows_total"),
        *[F.lag(f"_{n}").over(in_order).alias(n) for n in carry],
    )
    return df.join(summary, "_slot")


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column
) -> DataFrame:
    """Add ``rank`` (1-based row number within the keys) and ``rows_total``.

    ``block`` must not decrease along ``order``; it bounds how many rows one task sorts.
    """
    blocked = df.withColumn("_block", block)
    totals = with_block_totals(blocked, keys, "_block")
    inside = Window.partitionBy("_slot").orderBy(*order)
    return totals.withColumn(
        "rank", (F.col("rows_before") + F.row_number().over(inside)).cast("long")
    ).drop("_block", "_slot", "rows_before")


def with_key_size(
    df: DataFrame, key: str, pos: str = "pos", name: str = "n", block_size: int = POSITION_BLOCK
) -> DataFrame:
    """Add the row count of each key, for tables that already carry a position within the key."""
    blocked = df.withColumn("_block", F.floor(F.col(pos) / block_size))
    return (
        with_block_totals(blocked, [key], "_block")
        .withColumn(name, F.col("rows_total").cast("int"))
        .drop("_block", "_slot", "rows_before", "rows_total")
    )


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    how: str = "left",
    row_id: str | Sequence[str] | None = None,
) -> DataFrame:
    """Join rows to a table that holds one row per key, with the number of rows behind each key.

    The ``HEAVY_KEYS`` heaviest keys (a fixed bound, so broadcasting them is safe at any size) meet
    their rows without a shuffle. The other rows go by key: none of those keys can hold more than
    1/HEAVY_KEYS of the table. Rows already met are spread by a hash of ``row_id``, one or more columns
    that tell the rows apart (all columns if not given).
    """
    values = [c for c in lookup.columns if c not in (key, weight)]
    heavy = lookup.orderBy(F.desc(weight), key).limit(HEAVY_KEYS)
    heavy = heavy.select(
        F.col(key), F.lit(True).alias("_met"), *[F.col(c).alias(f"_heavy_{c}") for c in values]
    )
    first = left.join(F.broadcast(heavy), key, "left")
    apart = [row_id] if isinstance(row_id, str) else list(row_id or left.columns)
    spread = F.xxhash64(*[F.col(c) for c in apart])
    first = first.withColumn(
        "_slot", F.when(F.col("_met"), spread).otherwise(F.xxhash64(F.col(key)))
    )
    rest = lookup.select(
        F.col(key).alias("_key"),
        F.xxhash64(F.col(key)).alias("_slot"),
        *[F.col(c).alias(f"_light_{c}") for c in values],
    )
    both = first.join(
        rest,
        (first["_slot"] == rest["_slot"]) & first["_met"].isNull() & (first[key] == rest["_key"]),
        "left",
    )
    out = both.select(
        *[first[c] for c in left.columns],
        *[F.coalesce(F.col(f"_heavy_{c}"), F.col(f"_light_{c}")).alias(c) for c in values],
        (F.coalesce(F.col("_met"), F.lit(False)) | F.col("_key").isNotNull()).alias("_found"),
    )
    if how == "inner" or how == "semi":
        out = out.where("_found")
    if how == "semi":
        out = out.drop(*values)
    return out.drop("_found")
