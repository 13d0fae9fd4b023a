"""Deterministic stratified splits and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convsignals.operators.blocks import with_rank
from convsignals.schema import DataError


def _ranked(records: DataFrame, key: str, label: str, seed: int, digits: int) -> DataFrame:
    hashed = records.withColumn(
        "_hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    )
    return with_rank(hashed, [label], ["_hash", key], F.substring("_hash", 1, digits)).drop("_hash")


def stratified_split(
    records: DataFrame,
    key: str = "conversation_id",
    label: str = "label",
    train: float = 0.70,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    hash_digits: int = 4,
    check: bool = True,
) -> DataFrame:
    """``(key, label, split)`` by rank of a seeded hash within each class.

    The test share is cut first, then validation as val/(train+val) of the rest. A class is ranked
    in 16**hash_digits hash ranges, so no task sorts a whole class.
    """
    if abs(train + val + test - 1.0) > 1e-9:
        raise DataError(f"split ratios must sum to 1, got {train + val + test}")
    if check and records.limit(6).count() < 6:
        raise DataError("a three-way split needs at least six records")
    n_test = F.round(F.col("rows_total") * test)
    n_val = F.round((F.col("rows_total") - n_test) * (val / (train + val)))
    return _ranked(records.select(key, label), key, label, seed, hash_digits).select(
        key,
        label,
        F.when(F.col("rank") <= n_test, "test")
        .when(F.col("rank") <= n_test + n_val, "val")
        .otherwise("train")
        .alias("split"),
    )


def two_way_split(
    records: DataFrame,
    key: str = "record_id",
    label: str = "label",
    test: float = 0.2,
    seed: int = 42,
    hash_digits: int = 4,
) -> DataFrame:
    return _ranked(records.select(key, label), key, label, seed, hash_digits).select(
        key,
        label,
        F.when(F.col("rank") <= F.round(F.col("rows_total") * test), "test")
        .otherwise("train")
        .alias("split"),
    )


def split_statistics(split: DataFrame, label: str = "label") -> DataFrame:
    """Count and share of each class in each split."""
    counts = split.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("split"))
    return counts.withColumn("pct", share * 100)


def overlapping_ids(split: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Ids that fall into more than one split; empty for a valid assignment."""
    return (
        split.groupBy(key)
        .agg(F.countDistinct("split").alias("splits"))
        .where("splits > 1")
    )


def split_intersections(split: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Shared ids for each pair of splits, as one row of counts."""
    flags = split.groupBy(key).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    )
    return flags.agg(
        F.count_if((F.col("train") == 1) & (F.col("val") == 1)).alias("train_val"),
        F.count_if((F.col("train") == 1) & (F.col("test") == 1)).alias("train_test"),
        F.count_if((F.col("val") == 1) & (F.col("test") == 1)).alias("val_test"),
    )


def restrict(rows: DataFrame, ids: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Rows whose id is in the list."""
    return rows.join(ids.select(key), key, "left_semi")


def labelled_features(
    features: DataFrame, labels: DataFrame, split: DataFrame, key: str = "conversation_id"
) -> DataFrame:
    """Features joined with label and split; ids missing on any side drop out."""
    return features.join(labels, key).join(split.select(key, "split"), key)


def join_losses(features: DataFrame, labels: DataFrame, split: DataFrame, key: str = "conversation_id") -> DataFrame:
    """How many split ids lack features or a label."""
    marked = (
        split.select(key)
        .join(features.select(key, F.lit(True).alias("_f")), key, "left")
        .join(labels.select(key, F.lit(True).alias("_l")), key, "left")
    )
    return marked.agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.count_if(F.col("_f").isNull()).alias("without_features"),
        F.count_if(F.col("_l").isNull()).alias("without_label"),
    )
