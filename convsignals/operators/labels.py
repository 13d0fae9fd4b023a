"""Outcome mapping, ordered skip reasons, class filters and guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals.functions import text as tx
from convsignals.operators.blocks import lookup_join
from convsignals.schema import DataError


def raw_to_class(mapping: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Invert the label mapping; a raw label under two classes is an error."""
    pairs = [(raw, label) for label, raws in mapping.items() for raw in raws]
    inverted = dict(pairs)
    if len(inverted) != len(pairs):
        repeated = sorted({raw for raw, _ in pairs if [r for r, _ in pairs].count(raw) > 1})
        raise DataError(f"raw labels mapped to more than one class: {repeated}")
    return inverted


def class_ids(mapping: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Class ids in alphabetical order."""
    return {label: i for i, label in enumerate(sorted(mapping))}


def class_of(raw: Column, mapping: Mapping[str, Sequence[str]] | None) -> Column:
    """Class of a raw label, null when unmapped; without a mapping the raw label is the class."""
    if mapping is None:
        return raw
    raw_to_class(mapping)
    out = F.lit(None).cast("string")
    for label, raws in mapping.items():
        out = F.when(raw.isin(*raws), F.lit(label)).otherwise(out)
    return out


def class_id_of(label: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit(None).cast("int")
    for name, number in class_ids(mapping).items():
        out = F.when(label == name, F.lit(number)).otherwise(out)
    return out


def with_skip_reason(
    records: DataFrame,
    mapping: Mapping[str, Sequence[str]] | None,
    raw_label: str = "raw_label",
    text: str = "text",
    n_messages: str | None = None,
    in_subset: str | None = None,
) -> DataFrame:
    """Add ``label`` and ``skip_reason``: the first rule, in this order, that drops the record."""
    label = class_of(F.col(raw_label), mapping)
    rules: list[tuple[Column, str]] = []
    if in_subset:
        rules.append((~F.coalesce(F.col(in_subset), F.lit(False)), "not_in_subset"))
    rules += [(F.col(raw_label).isNull(), "missing_label"), (label.isNull(), "unmapped_label")]
    if n_messages:
        rules.append((F.coalesce(F.col(n_messages), F.lit(0)) == 0, "no_messages"))
    rules.append((tx.strip(F.coalesce(F.col(text), F.lit(""))) == "", "empty_text"))
    reason = F.lit(None).cast("string")
    for test, name in reversed(rules):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return records.withColumns({"label": label, "skip_reason": reason})


def skip_counts(records: DataFrame) -> DataFrame:
    """How many records each reason dropped; kept ones count as ``kept``."""
    return records.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def with_subset_flag(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Mark records whose id is in the subset."""
    flags = ids.select(key).distinct().withColumn("in_subset", F.lit(True))
    return records.join(flags, key, "left").fillna(False, subset=["in_subset"])


def baseline_dataset(
    records: DataFrame,
    mapping: Mapping[str, Sequence[str]] | None = None,
    min_per_class: int = 2,
    **cleaning: bool,
) -> DataFrame:
    """Rows ``record_id, raw_text, cleaned_text, raw_label, label`` of usable classes."""
    rows = records.withColumn("cleaned_text", tx.cleaned(F.col("raw_text"), **cleaning))
    rows = with_skip_reason(rows, mapping, text="cleaned_text").where("skip_reason IS NULL")
    rows = rows.select("record_id", "raw_text", "cleaned_text", "raw_label", "label")
    return keep_large_classes(rows, min_per_class)


def keep_large_classes(
    rows: DataFrame, min_per_class: int = 2, label: str = "label", row_id: str = "record_id"
) -> DataFrame:
    """Drop the rows of classes below the minimum size.

    Classes are few and each holds many rows, so rows are never shuffled by class: the largest
    classes are matched by broadcast and only the rows of the rest move.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_per_class)
    return lookup_join(rows, sizes, label, "_size", how="semi", row_id=row_id)


def label_distribution(
    records: DataFrame, mapping: Mapping[str, Sequence[str]], raw_label: str = "raw_label"
) -> DataFrame:
    """Count per raw label with its class, ``UNMAPPED`` or ``MISSING`` where there is none."""
    label = class_of(F.col(raw_label), mapping)
    return records.groupBy(
        F.coalesce(F.col(raw_label), F.lit("MISSING")).alias("raw_label"),
        F.when(F.col(raw_label).isNull(), "MISSING")
        .otherwise(F.coalesce(label, F.lit("UNMAPPED")))
        .alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(
    records: DataFrame, mapping: Mapping[str, Sequence[str]], raw_label: str = "raw_label"
) -> DataFrame:
    """One row: records, count and share per class, and missing and unmapped counts."""
    raw = F.col(raw_label)
    label = class_of(raw, mapping)
    mapped = F.count(label)
    columns = [F.count(F.lit(1)).alias("n_records")]
    for name in sorted(mapping):
        hits = F.count_if(label == name)
        columns += [
            hits.alias(f"n_{name}"),
            (tx.ratio(hits, mapped) * 100).alias(f"pct_{name}"),
        ]
    columns += [
        F.count_if(raw.isNull()).alias("n_missing"),
        F.count_if(raw.isNotNull() & label.isNull()).alias("n_unmapped"),
    ]
    return records.agg(*columns)


def require_usable(rows: DataFrame, record_id: str = "record_id", text: str = "text", label: str = "label") -> DataFrame:
    """Stop unless there are rows, two classes, unique ids and no blank text. One small action."""
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(record_id).alias("ids"),
        F.countDistinct(label).alias("classes"),
        F.count_if(tx.strip(F.coalesce(F.col(text), F.lit(""))) == "").alias("blank"),
    ).first()
    problems = [
        message
        for broken, message in [
            (facts["n"] == 0, "no usable record remains"),
            (facts["ids"] != facts["n"], "duplicate record ids"),
            (facts["n"] > 0 and facts["classes"] < 2, "fewer than two classes remain"),
            (facts["blank"] > 0, "blank text among retained records"),
        ]
        if broken
    ]
    if problems:
        raise DataError("; ".join(problems))
    return rows
