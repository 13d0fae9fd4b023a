"""Decode raw model responses into messages, with a reason for each one that cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals.functions import text as tx
from convsignals.schema import ROLES

RAW_CHARS = 500
_FENCE = "```"


def unfenced(raw: Column) -> Column:
    """Body of the first code fence up to the last one, or the whole text without a fence."""
    text = tx.strip(raw)
    tagged = F.regexp_extract(text, r"(?s)^.*?```json(.*)```", 1)
    plain = F.regexp_extract(text, r"(?s)^.*?```(.*)```", 1)
    body = F.when(F.contains(text, F.lit(_FENCE + "json")), tagged).when(
        F.contains(text, F.lit(_FENCE)), plain
    )
    return tx.strip(F.coalesce(body, text))


def _text_of(variant: Column, name: str) -> Column:
    """A string member, null when absent or of another type."""
    member = F.try_variant_get(variant, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(variant, f"$.{name}", "string"))


def decode_responses(
    responses: DataFrame, raw: str = "raw", expected: str = "expected_count"
) -> DataFrame:
    """Add ``messages``, ``actual_outcome``, ``trajectory_notes`` and ``reject_reason``.

    ``reject_reason`` is null for usable responses and otherwise the first failed check.
    """
    parsed = responses.withColumn("_json", F.try_parse_json(unfenced(F.col(raw))))
    member = F.try_variant_get("_json", "$.messages", "variant")
    items = F.try_variant_get("_json", "$.messages", "array<variant>")
    parsed = parsed.withColumns({"_member": member, "_items": items})

    def fault(item: Column) -> Column:
        role, text = _text_of(item, "role"), _text_of(item, "text")
        return (
            F.when(~F.schema_of_variant(item).startswith("OBJECT"), "message_not_object")
            .when(~F.coalesce(role, F.lit("")).isin(*ROLES), "invalid_role")
            .when(tx.strip(F.coalesce(text, F.lit(""))) == "", "empty_text")
        )

    first_fault = F.get(F.array_compact(F.transform("_items", fault)), F.lit(0))
    kind = F.schema_of_variant("_json")
    reason = (
        F.when(F.col("_json").isNull(), "invalid_json")
        .when(~kind.startswith("OBJECT") | F.col("_member").isNull(), "missing_messages")
        .when(F.col("_items").isNull() | (F.size("_items") == 0), "messages_not_list")
        .when(first_fault.isNotNull(), first_fault)
        .when(F.size("_items") != F.col(expected), "wrong_count")
    )
    messages = F.transform(
        "_items",
        lambda m: F.struct(
            F.try_variant_get(m, "$.role", "string").alias("role"),
            tx.strip(F.try_variant_get(m, "$.text", "string")).alias("text"),
        ),
    )

    def note(name: str) -> Column:
        return tx.strip(F.coalesce(F.try_variant_get("_json", f"$.{name}", "string"), F.lit("")))

    return (
        parsed.withColumn("reject_reason", reason)
        .withColumn("messages", F.when(F.col("reject_reason").isNull(), messages))
        .withColumn("actual_outcome", note("actual_outcome"))
        .withColumn("trajectory_notes", note("trajectory_notes"))
        .drop("_json", "_member", "_items")
    )


def accepted_responses(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason IS NULL").drop("reject_reason")


def rejection_records(decoded: DataFrame, raw: str = "raw") -> DataFrame:
    """Rejected responses with their raw text cut to what a log row keeps."""
    return decoded.where("reject_reason IS NOT NULL").select(
        *[c for c in decoded.columns if c not in (raw, "messages", "actual_outcome", "trajectory_notes")],
        F.substring(raw, 1, RAW_CHARS).alias("raw_excerpt"),
    )


def rejection_counts(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
