"""Validation rules. Nested conversations are checked row by row, so nothing is shuffled but ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.functions import text as tx
from convsignals.sources.tables import mapped


def _violation(test: Column, rule: str, detail: Column | None = None, index: Column | None = None) -> Column:
    """A struct where the rule is broken, null elsewhere; an unknown test counts as sound."""
    return F.when(
        test,
        F.struct(
            (F.lit(None).cast("int") if index is None else index.cast("int")).alias("message_index"),
            F.lit(rule).alias("rule"),
            (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"),
        ),
    )


def _not_in(value: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(value, F.lit("")).isin(*allowed)


def _conversation_rules() -> list[Column]:
    expected = mapped(F.col("interest_trajectory"), S.TRAJECTORY_OUTCOME)
    messages = F.col("messages")
    first = F.try_element_at(messages, F.lit(1))["role"]
    return [
        _violation(~F.col("conversation_id").rlike(S.ID_PATTERN), "id_format", F.col("conversation_id")),
        _violation(~F.col("language").eqNullSafe(S.LANGUAGE), "language", F.col("language")),
        _violation(~F.col("locale").eqNullSafe(S.LOCALE), "locale", F.col("locale")),
        _violation(~F.coalesce(F.col("synthetic"), F.lit(False)), "synthetic"),
        _violation(_not_in(F.col("interest_trajectory"), S.TRAJECTORIES), "trajectory", F.col("interest_trajectory")),
        _violation(_not_in(F.col("final_outcome"), S.OUTCOMES), "outcome", F.col("final_outcome")),
        _violation(
            expected.isNotNull() & ~F.col("final_outcome").eqNullSafe(expected),
            "trajectory_outcome",
            F.col("final_outcome"),
        ),
        _violation(F.size(messages) == 0, "empty_messages"),
        _violation((F.size(messages) > 0) & ~first.eqNullSafe("customer"), "first_role", first),
        *[
            _violation(
                (F.size(messages) > 0) & ~F.array_contains(F.col("messages.role"), role), f"no_{role}"
            )
            for role in S.ROLES
        ],
        *[
            _violation(
                (F.size(messages) > 0) & F.col(f"metadata.{name}").isNull(), "metadata_missing", F.lit(name)
            )
            for name in S.METADATA_SCHEMA.fieldNames()
        ],
        _violation(
            (F.size(messages) > 0) & ~F.col("metadata.channel").eqNullSafe(S.CHANNEL),
            "channel",
            F.col("metadata.channel"),
        ),
    ]


def _minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes between two well-formed stamps, null if either is malformed."""

    def parsed(stamp: Column) -> Column:
        return F.when(
            stamp.rlike(S.TIMESTAMP_PATTERN), F.try_to_timestamp(stamp, F.lit(S.TIMESTAMP_FORMAT))
        )

    seconds = F.unix_timestamp(parsed(later)) - F.unix_timestamp(parsed(earlier))
    return F.try_divide(seconds, F.lit(60)).cast("int")


def _message_rules(m: Column, i: Column, check_gender_slash: bool, letters: str) -> list[Column]:
    messages = F.col("messages")
    text, role, label = m["text"], m["role"], m["interest_label"]
    delay, stamp, signals = m["response_delay_minutes"], m["timestamp"], m["behavioral_features"]
    blank = tx.strip(F.coalesce(text, F.lit(""))) == ""
    gap = _minutes_between(stamp, F.get(messages, i - 1)["timestamp"])

    def rule(test: Column, name: str, detail: Column | None = None) -> Column:
        return _violation(test, name, detail, i)

    rules = [
        *[
            rule(m[name].isNull(), "message_missing", F.lit(name))
            for name in ("message_index", "role", "text", "response_delay_minutes", "interest_label", "timestamp")
        ],
        rule(signals.isNull(), "message_missing", F.lit("behavioral_features")),
        rule(~m["message_index"].eqNullSafe(i), "message_index", m["message_index"]),
        rule(_not_in(role, S.ROLES), "role", role),
        rule(blank, "empty_text"),
        rule(~blank & ~tx.has_script(text, letters), "no_script_letter"),
        rule(_not_in(label, S.INTEREST_LABELS), "interest_label", label),
        rule((role == "business") & ~label.eqNullSafe("not_applicable"), "business_label", label),
        rule((role == "business") & m["interest_score"].isNotNull(), "business_score"),
        rule((role == "customer") & label.eqNullSafe("not_applicable"), "customer_label", label),
        rule(~F.coalesce(stamp, F.lit("")).rlike(S.TIMESTAMP_PATTERN), "timestamp_format", stamp),
        rule(F.coalesce(delay, F.lit(-1)) < 0, "delay", delay),
        rule((i > 0) & (gap != delay), "delay_mismatch", gap),
        *[
            rule(signals.isNotNull() & signals[name].isNull(), "signal_missing", F.lit(name))
            for name in S.SIGNAL_NAMES
        ],
        rule(
            text.isNotNull() & (signals["message_length_chars"] != F.length(text)),
            "message_length",
            signals["message_length_chars"],
        ),
    ]
    if check_gender_slash:
        rules.append(rule(~blank & tx.has_gender_slash(text), "gender_slash"))
    return rules


def violations(
    corpus: DataFrame, check_gender_slash: bool = True, letters: str = tx.HEBREW_LETTER
) -> DataFrame:
    """``(conversation_id, message_index, rule, detail)`` for each broken rule.

    A conversation that lacks required fields is reported for those alone. Type errors surface at
    read time as corrupt records.
    """
    required = S.CONVERSATION_SCHEMA.fieldNames()
    missing = F.array_compact(
        F.array(*[_violation(F.col(name).isNull(), "missing_field", F.lit(name)) for name in required])
    )
    per_message = F.flatten(
        F.transform(
            F.coalesce(F.col("messages"), F.array().cast(S.CONVERSATION_SCHEMA["messages"].dataType)),
            lambda m, i: F.array(*_message_rules(m, i, check_gender_slash, letters)),
        )
    )
    broken = F.array_compact(F.concat(F.array(*_conversation_rules()), per_message))
    rows = corpus.select(
        "conversation_id", F.when(F.size(missing) > 0, missing).otherwise(broken).alias("v")
    ).select("conversation_id", F.inline("v"))
    return rows.unionByName(duplicate_ids(corpus))


def duplicate_ids(corpus: DataFrame) -> DataFrame:
    """The dataset rule: each id that occurs more than once."""
    return (
        corpus.groupBy("conversation_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            "conversation_id",
            F.lit(None).cast("int").alias("message_index"),
            F.lit("duplicate_id").alias("rule"),
            F.col("n").cast("string").alias("detail"),
        )
    )


def validation_summary(ids: DataFrame, broken: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Total, valid and invalid conversations."""
    bad = broken.select(key).distinct().withColumn("_bad", F.lit(1))
    flags = ids.join(bad, key, "left")
    return flags.agg(
        F.count(F.lit(1)).alias("total_conversations"),
        F.count_if(F.col("_bad").isNull()).alias("valid_conversations"),
        F.countDistinct(F.when(F.col("_bad") == 1, F.col(key))).alias("invalid_conversations"),
    )


def rule_counts(broken: DataFrame) -> DataFrame:
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def first_violations(broken: DataFrame, k: int = 10) -> DataFrame:
    return broken.orderBy("conversation_id", F.col("message_index").asc_nulls_first(), "rule").limit(k)


def turn_violations(messages: DataFrame, attributes: DataFrame | None = None, letters: str = r"[A-Za-z]") -> DataFrame:
    """The message rules for a long table: position, role, text, script, first role, both roles.

    Positions are checked by aggregates (a gap-free run from 0 has max = n-1 and distinct values),
    the other rules per row; nothing sorts a conversation.
    """
    i = F.col("pos")
    blank = tx.strip(F.coalesce(F.col("text"), F.lit(""))) == ""
    row_rules = F.array_compact(
        F.array(
            _violation(_not_in(F.col("role"), S.ROLES), "role", F.col("role"), i),
            _violation(blank, "empty_text", None, i),
            _violation(~blank & ~tx.has_script(F.col("text"), letters), "no_script_letter", None, i),
            _violation(F.col("response_delay_minutes") < 0, "delay", F.col("response_delay_minutes"), i),
        )
    )
    rows = messages.select("conversation_id", F.inline(row_rules))
    facts = messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("pos").alias("last"),
        F.min("pos").alias("least"),
        F.min_by("role", "pos").alias("first_role"),
        F.count_if(F.col("role") == "customer").alias("n_customer"),
        F.count_if(F.col("role") == "business").alias("n_business"),
    )
    group_rules = F.array_compact(
        F.array(
            _violation((F.col("least") != 0) | (F.col("last") != F.col("n") - 1), "message_index"),
            _violation(~F.col("first_role").eqNullSafe("customer"), "first_role", F.col("first_role")),
            _violation(F.col("n_customer") == 0, "no_customer"),
            _violation(F.col("n_business") == 0, "no_business"),
        )
    )
    return rows.unionByName(facts.select("conversation_id", F.inline(group_rules)))


