"""Behavioral features of a conversation or of any of its prefixes, in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.functions.text import ratio
from convsignals.operators.blocks import with_key_size
from convsignals.operators.conversation import explode_messages, with_prefixes

SESSION_GAP_MINUTES = 60


def with_signal_defaults(messages: DataFrame) -> DataFrame:
    """Missing signals and delays count as zero."""
    present = set(messages.columns)
    fills = {
        name: (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in present else F.lit(0.0))
        for name in [*S.SIGNAL_NAMES, "response_delay_minutes"]
    }
    return messages.withColumns(fills)


def _aggregates(size: Column) -> dict[str, Column]:
    """Feature name to aggregate over messages that carry ``size``, their (prefix) length."""
    pos, delay, length = F.col("pos"), F.col("response_delay_minutes"), F.col("message_length_chars")
    customer, business = F.col("role") == "customer", F.col("role") == "business"
    first_half = pos < F.floor(size / 2)
    second_half = ~first_half

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    def total(value: Column, where: Column) -> Column:
        return zero(F.sum(F.when(where, value)))

    def mean(value: Column, where: Column) -> Column:
        return zero(F.avg(F.when(where, value)))

    def number(where: Column) -> Column:
        return F.count_if(where).cast("double")

    def happened(flag: str, where: Column) -> Column:
        return zero(F.max(F.when(where & (F.col(flag) != 0), 1.0)))

    def last_said(flag: str) -> Column:
        return zero(F.max_by(F.col(flag), F.when(customer, pos)))

    n_customer, n_business = number(customer), number(business)
    sums = {name: total(F.col(name), customer) for name in S.SIGNAL_NAMES}
    fh_len, sh_len = mean(length, customer & first_half), mean(length, customer & second_half)
    fh_delay, sh_delay = mean(delay, first_half), mean(delay, second_half)
    all_flags = sum((F.col(f) for f in S.FLAG_NAMES), F.lit(0.0))
    return {
        "total_messages": F.count(F.lit(1)).cast("double"),
        "customer_messages": n_customer,
        "business_messages": n_business,
        "ratio_customer_to_business": ratio(n_customer, n_business),
        "mean_customer_msg_length": mean(length, customer),
        "median_customer_msg_length": zero(F.median(F.when(customer, length))),
        "std_customer_msg_length": zero(F.stddev_samp(F.when(customer, length))),
        "min_customer_msg_length": zero(F.min(F.when(customer, length))),
        "max_customer_msg_length": zero(F.max(F.when(customer, length))),
        "total_customer_chars": sums["message_length_chars"],
        "total_customer_questions": sums["question_count"],
        "total_customer_emojis": sums["emoji_count"],
        "customer_price_mentions": sums["contains_price"],
        "customer_negotiation_mentions": sums["contains_negotiation"],
        "customer_objection_mentions": sums["contains_objection"],
        "customer_commitment_mentions": sums["contains_commitment"],
        "customer_delay_signals": sums["contains_delay_signal"],
        "total_customer_bool_signals": total(all_flags, customer),
        "question_rate": ratio(sums["question_count"], n_customer),
        "emoji_rate": ratio(sums["emoji_count"], n_customer),
        "commitment_rate": ratio(sums["contains_commitment"], n_customer),
        "objection_rate": ratio(sums["contains_objection"], n_customer),
        "negotiation_rate": ratio(sums["contains_negotiation"], n_customer),
        "delay_signal_rate": ratio(sums["contains_delay_signal"], n_customer),
        "mean_response_delay_customer": mean(delay, customer),
        "median_response_delay_customer": zero(F.median(F.when(customer, delay))),
        "max_response_delay_customer": zero(F.max(F.when(customer, delay))),
        "mean_response_delay_business": mean(delay, business),
        "last_response_delay": zero(F.max_by(delay, pos)),
        "session_count": 1 + number((pos > 0) & (delay > SESSION_GAP_MINUTES)),
        "max_session_gap_minutes": F.greatest(zero(F.max(F.when(pos > 0, delay))), F.lit(0.0)),
        "first_half_commitment_count": total(F.col("contains_commitment"), customer & first_half),
        "first_half_objection_count": total(F.col("contains_objection"), customer & first_half),
        "commitment_in_second_half": happened("contains_commitment", customer & second_half),
        "objection_in_second_half": happened("contains_objection", customer & second_half),
        "price_in_second_half": happened("contains_price", customer & second_half),
        "negotiation_in_second_half": happened("contains_negotiation", customer & second_half),
        "last_role_is_customer": zero(F.max_by(customer.cast("double"), pos)),
        "last_customer_has_commitment": last_said("contains_commitment"),
        "last_customer_has_objection": last_said("contains_objection"),
        "last_customer_has_question": (last_said("question_count") > 0).cast("double"),
        "last_customer_has_delay_signal": last_said("contains_delay_signal"),
        "last_customer_has_price": last_said("contains_price"),
        "first_half_mean_customer_length": fh_len,
        "second_half_mean_customer_length": sh_len,
        "customer_length_change": sh_len - fh_len,
        "first_half_mean_response_delay": fh_delay,
        "second_half_mean_response_delay": sh_delay,
        "response_delay_change": sh_delay - fh_delay,
        "first_half_customer_message_count": number(customer & first_half),
        "second_half_customer_message_count": number(customer & second_half),
    }


def _featurize(
    messages: DataFrame, keys: Sequence[str], size: Column, names: Sequence[str]
) -> DataFrame:
    aggregates = _aggregates(size)
    return messages.groupBy(*keys).agg(*[aggregates[n].alias(n) for n in names])


def behavioral_features(messages: DataFrame, names: Sequence[str] = S.FEATURES) -> DataFrame:
    """The chosen features per conversation.

    Every aggregate combines map-side, medians included (they merge value counts), so a hot
    conversation costs one reduced row per input split.
    """
    sized = messages if "n" in messages.columns else with_key_size(messages, "conversation_id")
    return _featurize(with_signal_defaults(sized), ["conversation_id"], F.col("n"), names)


def corpus_features(corpus: DataFrame, names: Sequence[str] = S.FEATURES) -> DataFrame:
    """Features straight from a nested corpus."""
    return behavioral_features(explode_messages(corpus), names)


def prefix_features(
    messages: DataFrame,
    fractions: Sequence[float] = S.FRACTIONS,
    names: Sequence[str] = S.PURE_FEATURES,
) -> DataFrame:
    """Features of each prefix, from the messages before its cut only."""
    rows = with_prefixes(with_signal_defaults(messages), fractions)
    return _featurize(rows, ["conversation_id", "fraction"], F.col("prefix_messages"), names)


def session_numbers(messages: DataFrame, block_size: int = 1024) -> DataFrame:
    """Number each message's session; a gap over an hour starts a new one.

    Starts are counted per position block and carried over, so no task holds a whole conversation.
    """
    gap = (F.col("pos") > 0) & (F.coalesce(F.col("response_delay_minutes"), F.lit(0)) > SESSION_GAP_MINUTES)
    rows = messages.withColumn("_start", gap.cast("int")).withColumn(
        "_block", F.floor(F.col("pos") / block_size)
    )
    rows = rows.withColumn("_slot", F.struct("conversation_id", "_block"))
    blocks = rows.groupBy("_slot").agg(F.sum("_start").alias("_starts"))
    earlier = Window.partitionBy("_slot.conversation_id").orderBy("_slot._block")
    blocks = blocks.select(
        "_slot",
        F.coalesce(
            F.sum("_starts").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = Window.partitionBy("_slot").orderBy("pos")
    running = F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.join(blocks, "_slot")
        .withColumn("session", (1 + F.col("_before") + running).cast("int"))
        .drop("_block", "_slot", "_start", "_before")
    )


def feature_rows(ids: DataFrame, features: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Features of the given ids in any order; an id without features gets zeros."""
    names = [c for c in features.columns if c != key]
    return ids.join(features, key, "left").fillna(0.0, subset=names)
