"""Quality report of a batch: repeats, openings, closings, misplaced phrases, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.functions import lexicon as lx
from convsignals.functions import text as tx
from convsignals.operators.blocks import with_rank


def new_batch(corpus: DataFrame, first: int, pattern: str = r"(\d+)$") -> DataFrame:
    """Conversations whose number is at least ``first``."""
    return corpus.where(tx.id_number(F.col("conversation_id"), pattern) >= first)


def repeated(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts that occur more than once."""
    return texts.groupBy(text).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def openings(messages: DataFrame) -> DataFrame:
    """First and last text of each conversation."""
    return messages.groupBy("conversation_id").agg(
        F.min_by("text", "pos").alias("opening"), F.max_by("text", "pos").alias("closing")
    )


def message_totals(messages: DataFrame) -> DataFrame:
    """Messages, distinct texts and their share."""
    per_text = messages.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"),
        F.count(F.lit(1)).alias("unique_messages"),
        (tx.ratio(F.count(F.lit(1)), F.sum("n")) * 100).alias("unique_pct"),
    )


def gender_slash_messages(messages: DataFrame, strict: bool = False) -> DataFrame:
    return messages.where(tx.has_gender_slash(F.col("text"), strict))


def _first_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def misplaced_phrases(
    messages: DataFrame,
    phrases: Sequence[str] = tuple(lx.SERVICE_PHRASES),
    exempt: Sequence[str] = tuple(lx.HOME_DOMAINS + lx.PRODUCT_DOMAINS),
    domain: str = "domain",
) -> DataFrame:
    """Messages of other domains that hold a phrase; the first phrase of the list is reported.

    The phrase list is part of the expression, so this stays one filter over the scan.
    """
    return (
        messages.where(~F.coalesce(F.col(domain), F.lit("")).isin(*exempt))
        .withColumn("phrase", _first_phrase(F.col("text"), phrases))
        .where("phrase IS NOT NULL")
    )


def phrase_hits(messages: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """One row per message and phrase found in it."""
    found = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col("text"), p))
    return messages.withColumn("phrase", F.explode(found))


def max_id(corpus: DataFrame, pattern: str = S.ID_PATTERN) -> DataFrame:
    """Highest id number, 0 for an empty corpus."""
    return corpus.agg(
        F.coalesce(F.max(tx.id_number(F.col("conversation_id"), pattern)), F.lit(0)).alias("max_id")
    )


def allocate_ids(batch: DataFrame, existing: DataFrame, order: str, hash_digits: int = 4) -> DataFrame:
    """Give a batch the next free ids, densely and in a repeatable order.

    Rows are numbered inside hash ranges of ``order``, so no single task numbers the batch.
    """
    top = max_id(existing).scalar()
    hashed = batch.withColumn("_hash", F.md5(F.col(order).cast("string"))).withColumn("_all", F.lit(0))
    ranked = with_rank(hashed, ["_all"], ["_hash", order], F.substring("_hash", 1, hash_digits))
    return ranked.withColumn("conversation_id", tx.format_id(top + F.col("rank"), S.ID_PREFIX)).drop(
        "_hash", "_all", "rank", "rows_total"
    )


def recent_message_sample(
    messages: DataFrame, n: int = 10, last: int = 30, min_chars: int = 10, seed: int = 42
) -> DataFrame:
    """``n`` texts, by seeded hash, from the ``last`` conversations; both bounds are the feature."""
    ids = (
        messages.groupBy("conversation_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("conversation_id"))
        .limit(last)
        .select("conversation_id")
    )
    text = tx.strip(F.col("text"))
    draw = F.md5(F.concat_ws(":", F.col("conversation_id").cast("string"), F.col("pos").cast("string"), F.lit(str(seed))))
    return (
        messages.join(F.broadcast(ids), "conversation_id", "left_semi")
        .where(F.length(text) > min_chars)
        .select("conversation_id", "pos", text.alias("text"), draw.alias("_draw"))
        .orderBy("_draw")
        .limit(n)
        .drop("_draw")
    )


# ------------------------------------------ fixed values: USD per million tokens
PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-2024-08-06": (2.50, 10.00),
    "gpt-4o-2024-11-20": (2.50, 10.00),
    "gpt-4o-mini-2024-07-18": (0.15, 0.60),
    "gpt-4-turbo": (10.00, 30.00),
    "gpt-4": (30.00, 60.00),
    "o1": (15.00, 60.00),
    "o1-mini": (3.00, 12.00),
    "o3-mini": (1.10, 4.40),
    "gpt-5": (5.00, 20.00),
    "gpt-5-mini": (0.20, 0.80),
}


def run_cost(
    runs: DataFrame,
    prices: dict[str, tuple[float, float]] = PRICES,
    model: str = "model",
    tokens_in: str = "input_tokens",
    tokens_out: str = "output_tokens",
) -> DataFrame:
    """Cost per run: exact model name, else the first listed name it starts with, else null."""
    exact = [(F.col(model) == k, v) for k, v in prices.items()]
    starts = [(F.col(model).startswith(k), v) for k, v in prices.items()]
    cost = F.lit(None).cast("double")
    for test, (rate_in, rate_out) in reversed([*exact, *starts]):
        value = F.col(tokens_in) / 1e6 * rate_in + F.col(tokens_out) / 1e6 * rate_out
        cost = F.when(test, F.bround(value, 6)).otherwise(cost)
    return runs.withColumn("cost_usd", cost)
