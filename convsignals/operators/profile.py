"""Corpus profile: counts, distributions, length percentiles, feature statistics, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.functions import text as tx
from convsignals.operators.conversation import conversation_text, estimated_tokens
from convsignals.operators.percentiles import exact_percentiles

LENGTH_FRACTIONS = [0.50, 0.90, 0.95, 0.99]
TOKEN_LIMITS = [128, 256, 512]


def distributions(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(field, value, n)`` for several fields in one pass; missing values count as ``unknown``."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("field"),
                    F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value"),
                )
                for c in columns
            ]
        )
    )
    return records.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, n: int, by: str = "n", tie: str = "value") -> DataFrame:
    """Largest counts first, ties in value order."""
    return counts.orderBy(F.desc(by), tie).limit(n)


def id_counts(records: DataFrame, key: str) -> DataFrame:
    """Records, distinct ids and repeated ids."""
    per_id = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
        F.count(F.lit(1)).alias("n_unique_ids"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_ids"),
    )


def conversation_sizes(messages: DataFrame, roles: Sequence[str] = ("customer",)) -> DataFrame:
    """Per conversation: messages, customer messages, joined customer characters, blank texts."""
    mine = F.col("role").isin(*roles)
    said = mine & (F.coalesce(F.col("text"), F.lit("")) != "")
    pieces = F.count_if(said)
    return messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(mine).alias("customer_messages"),
        (
            F.coalesce(F.sum(F.when(said, F.length("text"))), F.lit(0))
            + F.greatest(pieces - 1, F.lit(0)) * len(S.SEPARATOR)
        ).alias("customer_chars"),
        F.count_if(said & (tx.strip(F.col("text")) == "")).alias("blank_texts"),
    )


def length_profile(sizes: DataFrame) -> DataFrame:
    """Minimum, nearest-rank percentiles and maximum of each size measure."""
    measures = ["total_messages", "customer_messages", "customer_chars"]
    long = sizes.select(
        *[F.col(m).cast("double").alias(m) for m in measures],
        estimated_tokens(F.col("customer_chars")).alias("estimated_tokens"),
    )
    measures = [*measures, "estimated_tokens"]
    long = long.unpivot([], measures, "measure", "value")
    ends = long.groupBy("measure").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    points = exact_percentiles(long, "measure", "value", LENGTH_FRACTIONS, "nearest")
    wide = points.groupBy("measure").agg(
        *[
            F.max(F.when(F.col("fraction") == p, F.col("percentile"))).alias(f"p{round(p * 100)}")
            for p in LENGTH_FRACTIONS
        ]
    )
    return ends.join(wide, "measure").select("measure", "min", "p50", "p90", "p95", "p99", "max")


def truncation_shares(sizes: DataFrame) -> DataFrame:
    """Share of conversations whose estimated token count passes each limit."""
    tokens = estimated_tokens(F.col("customer_chars"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.sum("blank_texts").alias("n_blank_texts"),
        *[
            (F.avg((tokens > limit).cast("double")) * 100).alias(f"pct_over_{limit}")
            for limit in TOKEN_LIMITS
        ],
    )


def missing_message_lists(corpus: DataFrame) -> DataFrame:
    """Conversations without any message in a nested corpus."""
    return corpus.agg(
        F.count_if(F.coalesce(F.size("messages"), F.lit(-1)) <= 0).alias("n_missing_messages")
    )


def feature_statistics(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, population deviation, range and quartiles of every feature."""
    long = features.unpivot([], list(names), "feature", "value")
    moments = long.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(long, "feature", "value", [0.25, 0.75])
    wide = quartiles.groupBy("feature").agg(
        F.max(F.when(F.col("fraction") == 0.25, F.col("percentile"))).alias("p25"),
        F.max(F.when(F.col("fraction") == 0.75, F.col("percentile"))).alias("p75"),
    )
    return moments.join(wide, "feature")


def signatures(messages: DataFrame, attributes: DataFrame) -> DataFrame:
    """Structure signature per conversation: attributes, size bucket, first and last role."""
    shape = messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("role", "pos").alias("first_role"),
        F.max_by("role", "pos").alias("last_role"),
    )
    known = attributes.join(shape, "conversation_id", "left")
    return known.select(
        "conversation_id",
        F.concat_ws(
            "|",
            *[F.coalesce(F.col(c), F.lit("unknown")) for c in ("domain", "interest_trajectory", "final_outcome")],
            (F.floor(F.coalesce("n", F.lit(0)) / 4) * 4).cast("string"),
            F.concat_ws(
                "-", F.coalesce("first_role", F.lit("?")), F.coalesce("last_role", F.lit("?"))
            ),
        ).alias("signature"),
    )


def signature_counts(signed: DataFrame) -> DataFrame:
    return signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def underrepresented(options: DataFrame, counts: DataFrame, key: str, slack: int = 2) -> DataFrame:
    """Options whose count is within ``slack`` of the smallest; an absent option counts 0."""
    known = options.join(counts.select(key, "n"), key, "left").fillna(0, subset=["n"])
    return known.where(F.col("n") <= known.agg(F.min("n")).scalar() + slack)


def unused_combinations(catalog: DataFrame, used: DataFrame, trajectories: Sequence[str] = S.TRAJECTORIES) -> DataFrame:
    """(domain, product, trajectory) plans of the catalog that no conversation has used."""
    plans = catalog.withColumn("trajectory", F.explode(F.array(*[F.lit(t) for t in trajectories])))
    return plans.join(used, ["domain", "product", "trajectory"], "left_anti")
