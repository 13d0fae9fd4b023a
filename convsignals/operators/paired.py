"""Paired comparison of two models on the same conversations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convsignals.functions.text import ratio

KEYS = ["conversation_id", "fraction"]
REPLICATES, BOOTSTRAP_SEED, CHUNK = 10_000, 42, 500


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Predictions of both models side by side, with the outcome category."""
    carried = ["predicted_label", "probability_interested", "probability_losing_interest", "correct"]
    left = a.select(*KEYS, "actual_label", *[F.col(c).alias(f"{c}_a") for c in carried])
    right = b.select(*KEYS, *[F.col(c).alias(f"{c}_b") for c in carried])
    right_a, right_b = F.col("correct_a") == 1, F.col("correct_b") == 1
    return left.join(right, KEYS).withColumn(
        "category",
        F.when(right_a & right_b, "both_right")
        .when(~right_a & right_b, "fix")
        .when(right_a & ~right_b, "regression")
        .otherwise("both_wrong"),
    )


def pairing_report(a: DataFrame, b: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Per fraction: row counts, duplicate ids, one-sided ids and differing true labels."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*KEYS).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.min("actual_label").alias(f"truth_{tag}")
        )

    both = side(a, "a").join(side(b, "b"), KEYS, "full_outer")
    out = both.groupBy("fraction").agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"),
        F.count_if(F.col("n_a") > 1).alias("duplicate_a"),
        F.count_if(F.col("n_b") > 1).alias("duplicate_b"),
        F.count_if(F.col("n_b").isNull()).alias("only_a"),
        F.count_if(F.col("n_a").isNull()).alias("only_b"),
        F.count_if(F.col("truth_a") != F.col("truth_b")).alias("label_mismatch"),
    )
    sound = (
        F.col("duplicate_a") + F.col("duplicate_b") + F.col("only_a") + F.col("only_b") + F.col("label_mismatch")
    ) == 0
    if expected_rows is not None:
        sound = sound & (F.col("rows_a") == expected_rows) & (F.col("rows_b") == expected_rows)
    return out.withColumn("paired", sound)


def outcome_counts(pairs: DataFrame) -> DataFrame:
    """Fixes, regressions, shared errors and successes per fraction."""

    def of(name: str) -> Column:
        return F.count_if(F.col("category") == name)

    return pairs.groupBy("fraction").agg(
        of("fix").alias("n_fixes"),
        of("regression").alias("n_regressions"),
        of("both_wrong").alias("n_both_wrong"),
        of("both_right").alias("n_both_right"),
        (of("fix") - of("regression")).alias("net_corrected"),
    )


def error_rows(pairs: DataFrame) -> DataFrame:
    """Every conversation at least one model got wrong."""
    return pairs.where("category <> 'both_right'").select(
        "fraction", "category", "conversation_id", "actual_label", "predicted_label_a", "predicted_label_b"
    )


def confidence_groups(pairs: DataFrame) -> DataFrame:
    """Mean confidence of each model by outcome group, null for an empty group."""

    def rows(tag: str) -> Column:
        confidence = F.greatest(f"probability_interested_{tag}", f"probability_losing_interest_{tag}")
        right = F.col(f"correct_{tag}") == 1

        def mean(where: Column) -> Column:
            return F.bround(F.avg(F.when(where, confidence)), 4)

        return F.struct(
            F.lit(tag).alias("model"),
            mean(right).alias("correct"),
            mean(~right).alias("incorrect"),
            mean(F.col("category") == "fix").alias("fixes"),
            mean(F.col("category") == "regression").alias("regressions"),
        )

    return (
        pairs.groupBy("fraction")
        .agg(F.array(rows("a"), rows("b")).alias("r"))
        .select("fraction", F.inline("r"))
    )


# ------------------------------------------------------------- macro F1 cells
def outcome_cells(pairs: DataFrame, positive: str) -> DataFrame:
    """Eight counts per fraction, one per (truth, A, B): all that macro F1 depends on.

    Cell number = 4*truth + 2*A + B, each 1 for the positive class.
    """

    def bit(name: str) -> Column:
        return (F.col(name) == positive).cast("int")

    cell = 4 * bit("actual_label") + 2 * bit("predicted_label_a") + bit("predicted_label_b")
    counts = pairs.groupBy("fraction", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("fraction").agg(
        F.array(
            *[F.coalesce(F.sum(F.when(F.col("cell") == i, F.col("n"))), F.lit(0)) for i in range(8)]
        ).alias("cells")
    )


def _cell_f1(cells: Column, shift: int) -> Column:
    """Macro F1 of the model whose prediction is bit ``shift`` of the cell number."""

    def total(test) -> Column:
        chosen = [cells[i] for i in range(8) if test(i >> 2 & 1, i >> shift & 1)]
        return sum(chosen[1:], chosen[0])

    scores = []
    for c in (0, 1):
        hit = total(lambda y, p, c=c: y == c and p == c)
        wrong = total(lambda y, p, c=c: (y == c) != (p == c))
        scores.append(ratio(2 * hit, 2 * hit + wrong))
    return (scores[0] + scores[1]) / 2


def observed_delta(cells: DataFrame) -> DataFrame:
    """Macro F1 over both classes for each model, and B minus A."""
    f1_a, f1_b = _cell_f1(F.col("cells"), 1), _cell_f1(F.col("cells"), 0)
    return cells.select(
        "fraction",
        F.bround(f1_a, 4).alias("macro_f1_a"),
        F.bround(f1_b, 4).alias("macro_f1_b"),
        F.bround(f1_b - f1_a, 4).alias("observed_delta"),
    )


def _macro_f1(draws: np.ndarray, shift: int) -> np.ndarray:
    truth = np.arange(8) >> 2 & 1
    guess = np.arange(8) >> shift & 1
    scores = []
    for c in (0, 1):
        hit = draws[:, (truth == c) & (guess == c)].sum(axis=1)
        wrong = draws[:, (truth == c) != (guess == c)].sum(axis=1)
        below = 2 * hit + wrong
        scores.append(np.where(below > 0, 2 * hit / np.maximum(below, 1), 0.0))
    return (scores[0] + scores[1]) / 2


def bootstrap_deltas(
    cells: DataFrame, replicates: int = REPLICATES, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """Macro-F1 difference of each bootstrap replicate.

    Resampling n paired rows with replacement is one multinomial draw over the eight cells, so the
    cost does not depend on the number of predictions. Chunks of replicates run as separate tasks.
    """
    chunks = -(-replicates // CHUNK)
    tasks = cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(
        F.col("fraction"), F.col("chunk")
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fraction, counts, chunk in zip(batch["fraction"], batch["cells"], batch["chunk"]):
                counts = np.asarray(counts, dtype=np.int64)
                size = min(CHUNK, replicates - chunk * CHUNK)
                rng = np.random.default_rng([seed, round(fraction * 10_000), chunk])
                draws = rng.multinomial(counts.sum(), counts / counts.sum(), size=size)
                yield pd.DataFrame(
                    {
                        "fraction": fraction,
                        "replicate": chunk * CHUNK + np.arange(size),
                        "delta": _macro_f1(draws, 0) - _macro_f1(draws, 1),
                    }
                )

    return tasks.mapInPandas(draw, "fraction double, replicate long, delta double")


def bootstrap_summary(deltas: DataFrame) -> DataFrame:
    """Mean, 95 % interval and share of positive differences per fraction.

    The replicate count is a parameter, so the exact percentile holds a bounded set of values.
    """
    low, high = F.percentile("delta", F.lit(0.025)), F.percentile("delta", F.lit(0.975))
    return deltas.groupBy("fraction").agg(
        F.bround(F.avg("delta"), 4).alias("bootstrap_mean_delta"),
        F.bround(low, 4).alias("ci_95_lo"),
        F.bround(high, 4).alias("ci_95_hi"),
        F.bround(F.avg((F.col("delta") > 0).cast("double")), 4).alias("prop_b_gt_a"),
        F.count(F.lit(1)).alias("n_bootstrap"),
    )


# -------------------------------------------------------------------- McNemar
def exact_sign_p(b: int, c: int) -> float:
    """Two-sided exact binomial p at 1/2, summed from the largest tail term down."""
    n, k = b + c, min(b, c)
    if n == 0 or b == c:
        return 1.0
    log_top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0)
    total, term = 0.0, 1.0
    while k >= 0 and term > 1e-18:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2.0 * math.exp(log_top) * total)


@F.pandas_udf(T.DoubleType())
def sign_test_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([exact_sign_p(int(x), int(y)) for x, y in zip(b, c)])


def mcnemar(counts: DataFrame) -> DataFrame:
    """Exact test on the disagreements: b = regressions, c = fixes. No disagreement gives p = 1."""
    b, c = F.col("n_regressions"), F.col("n_fixes")
    table = counts.select(
        "fraction", b.alias("b"), c.alias("c"), (b + c).alias("n_disagreements"), sign_test_p(b, c).alias("p")
    )
    corrected = F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0))
    return table.select(
        "fraction",
        "b",
        "c",
        "n_disagreements",
        "p",
        F.bround("p", 6).alias("p_value"),
        F.bround(F.try_divide(corrected, F.col("n_disagreements").cast("double")), 4).alias("chi2"),
        (F.col("p") < 0.05).alias("significant_05"),
        (F.col("p") < 0.01).alias("significant_01"),
    )


def summary(observed: DataFrame, bootstrap: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per fraction with all statistics and the verdict."""
    return with_verdict(observed.join(bootstrap, "fraction").join(tests.drop("p"), "fraction"))


def with_verdict(table: DataFrame) -> DataFrame:
    """Sign of the interval and the conclusion it supports together with the test."""
    low, high = F.col("ci_95_lo"), F.col("ci_95_hi")
    delta, significant = F.col("observed_delta"), F.col("significant_05")
    return table.withColumns(
        {
            "ci_sign": F.when(low >= 0, "+").when((low < 0) & (high > 0), "~").otherwise("-"),
            "verdict": F.when(significant & (low > 0), "significant_improvement")
            .when(significant & (low < 0), "significant_direction_uncertain")
            .when(~significant & (delta > 0), "positive_inconclusive")
            .when(~significant & (delta < 0), "negative_not_significant")
            .otherwise("no_difference"),
        }
    )


def ablation_case(fused: Column, text_only: Column, threshold_pp: float = 1.0) -> Column:
    """A: extra training explains the gain; B: behavior adds signal; C: no benefit."""
    gain = (fused - text_only) * 100
    return F.when(F.abs(gain) < threshold_pp, "A").when(gain > threshold_pp, "B").otherwise("C")
