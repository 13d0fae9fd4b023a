"""Classification metrics from a small confusion table, per model and prefix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convsignals.functions.text import ratio

METRICS = [
    "accuracy",
    "precision",
    "recall",
    "f1",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "weighted_precision",
    "weighted_recall",
    "weighted_f1",
]


def confusion_counts(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per (keys, actual, predicted): the only pass over the predictions."""
    return predictions.groupBy(*keys, "actual_label", "predicted_label").agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    predictions: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Every actual x predicted cell in label order, empty ones as 0."""
    names = F.array(*[F.lit(x) for x in labels])
    counts = confusion_counts(predictions, keys)
    cells = [
        F.struct(
            F.lit(a).alias("actual_label"),
            F.lit(p).alias("predicted_label"),
            F.coalesce(
                F.sum(F.when((F.col("actual_label") == a) & (F.col("predicted_label") == p), F.col("n"))),
                F.lit(0),
            ).alias("n"),
        )
        for a in labels
        for p in labels
    ]
    return (
        counts.where(F.array_contains(names, F.col("actual_label")))
        .groupBy(*keys)
        .agg(F.array(*cells).alias("cells"))
        .select(*keys, F.inline("cells"))
    )


def _per_class(labels: Sequence[str]) -> dict[str, dict[str, Column]]:
    n, actual, predicted = F.col("n"), F.col("actual_label"), F.col("predicted_label")

    def cell_sum(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("double")

    out = {}
    for label in labels:
        hit = cell_sum((actual == label) & (predicted == label))
        guessed, support = cell_sum(predicted == label), cell_sum(actual == label)
        out[label] = {
            "precision": ratio(hit, guessed),
            "recall": ratio(hit, support),
            "f1": ratio(2 * hit, guessed + support),
            "support": support,
            "present": ((guessed + support) > 0).cast("double"),
        }
    return out


def class_report(predictions: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    stats = _per_class(labels)
    rows = [
        F.struct(
            F.lit(label).alias("label"),
            *[stats[label][m].alias(m) for m in ("precision", "recall", "f1")],
            stats[label]["support"].cast("long").alias("support"),
        )
        for label in labels
    ]
    return (
        confusion_counts(predictions, keys)
        .groupBy(*keys)
        .agg(F.array(*rows).alias("rows"))
        .select(*keys, F.inline("rows"))
    )


def evaluate(
    predictions: DataFrame,
    labels: Sequence[str],
    positive: str,
    keys: Sequence[str] = (),
    fixed_classes: bool = False,
) -> DataFrame:
    """One row of metrics per key.

    Precision, recall and F1 without prefix are those of the positive class. Macro values average
    the classes that occur, or all given ones with ``fixed_classes``. Empty denominators give 0.
    """
    stats = _per_class(labels)
    n = F.sum("n").cast("double")

    def add(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, columns)

    present = (
        F.lit(float(len(labels))) if fixed_classes else add([stats[c]["present"] for c in labels])
    )

    def macro(m: str) -> Column:
        return ratio(add([stats[c][m] for c in labels]), present)

    def weighted(m: str) -> Column:
        return ratio(
            add([stats[c][m] * stats[c]["support"] for c in labels]),
            add([stats[c]["support"] for c in labels]),
        )

    hits = F.sum(F.when(F.col("actual_label") == F.col("predicted_label"), F.col("n")))
    values = {
        "accuracy": ratio(hits, n),
        **{m: stats[positive][m] for m in ("precision", "recall", "f1")},
        **{f"macro_{m}": macro(m) for m in ("precision", "recall", "f1")},
        **{f"weighted_{m}": weighted(m) for m in ("precision", "recall", "f1")},
    }
    return (
        confusion_counts(predictions, keys)
        .groupBy(*keys)
        .agg(*[values[m].alias(m) for m in METRICS], F.sum("n").alias("n"))
    )


def as_rows(metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """Wide metrics to ``(keys, metric, value)`` rows."""
    return metrics.unpivot(list(keys), list(names), "metric", "value")


def cross_entropy(predictions: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean negative log of the probability given to the true class."""
    truth = reduce(
        lambda acc, name: F.when(F.col("actual_label") == name, F.col(f"probability_{name}")).otherwise(acc),
        labels,
        F.lit(None).cast("double"),
    )
    loss = -F.log(F.greatest(truth, F.lit(1e-15)))
    return predictions.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def predicted_distribution(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each predicted class per key."""
    counts = predictions.groupBy(*keys, "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", F.col("n") / total * 100)


def selection_metric(metrics: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Mean macro F1 over the chosen prefixes, 0 when none of them was measured."""
    chosen = F.when(F.col("fraction").isin(*fractions), F.col("macro_f1"))
    return metrics.groupBy("model").agg(F.coalesce(F.avg(chosen), F.lit(0.0)).alias("selection"))


def metric_gain(metrics: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Gain over the previous prefix, in percentage points."""
    before = Window.partitionBy("model").orderBy("fraction")
    return metrics.select(
        "model",
        F.lag("fraction").over(before).alias("from_fraction"),
        F.col("fraction").alias("to_fraction"),
        ((F.col(metric) - F.lag(metric).over(before)) * 100).alias("gain_pp"),
    ).where("from_fraction IS NOT NULL")


# --------------------------------------------- fixed values: reported thresholds
THRESHOLDS: dict[str, list[tuple[str, float]]] = {
    "macro_f1_0.70": [("macro_f1", 0.70)],
    "macro_f1_0.80": [("macro_f1", 0.80)],
    "macro_f1_0.90": [("macro_f1", 0.90)],
    "macro_f1_0.95": [("macro_f1", 0.95)],
    "recall_0.90": [("recall", 0.90)],
    "recall_0.90_precision_0.80": [("recall", 0.90), ("precision", 0.80)],
}


def earliest_reaching(
    metrics: DataFrame, thresholds: Mapping[str, Sequence[tuple[str, float]]] = THRESHOLDS
) -> DataFrame:
    """First prefix at which all conditions of a threshold hold, else ``not reached``."""

    def first(conditions: Sequence[tuple[str, float]]) -> Column:
        met = reduce(lambda a, b: a & b, [F.col(m) >= v for m, v in conditions])
        pct = F.min(F.when(met, F.col("fraction"))) * 100
        return F.coalesce(F.concat(pct.cast("int").cast("string"), F.lit("%")), F.lit("not reached"))

    rows = [
        F.struct(F.lit(name).alias("threshold"), first(c).alias("earliest"))
        for name, c in thresholds.items()
    ]
    return metrics.groupBy("model").agg(F.array(*rows).alias("r")).select("model", F.inline("r"))


def compare(a: DataFrame, b: DataFrame, on: Sequence[str] = ("fraction", "metric")) -> DataFrame:
    """Metric rows of A beside those of B with the difference in points; a missing B is null."""
    right = b.select(*on, F.col("value").alias("value_b"))
    return (
        a.withColumnRenamed("value", "value_a")
        .join(right, list(on), "left")
        .withColumn("delta_pp", (F.col("value_b") - F.col("value_a")) * 100)
    )


def matches_stored(
    metrics: DataFrame, stored: DataFrame, on: Sequence[str], tolerance: float = 0.002
) -> DataFrame:
    """Whether each metric is within the tolerance of a stored value."""
    return metrics.join(stored.withColumnRenamed("value", "stored"), list(on)).withColumn(
        "matches", F.abs(F.col("value") - F.col("stored")) < tolerance
    )


def best_model(metrics: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Model with the highest metric; the alphabetically first on ties."""
    return metrics.orderBy(F.desc(metric), "model").limit(1)
