"""Early detection: how well a conversation's outcome shows in its first part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.base import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.operators import metrics as mx
from convsignals.operators.behavior import prefix_features
from convsignals.operators.models import as_predictions, logistic_regression, with_class_number
from convsignals.operators.standardize import apply_scaler, fit_scaler
from convsignals.session import stored

SELECTION_FRACTIONS = [0.25, 0.50, 0.75]


@dataclass
class PrefixRun:
    model: Model
    selection: float
    predictions: DataFrame
    metrics: DataFrame


def prefix_table(
    messages: DataFrame, labels: DataFrame, split: DataFrame, fractions: Sequence[float] = S.FRACTIONS
) -> DataFrame:
    """Features of every prefix with label and split; all prefixes of one id share both."""
    features = prefix_features(messages, fractions)
    return features.join(labels, "conversation_id").join(
        split.select("conversation_id", "split"), "conversation_id"
    )


def run(
    table: DataFrame,
    classes: Sequence[str],
    positive: str,
    strengths: Sequence[float] = (1.0,),
    names: Sequence[str] = S.PURE_FEATURES,
    model_name: str = "behavior",
) -> PrefixRun:
    """Fit on all training prefixes, select by mean macro F1 over the early validation prefixes,
    and score the test prefixes once. Scaler and fits see training rows only."""
    S.assert_no_leakage(table.select("fraction", "split", *names))
    scaler = fit_scaler(table.where("split = 'train'"), names)
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    rows = assembler.transform(apply_scaler(with_class_number(table, classes), scaler, names))
    rows = stored(rows.select("conversation_id", "fraction", "label", "label_id", "split", "features"))
    train = rows.where("split = 'train'")
    n = train.count()

    def predictions(model: Model, part: str) -> DataFrame:
        scored = as_predictions(
            model.transform(rows.where(F.col("split") == part)), classes, "conversation_id", keep=["fraction"]
        )
        return scored.withColumn("model", F.lit(model_name))

    best, best_score = None, -1.0
    for c in strengths:
        model = logistic_regression(n, c).fit(train)
        by_prefix = mx.evaluate(predictions(model, "val"), sorted(classes), positive, ["model", "fraction"])
        score = mx.selection_metric(by_prefix, SELECTION_FRACTIONS).first()["selection"]
        if score > best_score:
            best, best_score = model, score
    test = predictions(best, "test")
    return PrefixRun(
        best, best_score, test, mx.evaluate(test, sorted(classes), positive, ["model", "fraction"])
    )
