"""Text baseline: clean, map labels, split, fit TF-IDF with logistic regression, evaluate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals.operators import labels as lb
from convsignals.operators import metrics as mx
from convsignals.operators.models import TextModel, as_predictions, fit_text_model
from convsignals.operators.split import two_way_split
from convsignals.session import stored


@dataclass
class BaselineRun:
    model: TextModel
    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame


def run(
    records: DataFrame,
    mapping: Mapping[str, Sequence[str]],
    positive: str,
    split: DataFrame | None = None,
    test: float = 0.2,
    min_per_class: int = 2,
    max_iter: int = 3000,
) -> BaselineRun:
    """``records`` has ``record_id, raw_text, raw_label``. A given split is joined on ``record_id``;
    otherwise the data are cut in two by stratified hash rank."""
    classes = sorted(mapping)
    dataset = lb.baseline_dataset(records, mapping, min_per_class)
    assigned = two_way_split(dataset, test=test) if split is None else split
    rows = stored(dataset.join(assigned.select("record_id", "split"), "record_id"))
    model = fit_text_model(rows.where("split = 'train'"), classes, max_iter=max_iter)
    held_out = rows.where("split = 'test'").select("record_id", "raw_text", "label")
    scored = model.score(held_out).join(held_out.select("record_id", "label"), "record_id")
    predictions = as_predictions(scored, classes, "record_id")
    return BaselineRun(
        model,
        predictions,
        mx.evaluate(predictions, classes, positive),
        mx.class_report(predictions, classes),
        mx.confusion_matrix(predictions, classes),
    )


def score_new(model: TextModel, texts: DataFrame) -> DataFrame:
    """Predictions for unlabelled ``record_id, raw_text`` rows."""
    return model.predict(texts)


def chosen_share(predictions: DataFrame) -> DataFrame:
    """Share of each predicted class."""
    return mx.predicted_distribution(predictions.withColumn("all", F.lit(1)), ["all"]).drop("all")
