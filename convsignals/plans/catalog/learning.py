"""Queries that train, select and score classifiers. Fits are compared by metrics, not by SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.operators import behavior as bh
from convsignals.operators import labels as lb
from convsignals.operators import metrics as mx
from convsignals.operators import models as md
from convsignals.operators import split as sp
from convsignals.operators import standardize as st
from convsignals.plans import early_detection, text_baseline
from convsignals.plans.catalog import common as c
from convsignals.session import stored
from convsignals.sources import tables as tb

FOREST_TREES = 200


def _behavior_table(spark, folder, names=S.PURE_FEATURES):
    """Features, class and split of every user."""
    messages = c.timed(spark, folder).withColumn("message_length_chars", F.length("text"))
    features = bh.behavioral_features(messages, names)
    outcome = tb.event_outcomes(tb.table(spark, folder, "events"))
    labels = outcome.select("conversation_id", lb.class_of(F.col("final_outcome"), c.OUTCOME_MAPPING).alias("label"))
    split = sp.stratified_split(labels)
    return sp.labelled_features(features, labels, split)


def labelled_feature_table(spark, folder):
    names = ["total_messages", "session_count"]
    return c.rounded(_behavior_table(spark, folder, names))


def text_classifier_metrics(spark, folder):
    run = text_baseline.run(c.labelled(spark, folder), c.QUALITY_MAPPING, "losing_interest")
    return run.metrics


def text_classifier_predictions(spark, folder):
    """Probabilities for all documents from a model trained on the labelled ones."""
    run = text_baseline.run(c.labelled(spark, folder), c.QUALITY_MAPPING, "losing_interest")
    docs = tb.text_table(spark, folder, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("raw_text"))
    return text_baseline.score_new(run.model, docs)


def behavior_classifier_metrics(spark, folder):
    table = stored(_behavior_table(spark, folder))
    chosen = md.train_and_select(table, S.PURE_FEATURES, c.CLASSES, forest_trees=FOREST_TREES)
    scored = chosen.test_predictions.withColumn("model", F.lit(chosen.chosen))
    return mx.evaluate(scored, c.CLASSES, S.POSITIVE_CLASS, ["model"])


def feature_coefficients(spark, folder):
    table = md.with_class_number(_behavior_table(spark, folder), c.CLASSES)
    train = st.standardized(table, S.PURE_FEATURES).where("split = 'train'")
    rows = md.VectorAssembler(inputCols=S.PURE_FEATURES, outputCol="features").transform(train)
    rows = stored(rows.select("features", "label_id"))
    model = md.logistic_regression(rows.count()).fit(rows)
    return md.importance_table(spark, model, S.PURE_FEATURES)


def prefix_classifier_metrics(spark, folder):
    """Early detection from behavior: metrics on the test prefixes."""
    messages = c.timed(spark, folder).withColumn("message_length_chars", F.length("text"))
    outcome = tb.event_outcomes(tb.table(spark, folder, "events"))
    labels = outcome.select("conversation_id", lb.class_of(F.col("final_outcome"), c.OUTCOME_MAPPING).alias("label"))
    table = early_detection.prefix_table(messages, labels, sp.stratified_split(labels))
    return early_detection.run(table, c.CLASSES, S.POSITIVE_CLASS, strengths=(1.0, 0.1)).metrics


def fusion_metrics(spark, folder):
    """Every embedding with the behavior of its id, zeros where there is none; the class is the half of the embedding label."""
    names = S.PURE_FEATURES
    vectors = tb.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("conversation_id"),
        "embedding",
        F.when(F.col("label") < 5, "interested").otherwise("losing_interest").alias("label"),
    )
    split = sp.stratified_split(vectors.select("conversation_id", "label")).drop("label")
    messages = c.timed(spark, folder).withColumn("message_length_chars", F.length("text"))
    table = stored(bh.feature_rows(split, bh.behavioral_features(messages, names)))
    fused = md.fusion_table(vectors, st.standardized(table, names), names, "conversation_id")
    rows = stored(md.with_class_number(fused, c.CLASSES).select("conversation_id", "label", "label_id", "split", "features"))
    width = len(rows.select("features").first()[0])
    model = md.fusion_classifier(width).fit(rows.where("split = 'train'"))
    scored = md.as_predictions(model.transform(rows.where("split = 'test'")), c.CLASSES, "conversation_id")
    return mx.evaluate(scored, c.CLASSES, S.POSITIVE_CLASS)


def _length_model():
    """A stand-in for an external text model: logits from the text length."""

    def predict(texts: np.ndarray) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], dtype="float32")
        return np.stack([sizes / 1000.0, np.ones_like(sizes)], axis=1)

    return predict


def external_model_scores(spark, folder):
    docs = tb.text_table(spark, folder, "documents").select("doc_id", "text")
    scored = md.logits_to_predictions(md.score_texts(docs, _length_model), c.CLASSES)
    return c.rounded(scored.select("doc_id", "predicted_label", *[f"probability_{n}" for n in c.CLASSES]), 4)


QUERIES = {
    f.__name__: f
    for f in [
        labelled_feature_table,
        text_classifier_metrics,
        text_classifier_predictions,
        behavior_classifier_metrics,
        feature_coefficients,
        prefix_classifier_metrics,
        fusion_metrics,
        external_model_scores,
    ]
}

ORACLES = {
    "labelled_feature_table": f"""WITH {c.TIMED}, {c.OUTCOMES},
lab AS (SELECT cid, {c.sql_class("final_outcome")} AS label FROM outcomes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(cid || ':42'), cid) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM lab),
cut AS (SELECT *, round(n * 0.15::DOUBLE) AS n_test,
  round((n - round(n * 0.15::DOUBLE)) * (0.15::DOUBLE / 0.85::DOUBLE)) AS n_val FROM ranked),
feats AS (SELECT cid, CAST(count(*) AS DOUBLE) AS total_messages,
  CAST(1 + count(*) FILTER (WHERE pos > 0 AND delay > 60) AS DOUBLE) AS session_count FROM msgs GROUP BY cid)
SELECT cid AS conversation_id, total_messages, session_count, label,
  CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val' ELSE 'train' END AS split
FROM cut JOIN feats USING (cid)""",
    "external_model_scores": """WITH x AS (SELECT doc_id, length(text) / 1000.0::FLOAT AS a FROM documents)
SELECT doc_id, CASE WHEN a >= 1 THEN 'interested' ELSE 'losing_interest' END AS predicted_label,
  round(1 / (1 + exp(1 - a::DOUBLE)), 4) AS probability_interested,
  round(1 / (1 + exp(a::DOUBLE - 1)), 4) AS probability_losing_interest FROM x""",
}
