"""Queries on labels, splits, classification metrics and paired comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from convsignals.functions import text as tx
from convsignals.operators import conversation as cv
from convsignals.operators import labels as lb
from convsignals.operators import metrics as mx
from convsignals.operators import paired as pr
from convsignals.operators import split as sp
from convsignals.plans import model_comparison
from convsignals.plans.catalog import common as c
from convsignals.plans.catalog.messages import clean_sql
from convsignals.sources import tables as tb

KEYS = ["model", "fraction"]
# A mapping that leaves some outcomes unmapped.
PARTIAL = {"interested": ["converted", "pending"], "losing_interest": ["ghosted"]}
POSITIVE = "losing_interest"


def _records(spark, folder):
    """Every document with its label where it has one, and whether it is in the subset."""
    docs = tb.text_table(spark, folder, "documents")
    labels = tb.table(spark, folder, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("record_id"),
        F.col("text").alias("raw_text"),
        F.col("quality").cast("string").alias("raw_label"),
        "lang",
        "toxic",
    )


def skip_reasons(spark, folder):
    rows = _records(spark, folder).withColumn("in_subset", F.col("lang") != "es")
    marked = lb.with_skip_reason(rows, {"good": ["1"]}, text="raw_text", in_subset="in_subset")
    return lb.skip_counts(marked)


def baseline_dataset(spark, folder):
    rows = _records(spark, folder)
    return lb.baseline_dataset(rows, c.QUALITY_MAPPING, phones=False).select(
        "record_id", "cleaned_text", "raw_label", "label"
    )


def label_distribution(spark, folder):
    return lb.label_distribution(_outcomes(spark, folder), PARTIAL, "final_outcome")


def class_distribution(spark, folder):
    return c.rounded(lb.class_distribution(_outcomes(spark, folder), PARTIAL, "final_outcome"))


def _outcomes(spark, folder):
    return tb.event_outcomes(tb.table(spark, folder, "events"))


def min_class_filter(spark, folder):
    """Documents whose (language, label) class has at least 20 labelled members."""
    rows = c.labelled(spark, folder).select(
        "record_id", F.concat_ws(":", "lang", "raw_label", F.col("toxic").cast("string")).alias("label")
    )
    return lb.keep_large_classes(rows, 20)


def class_id_map(spark, folder):
    rows = _outcomes(spark, folder)
    label = lb.class_of(F.col("final_outcome"), c.OUTCOME_MAPPING)
    return c.rounded(
        rows.select("conversation_id", label.alias("label")).withColumn(
            "label_id", lb.class_id_of(F.col("label"), c.OUTCOME_MAPPING)
        )
    )


def _labels(spark, folder):
    return c.labelled(spark, folder).select("record_id", lb.class_of(F.col("raw_label"), c.QUALITY_MAPPING).alias("label"))


def stratified_split(spark, folder):
    return sp.stratified_split(_labels(spark, folder), "record_id")


def two_way_split(spark, folder):
    return sp.two_way_split(_labels(spark, folder))


def split_statistics(spark, folder):
    return c.rounded(sp.split_statistics(stratified_split(spark, folder)))


def split_overlap(spark, folder):
    """Overlap of a faulty assignment: copies of one text may fall into different splits."""
    ids = stratified_split(spark, folder).join(
        tb.text_table(spark, folder, "documents").select(F.col("doc_id").alias("record_id"), F.md5("text").alias("text_key")),
        "record_id",
    )
    return c.rounded(sp.overlapping_ids(ids, "text_key"))


def split_intersections(spark, folder):
    return sp.split_intersections(stratified_split(spark, folder), "record_id")


def split_restricted(spark, folder):
    test = stratified_split(spark, folder).where("split = 'test'")
    return sp.restrict(c.labelled(spark, folder), test, "record_id").select("record_id", "raw_label", "n_chars")


def augmentation_statistics(spark, folder):
    rows = stratified_split(spark, folder).withColumnRenamed("record_id", "conversation_id")
    return cv.augmentation_statistics(cv.augment(rows))


def join_losses(spark, folder):
    """Split ids without features (a user's events) or label."""
    from convsignals.operators.behavior import behavioral_features

    features = behavioral_features(c.timed(spark, folder), ["total_messages"])
    split = sp.stratified_split(_labels(spark, folder), "record_id").withColumnRenamed("record_id", "conversation_id")
    labels = tb.table(spark, folder, "labels").where("toxic = 0").select(F.col("doc_id").alias("conversation_id"))
    return sp.join_losses(features, labels, split)


def feature_rows_filled(spark, folder):
    from convsignals.operators.behavior import behavioral_features, feature_rows

    features = behavioral_features(c.timed(spark, folder), ["total_messages", "session_count"])
    ids = tb.table(spark, folder, "labels").select(F.col("doc_id").alias("conversation_id"))
    return c.rounded(feature_rows(ids, features))


def confusion_matrix(spark, folder):
    return mx.confusion_matrix(c.predictions(spark, folder), c.CLASSES, KEYS)


def class_report(spark, folder):
    return c.rounded(mx.class_report(c.predictions(spark, folder), c.CLASSES, KEYS))


def _metrics(spark, folder):
    return mx.evaluate(c.predictions(spark, folder), c.CLASSES, POSITIVE, KEYS)


def metrics_by_fraction(spark, folder):
    return c.rounded(_metrics(spark, folder))


def cross_entropy(spark, folder):
    return c.rounded(mx.cross_entropy(c.predictions(spark, folder), c.CLASSES, KEYS))


def predicted_distribution(spark, folder):
    return c.rounded(mx.predicted_distribution(c.predictions(spark, folder), KEYS))


def selection_metric(spark, folder):
    return c.rounded(mx.selection_metric(_metrics(spark, folder)))


def metric_gain(spark, folder):
    return c.rounded(mx.metric_gain(_metrics(spark, folder)))


THRESHOLDS = {
    "macro_f1_0.40": [("macro_f1", 0.40)],
    "accuracy_0.60": [("accuracy", 0.60)],
    "recall_0.60_precision_0.10": [("recall", 0.60), ("precision", 0.10)],
    "macro_f1_0.95": [("macro_f1", 0.95)],
}


def earliest_threshold(spark, folder):
    return mx.earliest_reaching(_metrics(spark, folder), THRESHOLDS)


def experiment_comparison(spark, folder):
    rows = mx.as_rows(_metrics(spark, folder), KEYS)
    a = rows.where("model = 'A'").drop("model")
    b = rows.where("model = 'B' AND fraction > 0.3").drop("model")
    return c.rounded(mx.compare(a, b))


def stored_metric_check(spark, folder):
    """Model A's metrics against model B's as the stored values."""
    rows = mx.as_rows(_metrics(spark, folder), KEYS, ["accuracy", "macro_f1"])
    stored = rows.where("model = 'B'").drop("model")
    return c.rounded(mx.matches_stored(rows.where("model = 'A'").drop("model"), stored, ["fraction", "metric"], 0.1))


def best_models(spark, folder):
    return c.rounded(mx.best_model(_metrics(spark, folder).where("fraction = 1.0")).select("model", "macro_f1"))


def _pairs(spark, folder):
    p = c.predictions(spark, folder)
    return pr.pair(p.where("model = 'A'"), p.where("model = 'B'"))


def pairing_check(spark, folder):
    """Pairing of a complete A with a B that was never run on toxic documents."""
    p = c.predictions(spark, folder)
    clean = tb.table(spark, folder, "labels").where("toxic = 0").select(F.col("doc_id").alias("conversation_id"))
    return pr.pairing_report(p.where("model = 'A'"), sp.restrict(p.where("model = 'B'"), clean))


def outcome_categories(spark, folder):
    return pr.outcome_counts(_pairs(spark, folder))


def paired_errors(spark, folder):
    return pr.error_rows(_pairs(spark, folder))


def confidence_groups(spark, folder):
    return c.rounded(pr.confidence_groups(_pairs(spark, folder)))


def mcnemar(spark, folder):
    """The shift keeps exact binary fractions off the rounding edge in both engines."""
    tests = pr.mcnemar(pr.outcome_counts(_pairs(spark, folder)))
    return c.rounded(tests.withColumn("p_value", F.col("p") + 1e-12).drop("p"))


def observed_delta(spark, folder):
    return c.rounded(pr.observed_delta(pr.outcome_cells(_pairs(spark, folder), POSITIVE)))


def paired_bootstrap(spark, folder):
    cells = pr.outcome_cells(_pairs(spark, folder), POSITIVE)
    return pr.bootstrap_summary(pr.bootstrap_deltas(cells))


def model_comparison_summary(spark, folder):
    p = c.predictions(spark, folder)
    return model_comparison.run(p.where("model = 'A'"), p.where("model = 'B'")).summary


def ablation_case(spark, folder):
    m = _metrics(spark, folder)
    by_prefix = m.groupBy("fraction").agg(
        F.max(F.when(F.col("model") == "A", F.col("macro_f1"))).alias("text_only"),
        F.max(F.when(F.col("model") == "B", F.col("macro_f1"))).alias("fused"),
    )
    return by_prefix.select("fraction", pr.ablation_case(F.col("fused"), F.col("text_only")).alias("case_name"))


def percent_tags(spark, folder):
    p = c.predictions(spark, folder)
    return p.groupBy(tx.percent_tag(F.col("fraction")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in [
        skip_reasons,
        baseline_dataset,
        label_distribution,
        class_distribution,
        min_class_filter,
        class_id_map,
        stratified_split,
        two_way_split,
        split_statistics,
        split_overlap,
        split_intersections,
        split_restricted,
        augmentation_statistics,
        join_losses,
        feature_rows_filled,
        confusion_matrix,
        class_report,
        metrics_by_fraction,
        cross_entropy,
        predicted_distribution,
        selection_metric,
        metric_gain,
        earliest_threshold,
        experiment_comparison,
        stored_metric_check,
        best_models,
        pairing_check,
        outcome_categories,
        paired_errors,
        confidence_groups,
        mcnemar,
        observed_delta,
        paired_bootstrap,
        model_comparison_summary,
        ablation_case,
        percent_tags,
    ]
}

_RECORDS = """recs AS (SELECT d.doc_id AS record_id, text AS raw_text,
  CAST(quality AS VARCHAR) AS raw_label, lang, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_QUALITY = "CASE quality WHEN 1 THEN 'interested' ELSE 'losing_interest' END"
_LABELS = f"lab AS (SELECT l.doc_id AS record_id, {_QUALITY} AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_SPLIT = f"""{_LABELS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(record_id || ':42'), record_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM lab),
cut AS (SELECT *, round(n * 0.15::DOUBLE) AS n_test, round((n - round(n * 0.15::DOUBLE)) * (0.15::DOUBLE / 0.85::DOUBLE)) AS n_val FROM ranked),
split AS (SELECT record_id, label, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM cut)"""
_METRICS = f"""{c.PREDICTIONS},
cells AS (SELECT model, fraction, count(*) AS n,
  count(*) FILTER (WHERE actual_label = predicted_label) AS hits,
  count(*) FILTER (WHERE actual_label = 'interested' AND predicted_label = 'interested')::DOUBLE AS tp_i,
  count(*) FILTER (WHERE predicted_label = 'interested')::DOUBLE AS p_i,
  count(*) FILTER (WHERE actual_label = 'interested')::DOUBLE AS s_i,
  count(*) FILTER (WHERE actual_label = 'losing_interest' AND predicted_label = 'losing_interest')::DOUBLE AS tp_l,
  count(*) FILTER (WHERE predicted_label = 'losing_interest')::DOUBLE AS p_l,
  count(*) FILTER (WHERE actual_label = 'losing_interest')::DOUBLE AS s_l
  FROM preds GROUP BY ALL),
cls AS (SELECT *, CASE WHEN p_i = 0 THEN 0 ELSE tp_i / p_i END AS prec_i, CASE WHEN s_i = 0 THEN 0 ELSE tp_i / s_i END AS rec_i,
  CASE WHEN p_i + s_i = 0 THEN 0 ELSE 2 * tp_i / (p_i + s_i) END AS f1_i,
  CASE WHEN p_l = 0 THEN 0 ELSE tp_l / p_l END AS prec_l, CASE WHEN s_l = 0 THEN 0 ELSE tp_l / s_l END AS rec_l,
  CASE WHEN p_l + s_l = 0 THEN 0 ELSE 2 * tp_l / (p_l + s_l) END AS f1_l,
  CASE WHEN p_i + s_i > 0 THEN 1 ELSE 0 END + CASE WHEN p_l + s_l > 0 THEN 1 ELSE 0 END AS k FROM cells),
metrics AS (SELECT model, fraction, n, hits / n AS accuracy, prec_l AS precision, rec_l AS recall, f1_l AS f1,
  (prec_i + prec_l) / k AS macro_precision, (rec_i + rec_l) / k AS macro_recall, (f1_i + f1_l) / k AS macro_f1,
  (prec_i * s_i + prec_l * s_l) / n AS weighted_precision, (rec_i * s_i + rec_l * s_l) / n AS weighted_recall,
  (f1_i * s_i + f1_l * s_l) / n AS weighted_f1 FROM cls)"""
_ROWS = f"{_METRICS}, mrows AS (UNPIVOT metrics ON {', '.join(mx.METRICS)} INTO NAME metric VALUE value)"
_PAIRS = f"""{c.PREDICTIONS},
pairs AS (SELECT a.fraction, a.conversation_id, a.actual_label, a.predicted_label AS predicted_label_a,
  b.predicted_label AS predicted_label_b, a.correct AS ca, b.correct AS cb,
  greatest(a.probability_interested, a.probability_losing_interest) AS conf_a,
  greatest(b.probability_interested, b.probability_losing_interest) AS conf_b,
  CASE WHEN a.correct = 1 AND b.correct = 1 THEN 'both_right' WHEN b.correct = 1 THEN 'fix'
    WHEN a.correct = 1 THEN 'regression' ELSE 'both_wrong' END AS category
  FROM preds a JOIN preds b ON a.conversation_id = b.conversation_id AND a.fraction = b.fraction
    AND a.model = 'A' AND b.model = 'B')"""


def _conf(tag: str) -> str:
    return f"""SELECT fraction, '{tag}' AS model, round_even(avg(conf_{tag}) FILTER (WHERE c{tag} = 1), 4) AS correct,
  round_even(avg(conf_{tag}) FILTER (WHERE c{tag} = 0), 4) AS incorrect,
  round_even(avg(conf_{tag}) FILTER (WHERE category = 'fix'), 4) AS fixes,
  round_even(avg(conf_{tag}) FILTER (WHERE category = 'regression'), 4) AS regressions FROM pairs GROUP BY fraction"""


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in mx.METRICS)
_COUNTS = """count(*) FILTER (WHERE category = 'fix') AS n_fixes,
  count(*) FILTER (WHERE category = 'regression') AS n_regressions,
  count(*) FILTER (WHERE category = 'both_wrong') AS n_both_wrong,
  count(*) FILTER (WHERE category = 'both_right') AS n_both_right"""

ORACLES = {
    "baseline_dataset": f"""WITH {_RECORDS}, cl AS (SELECT record_id, {clean_sql("coalesce(raw_text, '')", False)} AS cleaned_text, raw_label,
  CASE raw_label WHEN '1' THEN 'interested' WHEN '0' THEN 'losing_interest' END AS label FROM recs)
SELECT * FROM cl WHERE label IS NOT NULL AND cleaned_text <> '' QUALIFY count(*) OVER (PARTITION BY label) >= 2""",
    "skip_reasons": f"""WITH {_RECORDS}
SELECT CASE WHEN lang = 'es' THEN 'not_in_subset' WHEN raw_label IS NULL THEN 'missing_label'
  WHEN raw_label <> '1' THEN 'unmapped_label' WHEN trim(coalesce(raw_text, '')) = '' THEN 'empty_text'
  ELSE 'kept' END AS reason, count(*) AS n FROM recs GROUP BY 1""",
    "label_distribution": f"""WITH {c.OUTCOMES}
SELECT final_outcome AS raw_label, coalesce({c.sql_class("final_outcome", PARTIAL)}, 'UNMAPPED') AS label, count(*) AS n
FROM outcomes GROUP BY 1, 2""",
    "class_distribution": f"""WITH {c.OUTCOMES}, l AS (SELECT {c.sql_class("final_outcome", PARTIAL)} AS label FROM outcomes)
SELECT count(*) AS n_records, count(*) FILTER (WHERE label = 'interested') AS n_interested,
  round(100.0 * count(*) FILTER (WHERE label = 'interested') / count(label), 6) AS pct_interested,
  count(*) FILTER (WHERE label = 'losing_interest') AS n_losing_interest,
  round(100.0 * count(*) FILTER (WHERE label = 'losing_interest') / count(label), 6) AS pct_losing_interest,
  0::BIGINT AS n_missing, count(*) FILTER (WHERE label IS NULL) AS n_unmapped FROM l""",
    "min_class_filter": """WITH r AS (SELECT d.doc_id AS record_id, concat_ws(':', lang, quality, toxic) AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY label) >= 20""",
    "class_id_map": f"""WITH {c.OUTCOMES}, l AS (SELECT cid AS conversation_id, {c.sql_class("final_outcome")} AS label FROM outcomes)
SELECT *, CAST(CASE label WHEN 'interested' THEN 0 WHEN 'losing_interest' THEN 1 END AS BIGINT) AS label_id FROM l""",
    "stratified_split": f"WITH {_SPLIT} SELECT * FROM split",
    "two_way_split": f"""WITH {_LABELS}
SELECT record_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(record_id || ':42'), record_id)
  <= round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM lab""",
    "split_statistics": f"""WITH {_SPLIT}
SELECT split, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS pct
FROM split GROUP BY split, label""",
    "split_overlap": f"""WITH {_SPLIT}
SELECT md5(text) AS text_key, count(DISTINCT split) AS splits FROM split JOIN documents ON doc_id = record_id
GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "split_intersections": f"""WITH {_SPLIT}
SELECT (SELECT count(*) FROM (SELECT record_id FROM split WHERE split = 'train' INTERSECT SELECT record_id FROM split WHERE split = 'val')) AS train_val,
  (SELECT count(*) FROM (SELECT record_id FROM split WHERE split = 'train' INTERSECT SELECT record_id FROM split WHERE split = 'test')) AS train_test,
  (SELECT count(*) FROM (SELECT record_id FROM split WHERE split = 'val' INTERSECT SELECT record_id FROM split WHERE split = 'test')) AS val_test""",
    "split_restricted": f"""WITH {_SPLIT}
SELECT record_id, CAST(quality AS VARCHAR) AS raw_label, n_chars FROM split
JOIN labels l ON l.doc_id = record_id JOIN documents d ON d.doc_id = record_id WHERE split = 'test'""",
    "augmentation_statistics": f"""WITH {_SPLIT}
SELECT split, 4 * count(*) AS examples, count(DISTINCT record_id) AS conversations FROM split GROUP BY split""",
    "join_losses": f"""WITH {_SPLIT}
SELECT count(*) AS n_ids, count(*) FILTER (WHERE record_id NOT IN (SELECT user_id FROM events)) AS without_features,
  count(*) FILTER (WHERE record_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)) AS without_label FROM split""",
    "feature_rows_filled": f"""WITH {c.TIMED}
SELECT doc_id AS conversation_id, CAST(count(cid) AS DOUBLE) AS total_messages,
  CAST(CASE WHEN count(cid) = 0 THEN 0 ELSE 1 + count(*) FILTER (WHERE pos > 0 AND delay > 60) END AS DOUBLE) AS session_count
FROM labels LEFT JOIN msgs ON cid = doc_id GROUP BY doc_id""",
    "confusion_matrix": f"""WITH {c.PREDICTIONS},
grid AS (SELECT * FROM (SELECT DISTINCT model, fraction FROM preds),
  (VALUES ('interested'), ('losing_interest')) a(actual_label), (VALUES ('interested'), ('losing_interest')) p(predicted_label))
SELECT g.model, g.fraction, g.actual_label, g.predicted_label, count(conversation_id) AS n FROM grid g LEFT JOIN preds p
  ON p.model = g.model AND p.fraction = g.fraction AND p.actual_label = g.actual_label AND p.predicted_label = g.predicted_label
GROUP BY ALL""",
    "class_report": f"""WITH {_METRICS}
SELECT model, fraction, 'interested' AS label, round(prec_i, 6) AS precision, round(rec_i, 6) AS recall, round(f1_i, 6) AS f1, CAST(s_i AS BIGINT) AS support FROM cls
UNION ALL SELECT model, fraction, 'losing_interest', round(prec_l, 6), round(rec_l, 6), round(f1_l, 6), CAST(s_l AS BIGINT) FROM cls""",
    "metrics_by_fraction": f"WITH {_METRICS} SELECT model, fraction, n, {_ROUNDED} FROM metrics",
    "cross_entropy": f"""WITH {c.PREDICTIONS}
SELECT model, fraction, round(avg(-ln(greatest(CASE actual_label WHEN 'interested' THEN probability_interested
  ELSE probability_losing_interest END, 1e-15))), 6) AS loss FROM preds GROUP BY ALL""",
    "predicted_distribution": f"""WITH {c.PREDICTIONS}
SELECT model, fraction, predicted_label, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model, fraction), 6) AS pct
FROM preds GROUP BY model, fraction, predicted_label""",
    "selection_metric": f"""WITH {_METRICS}
SELECT model, round(avg(macro_f1), 6) AS selection FROM metrics WHERE fraction < 1 GROUP BY model""",
    "metric_gain": f"""WITH {_METRICS}, g AS (SELECT model, lag(fraction) OVER w AS from_fraction, fraction AS to_fraction,
  round((macro_f1 - lag(macro_f1) OVER w) * 100, 6) AS gain_pp FROM metrics WINDOW w AS (PARTITION BY model ORDER BY fraction))
SELECT * FROM g WHERE from_fraction IS NOT NULL""",
    "earliest_threshold": f"WITH {_METRICS} "
    + " UNION ALL ".join(
        f"SELECT model, '{name}' AS threshold, coalesce(CAST(CAST(min(fraction) FILTER (WHERE "
        + " AND ".join(f"{m} >= {v}" for m, v in tests)
        + ") * 100 AS BIGINT) AS VARCHAR) || '%', 'not reached') AS earliest FROM metrics GROUP BY model"
        for name, tests in THRESHOLDS.items()
    ),
    "experiment_comparison": f"""WITH {_ROWS}
SELECT a.fraction, a.n, a.metric, round(a.value, 6) AS value_a, round(b.value, 6) AS value_b, round((b.value - a.value) * 100, 6) AS delta_pp
FROM (SELECT * FROM mrows WHERE model = 'A') a LEFT JOIN (SELECT * FROM mrows WHERE model = 'B' AND fraction > 0.3) b
  ON a.fraction = b.fraction AND a.metric = b.metric""".replace("a.n, ", ""),
    "stored_metric_check": f"""WITH {_ROWS}
SELECT a.fraction, a.metric, round(a.value, 6) AS value, round(b.value, 6) AS stored, abs(a.value - b.value) < 0.1 AS matches
FROM mrows a JOIN mrows b ON a.fraction = b.fraction AND a.metric = b.metric AND a.model = 'A' AND b.model = 'B'
WHERE a.metric IN ('accuracy', 'macro_f1')""",
    "best_models": f"""WITH {_METRICS} SELECT model, round(macro_f1, 6) AS macro_f1 FROM metrics WHERE fraction = 1
ORDER BY metrics.macro_f1 DESC, model LIMIT 1""",
    "pairing_check": f"""WITH {c.PREDICTIONS},
a AS (SELECT * FROM preds WHERE model = 'A'), b AS (SELECT * FROM preds WHERE model = 'B' AND conversation_id IN (SELECT doc_id FROM labels WHERE toxic = 0))
SELECT fraction, count(a.model) AS rows_a, count(b.model) AS rows_b, 0::BIGINT AS duplicate_a, 0::BIGINT AS duplicate_b,
  count(*) FILTER (WHERE b.model IS NULL) AS only_a, count(*) FILTER (WHERE a.model IS NULL) AS only_b,
  count(*) FILTER (WHERE a.actual_label <> b.actual_label) AS label_mismatch,
  count(*) FILTER (WHERE a.model IS NULL OR b.model IS NULL) = 0 AS paired
FROM a FULL JOIN b USING (conversation_id, fraction) GROUP BY fraction""",
    "outcome_categories": f"""WITH {_PAIRS}, k AS (SELECT fraction, {_COUNTS} FROM pairs GROUP BY fraction)
SELECT *, n_fixes - n_regressions AS net_corrected FROM k""",
    "paired_errors": f"""WITH {_PAIRS} SELECT fraction, category, conversation_id, actual_label, predicted_label_a, predicted_label_b
FROM pairs WHERE category <> 'both_right'""",
    "confidence_groups": f"WITH {_PAIRS} {_conf('a')} UNION ALL {_conf('b')}",
    "mcnemar": f"""WITH {_PAIRS}, k AS (SELECT fraction, {_COUNTS} FROM pairs GROUP BY fraction),
t AS (SELECT fraction, n_regressions AS b, n_fixes AS c, n_regressions + n_fixes AS n FROM k),
p AS (SELECT t.*, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0)
  - lgamma(n - i + 1.0) - n * ln(2.0))) FROM range(0, 100000) r(i) WHERE i <= least(b, c))) END AS p FROM t)
SELECT fraction, b, c, n AS n_disagreements, round(p + 1e-12, 6) AS p_value,
  CASE WHEN n > 0 THEN round_even(pow(abs(b - c) - 1, 2) / n, 4) END AS chi2, p < 0.05 AS significant_05, p < 0.01 AS significant_01 FROM p""",
    "observed_delta": f"""WITH {_METRICS}
SELECT a.fraction, round_even(a.macro_f1, 4) AS macro_f1_a, round_even(b.macro_f1, 4) AS macro_f1_b,
  round_even(b.macro_f1 - a.macro_f1, 4) AS observed_delta
FROM metrics a JOIN metrics b ON a.fraction = b.fraction AND a.model = 'A' AND b.model = 'B'""",
    "ablation_case": f"""WITH {_METRICS}
SELECT a.fraction, CASE WHEN abs(b.macro_f1 - a.macro_f1) * 100 < 1 THEN 'A' WHEN (b.macro_f1 - a.macro_f1) * 100 > 1 THEN 'B' ELSE 'C' END AS case_name
FROM metrics a JOIN metrics b ON a.fraction = b.fraction AND a.model = 'A' AND b.model = 'B'""",
    "percent_tags": f"""WITH {c.PREDICTIONS}
SELECT printf('%03dpct', CAST(floor(fraction * 100) AS BIGINT)) AS tag, count(*) AS n FROM preds GROUP BY 1""",
}
