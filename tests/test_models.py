import numpy as np
import pytest
from pyspark.sql import functions as F

from convsignals.operators import metrics as mx
from convsignals.operators import models as md
from convsignals.operators import standardize as st
from convsignals.plans import corpus_build, early_detection, text_baseline
from convsignals.plans.corpus_build import judge
from test_corpus import conversation, corpus

CLASSES = ["interested", "losing_interest"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        y = i % 2
        rows.append((f"c{i}", CLASSES[y], ["train", "train", "train", "val", "test"][i % 5], float(y * 2 + rng.normal()), float(rng.normal() * 50), 7.0))
    return spark.createDataFrame(rows, "conversation_id string, label string, split string, x double, y double, k double").cache()


def test_train_select_and_importances(spark, table):
    got = md.train_and_select(table, ["x", "y", "k"], CLASSES, forest_trees=20)
    assert set(got.models) == {"logistic_regression", "random_forest"}
    m = mx.evaluate(got.test_predictions, CLASSES, "losing_interest").first()
    assert m["n"] == 48 and m["accuracy"] > 0.7
    p = got.test_predictions.first()
    assert p["probability_interested"] + p["probability_losing_interest"] == pytest.approx(1)
    for model in got.models.values():
        assert md.importance_table(spark, model, ["x", "y", "k"]).first()["feature"] == "x"


def test_fits_see_training_rows_only(table):
    names = ["x", "y"]
    changed = table.withColumn("x", F.when(F.col("split") == "train", F.col("x")).otherwise(F.col("x") * 1000 + 7))
    first, second = (st.fit_scaler(t.where("split = 'train'"), names).first() for t in (table, changed))
    assert first == second


def test_regularization_strength_matches_its_definition(spark):
    """At the optimum, the gradient of C * sum(loss) + |w|^2 / 2 vanishes."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, label_id double")
    data = md.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    model = md.logistic_regression(60, c=2.0).fit(data)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(w + 2.0 * x.T @ (p - y), 0, atol=1e-2)


def test_balanced_weights(spark):
    rows = spark.createDataFrame([("interested",)] * 3 + [("losing_interest",)], "label string")
    got = {r["label"]: r["weight"] for r in md.with_balanced_weight(rows, CLASSES).distinct().collect()}
    assert got == pytest.approx({"interested": 4 / 6, "losing_interest": 2.0})


@pytest.fixture(scope="module")
def texts(spark):
    rows = []
    for i in range(80):
        good = i % 2 == 0
        words = ["great thanks deal", "agree buy today"] if good else ["too expensive sorry", "maybe later no"]
        rows.append((f"r{i}", f"{words[i // 2 % 2]} number{i}", "converted" if good else "ghosted"))
    return spark.createDataFrame(rows, "record_id string, raw_text string, raw_label string")


def test_text_baseline_end_to_end(spark, texts, tmp_path):
    mapping = {"interested": ["converted"], "losing_interest": ["ghosted"]}
    run = text_baseline.run(texts, mapping, "losing_interest", max_iter=50)
    assert run.metrics.first()["accuracy"] == 1.0 and run.metrics.first()["n"] == 16
    assert run.confusion.count() == 4 and run.report.count() == 2
    run.model.save(str(tmp_path / "model"))
    loaded = md.TextModel.load(spark, str(tmp_path / "model"))
    new = spark.createDataFrame([("n1", "GREAT deal!!!"), ("n2", ""), ("n3", "too expensive")], "record_id string, raw_text string")
    got = {r["record_id"]: r for r in text_baseline.score_new(loaded, new).collect()}
    assert (got["n1"]["predicted_label"], got["n3"]["predicted_label"]) == ("interested", "losing_interest")
    ranked = [x["probability"] for x in got["n2"]["ranked"]]
    assert len(got) == 3 and ranked == sorted(ranked, reverse=True) and sum(ranked) == pytest.approx(1)


def test_text_vectors_are_unit_length(spark):
    docs = spark.createDataFrame([("a", "one two two"), ("b", "zzz"), ("c", "")], "record_id string, t string")
    terms = md.word_terms(F.col("t"))
    vocab = md._indexed(md.vocabulary(md.term_counts(docs, "record_id", terms), docs, 100))
    got = {r["record_id"]: r["features"] for r in md.text_vectors(docs, vocab, vocab.count(), "record_id", terms).collect()}
    assert np.linalg.norm(got["a"].toArray()) == pytest.approx(1)
    assert got["c"].numNonzeros() == 0


def test_text_vectors_make_no_row_per_term(spark):
    """Rows of terms were grouped and joined back to the texts, which took most of the time."""
    docs = spark.createDataFrame([("a", "one two two"), ("b", None), ("c", "two three")], "record_id string, t string")
    terms = md.word_terms(F.col("t"), 1, 1)
    vocab = md._indexed(md.vocabulary(md.term_counts(docs, "record_id", terms), docs, 100))
    vectors = md.text_vectors(docs, vocab, 3, "record_id", terms)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r["record_id"]: r["features"].toArray() for r in vectors.collect()}
    idf = {t: np.log(4 / (1 + n)) + 1 for t, n in (("one", 1), ("three", 1), ("two", 2))}
    raw = np.array([idf["one"], 0, (1 + np.log(2)) * idf["two"]])
    assert got["a"] == pytest.approx(raw / np.linalg.norm(raw)) and not got["b"].any()
    raw = np.array([0, idf["three"], idf["two"]])
    assert got["c"] == pytest.approx(raw / np.linalg.norm(raw))


def test_prefix_run_scores_every_fraction(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(100):
        for f in (0.25, 0.5, 0.75, 1.0):
            y = i % 2
            rows.append((f"c{i}", f, CLASSES[y], ["train", "train", "train", "val", "test"][i // 2 % 5], float(y * f * 4 + rng.normal())))
    df = spark.createDataFrame(rows, "conversation_id string, fraction double, label string, split string, x double")
    run = early_detection.run(df, CLASSES, "losing_interest", strengths=(1.0, 0.01), names=["x"])
    scores = {r["fraction"]: r["accuracy"] for r in run.metrics.collect()}
    assert set(scores) == {0.25, 0.5, 0.75, 1.0} and scores[1.0] > 0.8
    assert 0 <= run.selection <= 1


def test_external_model_scores(spark):
    def load():
        def predict(texts):
            return np.array([[len(t), 3.0] for t in texts], dtype="float32")

        return predict

    rows = spark.createDataFrame([("a",), ("abcdef",)], "text string")
    got = {r["text"]: r["predicted_label"] for r in md.logits_to_predictions(md.score_texts(rows, load), CLASSES).collect()}
    assert got == {"a": "losing_interest", "abcdef": "interested"}


def test_corpus_build_judges_new_conversations(spark):
    accepted = corpus(spark, conversation())
    copy = conversation(conversation_id="he_sales_000002")
    fresh = conversation(conversation_id="he_sales_000003", domain="law")
    for i, text in enumerate(["מה שעות הפתיחה שלכם ביום שישי", "פתוחים משמונה ועד אחת בצהריים", "מצוין נתראה שם"]):
        fresh["messages"][i]["text"] = text
    broken = conversation(conversation_id="he_sales_000004", language="en", domain="law")
    for i, text in enumerate(["האם הקורס מתאים למתחילים", "בהחלט יש קבוצה חדשה בקיץ", "תשלח לי סילבוס"]):
        broken["messages"][i]["text"] = text
    new = corpus_build.with_derived_signals(corpus(spark, copy, fresh, broken))
    result = judge(new, accepted)
    assert [r["conversation_id"] for r in result.accepted.collect()] == ["he_sales_000003"]
    reasons = {r["conversation_id"]: set(r["reasons"]) for r in result.rejected.collect()}
    assert reasons["he_sales_000002"] == {"exact_duplicate", "similar_conversation"}
    assert reasons["he_sales_000004"] == {"language"}


def _forest_rows(spark, n=900):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), np.full(n, 3.0), rng.normal(size=n)])
    y = (x[:, 0] + (x[:, 1] == 2) + 0.7 * rng.normal(size=n) > 0.3).astype(float)
    rows = spark.createDataFrame([(f"c{i}", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "conversation_id string, a double, b double, k double, z double, label_id double")
    return md.VectorAssembler(inputCols=["a", "b", "k", "z"], outputCol="features").transform(rows).select("conversation_id", "features", "label_id")


def test_forest_is_the_same_for_any_cut_between_histograms_and_tasks(spark):
    """Bags and feature choices belong to rows and nodes, so partitions and the size of a task's share must not show (F11)."""
    from convsignals.operators.forest import RandomForest

    rows = _forest_rows(spark).cache()
    got = []
    for local_rows, dealt in ((10_000, rows), (60, rows.repartition(7))):
        model = RandomForest(trees=6, local_rows=local_rows).fit(dealt)
        scored = {r["conversation_id"]: tuple(r["probability"]) for r in model.transform(rows).collect()}
        got.append((scored, [round(v, 9) for v in model.featureImportances.toArray()]))
        assert (max(len(t.path) for t in model.tops) > 1) == (local_rows == 60)
    assert got[0] == got[1] and len(got[0][0]) == 900


def test_forest_agrees_with_spark_ml(spark):
    from pyspark.ml.classification import RandomForestClassifier

    rows = _forest_rows(spark, 2000).cache()
    train, test = (rows.where(F.expr(f"xxhash64(conversation_id, 1) % 3 {op} 0")) for op in ("<>", "="))
    theirs = RandomForestClassifier(labelCol="label_id", numTrees=40, minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=30, seed=1).fit(train)
    ours = md.random_forest(trees=40).fit(train)
    right = [m.transform(test).where("prediction = label_id").count() / test.count() for m in (theirs, ours)]
    assert abs(right[0] - right[1]) < 0.03 and right[1] > 0.7
    assert np.abs(theirs.featureImportances.toArray() - ours.featureImportances.toArray()).max() < 0.05


def test_forest_leaves_hold_enough_rows_and_follow_the_brute_force(spark):
    """Every split of a grown tree is the best of its chosen features on the rows that reach it."""
    from convsignals.operators import forest as fo

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 8, (300, 3)), np.zeros(300)]).astype(np.uint8)
    y, w = rng.integers(0, 2, 300).astype(np.uint8), rng.integers(1, 3, 300).astype(np.uint8)
    shape = fo.Shape(np.array([0, 1, 2, 3]), 2, 32, 2, 2, 30, 42)
    tree, _ = fo.grow(x, y, w, 1, 0, shape)

    def purity(rows):
        return sum(w[rows & (y == c)].sum() ** 2.0 for c in (0, 1)) / max(w[rows].sum(), 1)

    def check(at, path, rows):
        assert tree.counts[at].tolist() == [w[rows & (y == c)].sum() for c in (0, 1)]
        options = []
        for f in shape.chosen(np.array([path]), 0)[0]:
            for cut in range(31):
                left, right = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
                if min(w[left].sum(), w[right].sum()) >= 2:
                    options.append((purity(left) + purity(right) - purity(rows), f, cut))
        best = max((g for g, _, _ in options), default=0)
        if tree.feature[at] < 0:
            assert best <= 1e-9 or min(tree.counts[at]) == 0
            return 1
        mine = [g for g, f, cut in options if (f, cut) == (tree.feature[at], tree.cut[at])]
        assert mine[0] == pytest.approx(best)
        goes = x[:, tree.feature[at]] > tree.cut[at]
        return check(tree.child[at], 2 * path, rows & ~goes) + check(tree.child[at] + 1, 2 * path + 1, rows & goes)

    assert check(0, 1, np.ones(300, bool)) > 10
