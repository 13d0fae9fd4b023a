"""Training, selection and scoring of classifiers on feature and text tables with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convsignals.functions import text as tx
from convsignals.operators import metrics as mx
from convsignals.operators.forest import ForestModel, RandomForest
from convsignals.operators.standardize import apply_scaler, fit_scaler
from convsignals.operators.tfidf import term_counts, vocabulary, word_terms
from convsignals.schema import POSITIVE_CLASS, assert_no_leakage
from convsignals.session import stored

SEED = 42


def with_class_number(rows: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """Add ``label_id``: position of the class in sorted order."""
    number = F.lit(None).cast("double")
    for i, name in enumerate(sorted(classes)):
        number = F.when(F.col(label) == name, F.lit(float(i))).otherwise(number)
    return rows.withColumn("label_id", number)


def with_balanced_weight(train: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (k * n_class). One row of class counts reaches the driver."""
    row = train.agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes]).first()
    present = {c: row[c] for c in classes if row[c]}
    weight = F.lit(None).cast("double")
    for name, n in present.items():
        value = sum(present.values()) / (len(present) * n)
        weight = F.when(F.col(label) == name, F.lit(value)).otherwise(weight)
    return train.withColumn("weight", weight)


def as_predictions(
    scored: DataFrame, classes: Sequence[str], key: str, label: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    """Model output as a prediction table; probabilities are named columns in sorted class order."""
    names = sorted(classes)
    p = vector_to_array("probability")
    predicted = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("prediction") + 1).cast("int"))
    return scored.select(
        F.col(key).alias("conversation_id"),
        *keep,
        F.col(label).alias("actual_label"),
        predicted.alias("predicted_label"),
        *[p[i].alias(f"probability_{n}") for i, n in enumerate(names)],
        (F.col(label) == predicted).cast("int").alias("correct"),
    )


# ------------------------------------------------------------ behavior models
def logistic_regression(n_train: int, c: float = 1.0, weighted: bool = False, max_iter: int = 1000) -> LogisticRegression:
    """L2 strength 1/(C*n) on mean loss equals strength C on summed loss."""
    model = LogisticRegression(
        featuresCol="features",
        labelCol="label_id",
        regParam=1.0 / (c * n_train),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-7,
    )
    return model.setWeightCol("weight") if weighted else model


def random_forest(seed: int = SEED, trees: int = 200, min_leaf: int = 2, classes: int = 2, key: str = "conversation_id") -> RandomForest:
    """Depth is limited to 30, the most Spark ML allows."""
    return RandomForest(trees=trees, min_leaf=min_leaf, max_depth=30, classes=classes, seed=seed, key=key)


@dataclass
class Candidates:
    """Fitted models, their validation metrics, the chosen one and its test predictions."""

    models: dict[str, Model | ForestModel]
    validation: DataFrame
    chosen: str
    test_predictions: DataFrame


def train_and_select(
    table: DataFrame,
    names: Sequence[str],
    classes: Sequence[str],
    key: str = "conversation_id",
    forest_trees: int = 200,
    positive: str = POSITIVE_CLASS,
) -> Candidates:
    """Fit scaled logistic regression and a forest on train, pick by validation macro F1, test once.

    ``table`` has the key, ``label``, ``split`` and the features. Only train rows reach the scaler
    and the fits.
    """
    assert_no_leakage(table.select(key, "split", *names))
    rows = with_class_number(table, classes)
    scaler = fit_scaler(rows.where("split = 'train'"), names)
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    keep = [key, "label", "label_id", "split", "features"]
    inputs = {
        "logistic_regression": stored(assembler.transform(apply_scaler(rows, scaler, names)).select(*keep)),
        "random_forest": stored(assembler.transform(rows).select(*keep)),
    }
    n_train = inputs["logistic_regression"].where("split = 'train'").count()
    estimators = {
        "logistic_regression": logistic_regression(n_train),
        "random_forest": random_forest(trees=forest_trees, classes=len(classes), key=key),
    }
    models, scores = {}, None
    for name, estimator in estimators.items():
        models[name] = estimator.fit(inputs[name].where("split = 'train'"))
        scored = as_predictions(models[name].transform(inputs[name].where("split = 'val'")), classes, key)
        row = mx.evaluate(scored.withColumn("model", F.lit(name)), sorted(classes), positive, ["model"])
        scores = row if scores is None else scores.unionByName(row)
    chosen = mx.best_model(scores).first()["model"]
    test = models[chosen].transform(inputs[chosen].where("split = 'test'"))
    return Candidates(models, scores, chosen, as_predictions(test, classes, key))


def importance_table(spark: SparkSession, model: Model | ForestModel, names: Sequence[str]) -> DataFrame:
    """Feature coefficients by absolute size, or forest importances, largest first."""
    if isinstance(model, LogisticRegressionModel):
        values = model.coefficients.toArray().tolist()
    else:
        values = model.featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(names, values)), "feature string, value double")
    return table.orderBy(F.desc(F.abs("value")), "feature")


# ---------------------------------------------------------------- text model
@F.udf(VectorUDT())
def sparse_vector(size, index, value):
    """Spark ML reads sparse vectors only as vector objects, which have no column constructor."""
    return SparseVector(size, index, value)


def _indexed(vocab: DataFrame) -> DataFrame:
    """Number the bounded vocabulary in term order."""
    entries = F.array_sort(F.collect_list(F.struct("term", "df", "idf")))
    return vocab.agg(entries.alias("v")).select(F.posexplode("v").alias("index", "e")).select(
        "index", "e.term", "e.df", "e.idf"
    )


def text_vectors(docs: DataFrame, vocab: DataFrame, size: int, key: str, terms: Column) -> DataFrame:
    """``(key, features)``: sublinear, smooth-idf, unit-length sparse vectors; empty texts included.

    The terms of a text are counted where the text is: no row is made per term, and nothing is shuffled. The bounded vocabulary
    reaches the driver once.
    """
    rows = vocab.select("index", "term", "idf").toArrow().sort_by("index")
    known, index, idf = (rows.column(c).combine_chunks() for c in ("term", "index", "idf"))
    index, idf = index.to_numpy(), idf.to_numpy()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            place = pc.index_in(lists.flatten().cast(known.type), value_set=known)
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), sizes)[place >= 0]
            at, tf = np.unique(row * max(len(known), 1) + place[place >= 0], return_counts=True)
            row, place = at // max(len(known), 1), at % max(len(known), 1)
            w = (1 + np.log(tf)) * idf[place]
            w /= np.sqrt(np.bincount(row, w * w, minlength=len(lists)))[row]
            ends = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32))
            parts = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (index[place].astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([b.column(0), *parts], [key, "index", "w"])

    kind = docs.schema[key].dataType.simpleString()
    weighed = docs.select(key, terms.alias("terms")).mapInArrow(weigh, f"`{key}` {kind}, index array<int>, w array<double>")
    return weighed.select(key, sparse_vector(F.lit(size), "index", "w").alias("features"))


@dataclass
class TextModel:
    """Vocabulary and classifier of one text baseline; scoring cleans texts as training did."""

    vocabulary: DataFrame
    size: int
    classifier: LogisticRegressionModel
    classes: list[str]

    def score(self, texts: DataFrame, key: str = "record_id", text: str = "raw_text") -> DataFrame:
        cleaned = texts.select(key, tx.cleaned(F.col(text)).alias("cleaned_text"))
        vectors = text_vectors(cleaned, self.vocabulary, self.size, key, word_terms(F.col("cleaned_text")))
        return self.classifier.transform(vectors)

    def predict(self, texts: DataFrame, key: str = "record_id", text: str = "raw_text") -> DataFrame:
        """Predicted class, and all class probabilities from high to low."""
        p = vector_to_array("probability")
        ranked = F.array_sort(
            F.array(*[F.struct(p[i].alias("probability"), F.lit(c).alias("label")) for i, c in enumerate(self.classes)]),
            lambda a, b: F.when(a["probability"] > b["probability"], -1)
            .when(a["probability"] < b["probability"], 1)
            .otherwise(0),
        )
        return self.score(texts, key, text).select(key, ranked[0]["label"].alias("predicted_label"), ranked.alias("ranked"))

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        spark = self.vocabulary.sparkSession
        facts = spark.createDataFrame([(self.size, self.classes)], "size int, classes array<string>")
        facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextModel:
        facts = spark.read.parquet(f"{path}/facts").first()
        return TextModel(
            spark.read.parquet(f"{path}/vocabulary"),
            facts["size"],
            LogisticRegressionModel.load(f"{path}/classifier"),
            list(facts["classes"]),
        )


def fit_text_model(
    train: DataFrame,
    classes: Sequence[str],
    key: str = "record_id",
    text: str = "cleaned_text",
    label: str = "label",
    max_features: int = 20_000,
    max_df: float = 0.95,
    max_iter: int = 3000,
) -> TextModel:
    """TF-IDF with balanced logistic regression, fitted on the given training rows only."""
    terms = word_terms(F.col(text))
    counts = term_counts(train, key, terms)
    vocab = stored(_indexed(vocabulary(counts, train, max_features, 1, max_df)))
    size = vocab.count()
    vectors = text_vectors(train, vocab, size, key, terms)
    rows = with_balanced_weight(with_class_number(train.select(key, label), classes, label), classes, label)
    rows = stored(rows.join(vectors, key).select("features", "label_id", "weight"))
    model = logistic_regression(rows.count(), weighted=True, max_iter=max_iter).fit(rows)
    return TextModel(vocab, size, model, sorted(classes))


# -------------------------------------------------------------------- fusion
def fusion_table(
    vectors: DataFrame, features: DataFrame, names: Sequence[str], key: str, embedding: str = "embedding"
) -> DataFrame:
    """Frozen text vector followed by behavioral features, as one ``features`` vector.

    A vector without a row of features keeps zeros in their place.
    """
    joined = vectors.join(features, key, "left").fillna(0.0, subset=list(names))
    both = F.concat(F.col(embedding).cast("array<double>"), F.array(*[F.col(n).cast("double") for n in names]))
    return joined.withColumn("features", array_to_vector(both))


def fusion_classifier(width: int, classes: int = 2, hidden: int = 256, seed: int = SEED, max_iter: int = 100) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label_id", layers=[width, hidden, classes], seed=seed, maxIter=max_iter
    )


# -------------------------------------------------------- external text models
def score_texts(
    table: DataFrame, load: Callable, text: str = "text", width: int = 2, batch_size: int = 32
) -> DataFrame:
    """Add ``logits`` from any external model. ``load`` returns a function from an array of texts
    to an array of logits; it runs once per Python worker and sees batches."""
    predict = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return table.withColumn("logits", predict(F.col(text)))


def logits_to_predictions(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Softmax probabilities and the label of the largest logit."""
    names = sorted(classes)
    p = tx.softmax(F.col("logits").cast("array<double>"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), tx.argmax(F.col("logits")) + 1)
    return scored.withColumn("_p", p).withColumns(
        {
            "predicted_label": label,
            **{f"probability_{n}": F.col("_p")[i] for i, n in enumerate(names)},
        }
    ).drop("_p")
