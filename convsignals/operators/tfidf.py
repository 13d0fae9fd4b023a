"""TF-IDF weights as a long table with smooth idf and unit-length documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convsignals.functions import text as tx


def word_terms(text: Column, low: int = 1, high: int = 2) -> Column:
    return tx.word_ngrams(tx.word_tokens(text), low, high)


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """``(key, term, tf)``. The texts are dealt by key, so that neither their terms nor the weights by key are shuffled."""
    return (
        docs.repartition(F.col(key))
        .select(key, F.explode(terms).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(
    counts: DataFrame,
    docs: DataFrame,
    max_features: int,
    min_df: int = 1,
    max_df: float = 1.0,
) -> DataFrame:
    """``(term, df, idf)`` of the most frequent terms, ties in term order.

    At most ``max_features`` rows, which is what makes broadcasting it safe at any corpus size.
    """
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    return (
        per_term.withColumn("n_docs", n_docs)
        .where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df))
        .orderBy(F.desc("total"), "term")
        .limit(max_features)
        .select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    )


def weights(counts: DataFrame, vocab: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """``(key, term, df, weight)`` with unit length per document.

    A document holds at most one row per vocabulary term, so the window per document is bounded.
    """
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = counts.join(F.broadcast(vocab), "term").withColumn("raw", tf * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "df", (F.col("raw") / length).alias("weight"))


def document_weights(
    docs: DataFrame,
    key: str,
    terms: Column,
    max_features: int = 20_000,
    min_df: int = 1,
    max_df: float = 0.95,
    sublinear: bool = True,
) -> DataFrame:
    """Weights of documents over the vocabulary of the same documents."""
    counts = term_counts(docs, key, terms)
    return weights(counts, vocabulary(counts, docs, max_features, min_df, max_df), key, sublinear)
