"""From documents to a decontaminated, deduplicated, mixed and sharded training corpus.

Each stage takes what its predecessor kept, as Parquet in the shared checkpoint folder, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convsignals.llm import decontaminate, jaccard_join, mixing, quality_trees, sharding
from convsignals.llm.tables import Scratch, released

#: Five words and a similarity of 0.8 or more make a near duplicate.
SHINGLE_WORDS, SIMILARITY = 5, 80
SHARDS = 40
#: Name of the column that tells rows apart inside a stage.
ROW = "~row"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_key() -> Column:
    """64 bits of id and text; two different rows collide with a probability of about n * n / 2**65 in all."""
    return F.xxhash64(F.lit("row"), F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees accept. A row without an id is scored and kept like any other."""
    return quality_trees.accepted(docs, _table(spark, sf_dir, "labels")).select(*docs.columns)


def jaccard_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, rows without an id last. Rows alike in
    id and text are one group; rows without words are like no other, and all stay. Rows are told apart by id and text,
    so neither null nor repeated ids carry one row's fate over to another text."""
    keyed = docs.withColumn(ROW, _row_key())
    with Scratch(spark) as scratch:
        groups = jaccard_join.jaccard_join(keyed.select(F.col(ROW).alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY)
        groups = scratch.store(groups.filter("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n")))
        ids = scratch.store(keyed.select(F.col(ROW).alias("doc_id"), F.col("doc_id").alias("named")).distinct())
        best = F.min(F.struct(F.col("named").isNull(), F.col("named"), F.col("doc_id")))
        first = groups.join(ids, "doc_id").groupBy("component_id").agg(best["doc_id"].alias("doc_id"))
        first = scratch.store(first)
        gone = released(groups.join(first, "doc_id", "left_anti").select(F.col("doc_id").alias(ROW)))
        again = released(groups.join(first, "doc_id").filter("n > 1").select(F.col("doc_id").alias(ROW)))
    kept = keyed.join(gone, ROW, "left_anti")
    once = kept.join(again, ROW, "left_anti")
    twice = kept.join(again, ROW, "left_semi").groupBy(ROW).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return once.select(*docs.columns).union(twice.select("row.*"))


def template_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by id and text, null and repeated ids included."""
    keyed = docs.withColumn(ROW, _row_key())
    found = decontaminate.leaks(keyed.select(F.col(ROW).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    found = released(found.select(F.col("doc_id").alias(ROW)).distinct())
    return keyed.join(found, ROW, "left_anti").select(*docs.columns)


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws: each row by its own stratum, by its text where it has no id."""
    return mixing.drawn(docs).select(*docs.columns)


def jump_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the shards."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_representatives", jaccard_representatives),
    ("template_decontamination", template_decontamination),
    ("target_mixing", target_mixing),
    ("jump_shards", jump_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = released(docs)
    return docs


#: The learned classifier has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None
