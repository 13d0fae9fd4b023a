"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from convsignals.llm import (
    collocations,
    decontaminate,
    divergence,
    jaccard_join,
    language_model,
    minhash,
    mixing,
    personal_data,
    quality_rules,
    quality_trees,
    sharding,
    substring_dedup,
    warc,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op3_boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    return quality_trees.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_segment_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(table(spark, folder, "documents"))


def op5_maxent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents"))


def op6_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


def op7_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, folder, "documents"))


def op9_doubling_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


def op10_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_minhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_jump_sharding,
        op3_boosted_trees,
        op4_segment_personal_data,
        op5_maxent_scores,
        op6_warc_revisits,
        op7_raked_mixture,
        op8_jaccard_join,
        op9_doubling_dedup,
        op10_template_decontamination,
        op11_source_divergence,
        op12_phrase_collocations,
        op13_minhash_duplicates,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op2_jump_sharding": sharding.oracle(),
    "op6_warc_revisits": warc.oracle(),
    "op7_raked_mixture": mixing.oracle(),
    "op10_template_decontamination": decontaminate.oracle(),
    "op11_source_divergence": divergence.oracle(),
    "op12_phrase_collocations": collocations.oracle(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
