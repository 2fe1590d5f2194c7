"""The driver's queries over the corpus operators, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contamination
from .jaccard_join import similarity_components
from .language_id import languages
from .mixing import mix
from .quality_knn import quality
from .quality_rules import host_rules
from .secrets import secret_spans
from .sharding import byte_shards
from .sql import ORACLE_SQL  # noqa: F401
from .token_file import token_digests
from .toxicity import toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_sharding, op3_quality_classifier, op4_ngram_jaccard_join, op5_benchmark_decontamination,
        op6_language_id, op7_token_file, op8_secret_scans, op9_toxicity, op10_source_mixing,
    )
}
