"""A training-data pipeline: toxic documents go, one of each near-duplicate group stays, contaminated documents go, sources
are mixed to their targets, and the rest is written as token ids.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it
kept, written as Parquet and read again; all but the last return whole rows
with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm.common import cut, table, with_package_path
from cuelake.llm.decontaminate import drop_contaminated
from cuelake.llm.jaccard_join import keep_first_of_component
from cuelake.llm.mixing import mixed_documents
from cuelake.llm.token_file import token_digests
from cuelake.llm.toxicity import drop_toxic

#: SQL has no gradient-boosted trees, tokenizer or Huffman code, so no SQL gives run()'s rows; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package_path(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package_path(spark)
    return keep_first_of_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package_path(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package_path(spark)
    return mixed_documents(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_package_path(spark)
    return token_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_file", token_file),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
