"""From raw documents to token ids, in five stages. Each takes all rows that the one before kept; each result is written as Parquet and read again.

ORACLE_SQL is None: the last stage is byte-pair encoding, which SQL cannot express; tests/llm/test_pipeline.py holds every
stage against a brute-force version. What null, empty and repeated rows give is stated at each function of docspark.llm.stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import stages
from docspark.llm.common import documents, labels, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them."""
    return stages.keep_good(docs, labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line has, or nearly has, go, and documents of which no word is left."""
    return stages.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (null ids last)."""
    return stages.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each pass of the mix that takes them, in the order of the mix."""
    return stages.mix_sources(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests; a null text has no ids."""
    return stages.tokens(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixing), ("bpe", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
