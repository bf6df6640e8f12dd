"""The corpus pipeline: five stages over documents, each of which is written as Parquet and read again as the next one's input.

Edge cases, alike in all stages: rows are judged as rows, whatever their ids, and by their own text; extra columns, also such
whose names the stages use inside, stay as they are; an empty table stays empty. A null or empty text fails the fixed quality
rules, so no later stage meets one from here; each stage's docstring says what it would do. Texts are shuffled once, by near_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcloom.llm import ngram_rules, pieces, pii, simhash, tiling
from srcloom.llm.common import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram rules keep. Null and empty texts go; of rows with one id each stays or goes by itself; documents without a language (null) are judged by a model of their own, as those of each language."""
    return ngram_rules.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id (a null id only where there is no other).

    Null and empty texts are duplicates of one another; equal rows are one; of different texts under one id each group keeps its own.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts stay; null and empty items remove nothing."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text. A null text stays null."""
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row. Null and empty texts have no ids."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("tokenize", tokenize),
]

#: The perplexity bands, the boosted trees and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
