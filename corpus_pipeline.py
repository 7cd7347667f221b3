"""Corpus preparation: quality rules, line de-duplication, near-duplicates, source mixing, token encoding."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, linededup, minhash, mixing, quality, store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave their texts; n_chars follows."""
    return linededup.without_repeated_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each document."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_lines), ("near_dedup", keep_one_of_each), ("mixing", mix), ("bpe", encode)]

#: SQL expresses neither the edit join nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
