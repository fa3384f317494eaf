"""A corpus from raw documents to packed token sequences: language, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; every stage but the last returns the
columns of `documents`. What a stage does with nulls in any column, empty and very long texts, repeated rows and empty tables is said in the
module of its operator; columns that other tables or the operators use as names pass through unchanged."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import decontamination, langid, packing, pii, shingle_join
from wattloom.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those in which no language makes up half."""
    return langid.keep_languages(docs, least=0.5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at 80 % keeps the one with the least doc_id."""
    return shingle_join.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones included."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; no row goes."""
    return pii.mask_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack_documents(docs, size=1024, end_id=2)


STAGES = [("language_id", language), ("shingle_join", near_copies), ("decontamination", benchmark), ("pii", personal_data), ("best_fit_packing", packed)]
#: Trigram likelihoods, checksums and token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
