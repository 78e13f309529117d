"""From raw documents to token ids: quality, near copies, test items, secrets, tokens.

Each stage works on all that the one before kept and returns the columns of
``documents``; the last adds the column ``ids``. Empty tables give empty ones, and
further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontaminate, quality_kn, secret_scan, sentencepiece_viterbi, simhash
from tillroll.llm._common import read_table
from tillroll.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is between their language's limits.

    Null and empty texts are scored as their end mark, repeated rows alike; without trusted labels all stay."""
    return quality_kn.reject_low_quality(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, of equal rows one.

    Null and empty texts have fingerprint zero and are a group; a group of null ids keeps one row."""
    return simhash.keep_one_per_group(docs, shingle=4, max_bits=4, seed=42)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found; null and empty texts and empty benchmarks find none, repeated rows are judged alike."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; a null text stays null, overlapping secrets are one mark."""
    return secret_scan.redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their token ids; null and empty texts have none, texts of any length are encoded whole."""
    return sentencepiece_viterbi.encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

# Perplexities, fingerprints and merges are beyond SQL: tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
