"""Prepares the documents for training: quality, near duplicates, benchmark, personal data, ids."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession

from logstream.llm import byte_bpe, decontaminate, near_dedup, pii, quality
from logstream.llm.common import stored, table
from logstream.llm.queries import BYTE_RANKS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the quality rules, of hosts that do."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates: shingle sets that agree to 0.85."""
    return near_dedup.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and the digests of the ids and of the bytes they decode to."""
    ranks = path(BYTE_RANKS)
    # Stored: no task has the Python workers of both at once.
    encoded = stored(byte_bpe.encode(docs, ranks), "ids")
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        "n_tokens",
        byte_bpe.sha256("ids").alias("ids_sha256"),
        byte_bpe.sha256("decoded").alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", keep_clean),
    ("personal_data", redact),
    ("byte_level_bpe", token_ids),
]

# The last stage has no SQL: the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
