"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path

from logstream.llm import (
    byte_bpe,
    chat,
    decontaminate,
    hard_negatives,
    language,
    licenses,
    near_dedup,
    oracles,
    passages,
    pii,
    quality,
    token_files,
    warc,
    whitening,
)
from logstream.llm.common import fresh_folder, stored, table
from logstream.llm.vectors import scaled, usable

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
END_ID = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in doc_id order and read back from the files."""
    docs, folder = table(spark, sf_dir, "documents"), fresh_folder(spark, "tokens")
    token_files.write(docs, folder, path(WORD_VOCABULARY), END_ID)
    return token_files.read(spark, folder)


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, and that of its host."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("host")


def op3_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that every document shares with the smallest document of their seeds."""
    return passages.find(table(spark, sf_dir, "documents"))


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows that occur in every document."""
    found = decontaminate.find(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.drop("spans", "items")


def op5_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document, and whether it stays."""
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op8_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records, read back from the archives."""
    folder = fresh_folder(spark, "warc")
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).drop("url", "payload")


def op9_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, as spans."""
    return pii.find(table(spark, sf_dir, "documents")).drop("found")


def op6_round_trip_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(stored(chat.format_turns(rows.unionByName(odd)), "chat"))


def op7_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the bytes they decode to, as digests."""
    ranks = path(BYTE_RANKS)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        "n_tokens",
        byte_bpe.sha256("ids").alias("ids_sha256"),
        byte_bpe.sha256("decoded").alias("decoded_sha256"),
    )


def op10_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each hundredth embedding, with every seventh label moved on."""
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull() & usable("embedding"))
    rows = rows.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        scaled("embedding", 256).alias("x"),
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on their eight leading whitened components."""
    rows = table(spark, sf_dir, "embeddings").filter(usable("embedding"))
    shift = 100_000
    return whitening.whiten(rows.select("vec_id", scaled("embedding", 1024, shift).alias("x")), 8, shift)


def op13_sliced_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.held_out("doc_id"))
    model = language.learn(docs.filter(~F.col("held_out")))
    return language.identify(docs.drop("lang"), model).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run
    for run in (
        op1_token_files,
        op2_host_quality,
        op3_chained_passages,
        op4_wu_manber,
        op5_bayesian_minhash,
        op6_round_trip_chat,
        op7_distinct_word_bpe,
        op8_seekable_warc,
        op9_checked_pii,
        op10_diagonal_licenses,
        op11_threshold_negatives,
        op12_qd_whitening,
        op13_sliced_language_filters,
    )
}
ORACLES: dict[str, str] = {
    "op2_host_quality": oracles.QUALITY,
    "op4_wu_manber": oracles.DECONTAMINATION,
    "op5_bayesian_minhash": oracles.NEAR_DEDUP,
    "op6_round_trip_chat": oracles.CHAT,
    "op8_seekable_warc": oracles.WARC,
    "op10_diagonal_licenses": oracles.LICENSES,
    "op11_threshold_negatives": oracles.HARD_NEGATIVES,
}
