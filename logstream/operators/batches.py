"""Batches of records: acceptance, outcome, and the two ways of taking records in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstream import model
from logstream.functions.rows import free_name, pinned
from logstream.operators.parse import submitted
from logstream.operators.validate import apply_defaults, is_valid, validate

# Tasks over which a batch is spread; a refused one may hold any share of the rows.
SALTS = 32


def _sizes(df: DataFrame, most: int) -> DataFrame:
    """Each named batch with its entries, its valid ones, and whether it is accepted."""
    counted = df.where(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(
        F.count("*").alias("entries"), F.count_if(is_valid()).alias("valid")
    )
    good = (F.col("entries") <= most) & (F.col("valid") == F.col("entries"))
    return counted.withColumn("accepted", good)


def accept_batches(df: DataFrame, most: int = model.MAX_BATCH) -> DataFrame:
    """Rows of the batches with 1..``most`` entries that are all valid.

    A row without a ``batch_id`` is a batch of its own. Batches of more than ``most`` entries are few and
    may hold any share of the rows: these leave first, by id and salt. What is left of any id fits a task,
    and rows without an id are spread, when rows meet the verdict on their batch.
    """
    salt, key, taken = (free_name(df, name) for name in ("_salt", "_key", "_taken"))
    # Pinned, both verdicts look alike to the planner, and one aggregation serves them.
    sizes = pinned(_sizes(df, most), "entries", "accepted")
    too_large = sizes.where(F.col("entries") > most).select(
        "batch_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt)
    )
    accepted = sizes.where("accepted").select("batch_id", F.lit(0).alias(key), F.lit(True).alias(taken))
    part = F.pmod(F.xxhash64(*_told_apart(df)), F.lit(SALTS)).cast("int")
    rows = df.withColumn(salt, part).withColumn(
        key, F.when(F.col("batch_id").isNull(), part + 1).otherwise(0)
    )
    small = rows.join(too_large, ["batch_id", salt], "left_anti")
    judged = small.join(accepted, ["batch_id", key], "left")
    kept = F.col(taken) | (F.col("batch_id").isNull() & is_valid())
    return judged.where(kept).select(*df.columns)


def _told_apart(df: DataFrame) -> list[str]:
    """Columns that differ between the rows of a batch."""
    return [c for c in ("message", "trace_id", "timestamp") if c in df.columns]


def batch_outcome(df: DataFrame, most: int = model.MAX_BATCH) -> DataFrame:
    """Per batch: entries taken, entries refused, and the status of the answer.

    A batch is taken as a whole or not at all, as in :func:`accept_batches`. Rows without an
    id, each a batch of its own, are summed up in one row of their own (``batch_id`` NULL).
    """
    named = _sizes(df, most).select(
        "batch_id",
        F.when(F.col("accepted"), F.col("entries")).otherwise(0).alias("processed"),
        F.when(F.col("accepted"), 0).otherwise(F.col("entries")).alias("failed"),
    )
    single = df.where(F.col("batch_id").isNull()).agg(
        F.count_if(is_valid()).alias("processed"), F.count_if(~is_valid()).alias("failed")
    )
    single = single.where("processed + failed > 0").select(
        F.lit(None).cast("string").alias("batch_id"), "processed", "failed"
    )
    status = F.when(F.col("failed") == 0, "success").when(F.col("processed") == 0, "refused")
    return named.union(single).withColumn("status", status.otherwise("partial_success"))


def judge_batches(df: DataFrame, most: int = model.MAX_BATCH) -> DataFrame:
    """Nested batches (see ``parse_batches``) with their entries read and what becomes of them.

    Adds ``entries``, ``valid`` (how many are), and ``accepted``: 1..``most`` entries, all
    valid. A value that is no batch has no entries and is refused. No shuffle.
    """
    read = df.withColumn("entries", F.transform("logs", submitted))
    good = F.filter("entries", lambda entry: is_valid(entry.getField, as_sent=True))
    size = F.coalesce(F.size("entries"), F.lit(0))
    return read.withColumn("valid", F.coalesce(F.size(good), F.lit(0))).withColumn(
        "accepted", size.between(1, most) & (F.col("valid") == size)
    )


def nested_outcome(judged: DataFrame) -> DataFrame:
    """Per nested batch: entries taken, entries refused, and the status of the answer."""
    size = F.greatest(F.coalesce(F.size("entries"), F.lit(0)), F.lit(0))
    taken = F.col("accepted")
    return judged.select(
        "batch_id",
        F.when(taken, size).otherwise(0).cast("bigint").alias("processed"),
        F.when(taken, 0).otherwise(size).cast("bigint").alias("failed"),
        F.when(taken, "success").otherwise("refused").alias("status"),
    )


def explode_batches(judged: DataFrame, ingest_ts: Column | datetime | None = None) -> DataFrame:
    """Entries of the accepted nested batches, with defaults and ``log_id``, without a shuffle."""
    arrived = ["arrived"] if "arrived" in judged.columns else []
    rows = judged.where("accepted").select("batch_id", *arrived, F.explode("entries").alias("entry"))
    filled = apply_defaults(rows.select("batch_id", *arrived, "entry.*"), ingest_ts)
    return filled.select("batch_id", *model.LOG_FIELDS, "log_id")


def refused_batches(judged: DataFrame) -> DataFrame:
    """The batches that were refused, as they were sent, with their number of bad entries."""
    bad = F.greatest(F.coalesce(F.size("entries"), F.lit(0)), F.lit(0)) - F.col("valid")
    return judged.where(~F.col("accepted")).select("batch_id", bad.alias("bad_entries"), "raw")


def ingest(df: DataFrame, ingest_ts: Column | datetime | None = None) -> DataFrame:
    """Single entries ready for the raw topic: valid, with defaults and ``log_id``."""
    return apply_defaults(validate(df)[0], ingest_ts)
