"""What running queries hold in their state, read from their checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The state of window statistics, in the order of their measures.
_WINDOW_STATE = (
    "struct<total_logs:bigint,anomaly_count:bigint,score_sum:double,scored:bigint,max_anomaly_score:double>"
)


def state_rows(
    spark: SparkSession, checkpoint: str, operator: int = 0, store: str = "default", batch_id: int | None = None
) -> DataFrame:
    """Keys and values of one stateful operator as ``key``, ``value`` and ``partition_id``.

    As of the last micro-batch, or of ``batch_id`` while its files are kept. A query may go on meanwhile.
    """
    reader = spark.read.format("statestore").option("operatorId", operator).option("storeName", store)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a query, with their stores and the micro-batches that can be read."""
    return spark.read.format("state-metadata").load(checkpoint)


def open_windows(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """The windows that statistics still wait for, with what they hold so far."""
    rows = state_rows(spark, checkpoint, batch_id=batch_id)
    held = F.col("value").cast(_WINDOW_STATE)
    return rows.select(
        F.col("key.window.start").alias("window_start"),
        F.col("key.window.end").alias("window_end"),
        F.col("key.service").alias("service"),
        F.col("key.level").alias("level"),
        held["total_logs"].alias("total_logs"),
        held["anomaly_count"].alias("anomaly_count"),
        (held["score_sum"] / held["scored"]).alias("avg_anomaly_score"),
        held["max_anomaly_score"].alias("max_anomaly_score"),
        "partition_id",
    )


def state_skew(rows: DataFrame) -> DataFrame:
    """One row: the keys of a state, the partitions that hold any, the fullest one, and its share."""
    parts = rows.groupBy("partition_id").agg(F.count("*").alias("keys"))
    return parts.agg(
        F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"),
        F.count("*").alias("partitions"),
        F.max_by("partition_id", F.struct("keys", -F.col("partition_id"))).alias("fullest"),
        F.try_divide(F.max("keys"), F.sum("keys")).alias("share"),
    )
