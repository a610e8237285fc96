"""Throughput, backlog and inventory of topics, from the broker envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Backlog above which a topic is shown as lagging.
LAG_LIMIT = 100


def topic_throughput(env: DataFrame, width_seconds: int = 60) -> DataFrame:
    """Messages and bytes per second, by topic and window."""
    span = F.window("timestamp", f"{width_seconds} seconds")
    return (
        env.groupBy("topic", span.alias("window"))
        .agg(
            F.count("*").alias("messages"),
            F.sum(F.octet_length("value")).alias("bytes"),
        )
        .select(
            "topic",
            F.col("window.start").alias("window_start"),
            "messages",
            "bytes",
            (F.col("messages") / width_seconds).alias("messages_per_sec"),
            (F.col("bytes") / width_seconds).alias("bytes_per_sec"),
        )
    )


def cluster_throughput(by_topic: DataFrame, width_seconds: int = 60) -> DataFrame:
    """All topics together, by window, from the throughput by topic."""
    return by_topic.groupBy("window_start").agg(
        F.sum("messages").alias("messages"),
        F.sum("bytes").alias("bytes"),
        F.count("topic").alias("topics"),
        (F.sum("messages") / width_seconds).alias("messages_per_sec"),
        (F.sum("bytes") / width_seconds).alias("bytes_per_sec"),
    )


def consumer_lag(env: DataFrame, committed: DataFrame) -> DataFrame:
    """Records behind, per topic; ``committed`` is the next offset a group reads.

    A partition without a commit counts from offset 0. Both sides of the join
    are down to one row per topic and partition.
    """
    ends = env.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    behind = F.col("end_offset") - F.coalesce("committed", F.lit(0))
    return (
        ends.join(committed, ["topic", "partition"], "left")
        .groupBy("topic")
        .agg(F.sum(F.greatest(behind, F.lit(0))).alias("consumer_lag"))
    )


def topic_inventory(env: DataFrame) -> DataFrame:
    """Partitions per topic; internal topics, named ``_...``, are hidden."""
    return (
        env.where(~F.col("topic").startswith("_"))
        .groupBy("topic")
        .agg(F.countDistinct("partition").alias("partitions"))
    )


def topic_details(inventory: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each topic with its metrics; a topic without any gets zeros.

    ``metrics`` holds ``topic`` and any of messages_per_sec, bytes_per_sec and
    consumer_lag, one row per topic.
    """
    numbers = [c for c in metrics.columns if c != "topic"]
    joined = inventory.join(metrics, "topic", "left").fillna(0, subset=numbers)
    if "consumer_lag" in numbers:
        joined = joined.withColumn("lagging", F.col("consumer_lag") > LAG_LIMIT)
    return joined
