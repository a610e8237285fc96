"""Rows that come after the watermark: kept, and merged into the windows that were closed without them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.streaming.sinks import STATS_KEY

LATE_COLUMNS = (*STATS_KEY, "timestamp", "is_anomaly", "anomaly_score", "trace_id")


def late_bound(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """The watermark, in milliseconds, below which a micro-batch drops rows.

    It is what the query's own offset log says of the micro-batch before: with several stateful
    operators in a row a stream lets rows pass until the next one. The log is written before a
    micro-batch runs, so a replay finds the same bound.
    """
    if batch_id == 0:
        return 0
    path = f"{checkpoint.rstrip('/')}/offsets/{batch_id - 1}"
    lines = spark.read.text(path, wholetext=True).first()[0].splitlines()
    return json.loads(lines[1])["batchWatermarkMs"]


def before_bound(bound_ms: int) -> Column:
    """Whether a row can be late for a window: it is older than the bound."""
    return F.col("timestamp") < F.timestamp_millis(F.lit(bound_ms))


def late_entries(rows: DataFrame, bound_ms: int, width: str, slide: str) -> DataFrame:
    """Each row once for every window of it that ended by the bound, with that window."""
    bound = F.timestamp_millis(F.lit(bound_ms))
    # A row that is not older than the bound has no such window: most rows stop here.
    entries = rows.where(before_bound(bound_ms)).withColumn("window", F.window("timestamp", width, slide))
    entries = entries.where(F.col("window.end") <= bound)
    ends = {"window_start": F.col("window.start"), "window_end": F.col("window.end")}
    return entries.withColumns(ends).select(*LATE_COLUMNS)


def merged_windows(stats: DataFrame, late: DataFrame) -> DataFrame:
    """Window statistics with the late entries in them, also windows that had no other row.

    Counts add up, the mean weighs by them; each key comes once from either side.
    """
    measures = ("total_logs", "anomaly_count", "score_sum", "max_anomaly_score")
    known = stats.withColumn("score_sum", F.col("avg_anomaly_score") * F.col("total_logs"))
    late = late.groupBy(*STATS_KEY).agg(
        F.count("*").alias("total_logs"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.sum("anomaly_score").alias("score_sum"),
        F.max("anomaly_score").alias("max_anomaly_score"),
    )
    both = known.select(*STATS_KEY, *measures).union(late.select(*STATS_KEY, *measures))
    return (
        both.groupBy(*STATS_KEY)
        .agg(
            *[F.sum(c).alias(c) for c in measures[:3]],
            F.max("max_anomaly_score").alias("max_anomaly_score"),
        )
        .select(
            *STATS_KEY,
            "total_logs",
            "anomaly_count",
            (F.col("score_sum") / F.col("total_logs")).alias("avg_anomaly_score"),
            "max_anomaly_score",
            (F.col("anomaly_count") / F.col("total_logs")).alias("anomaly_rate"),
        )
    )
