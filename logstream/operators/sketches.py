"""Distinct counts that add up: HyperLogLog sketches per minute, united over any longer time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Registers are two to this power: a standard error of 1.6 percent in 4 KB at most.
LOG_SIZE = 12


def distinct_minutes(
    df: DataFrame,
    what: str = "host",
    by: Sequence[str] = ("service",),
    watermark: str = "5 minutes",
    log_size: int = LOG_SIZE,
) -> DataFrame:
    """Per minute and group a sketch of the values of ``what``, and the number of rows.

    The same on tables and streams. Sketches merge map-side, so a hot group sends one per task and minute.
    NULL values are no value; a group that has no other has an empty sketch.
    """
    if df.isStreaming:
        df = df.withWatermark("timestamp", watermark)
    grouped = df.groupBy(F.window("timestamp", "1 minute").alias("window"), *by)
    return grouped.agg(
        F.count("*").alias("rows"),
        F.hll_sketch_agg(F.col(what).cast("string"), log_size).alias("sketch"),
    ).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *by,
        "rows",
        "sketch",
    )


def distinct_over(minutes: DataFrame, unit: str = "hour", by: Sequence[str] = ("service",)) -> DataFrame:
    """Rows and estimated distinct values per ``unit`` of time and group, from rows of minutes.

    Reads no record: a value that came in many minutes, or in several of the groups that ``by`` leaves out,
    counts once.
    """
    start = F.date_trunc(unit, "window_start").alias(f"{unit}_start")
    united = minutes.groupBy(start, *by).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch")
    )
    return united.select(
        f"{unit}_start", *by, "rows", F.hll_sketch_estimate("sketch").alias("distinct")
    )
