"""Thresholds that follow the data: quantile sketches per day, merged over any range of days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a sketch: a rank error of about 0.4 percent, also after merging.
SIZE = 800


def daily_sketches(
    df: DataFrame, measure: Column, by: Sequence[str] = ("service",), size: int = SIZE
) -> DataFrame:
    """Per day and group a KLL sketch of a measure, with its number of values.

    What is kept of a day has a bounded size, whatever its rows; sketches merge map-side. NULL and NaN are
    no values. Rows without a time belong to no day.
    """
    value = F.when(~F.isnan(measure.cast("double")), measure.cast("double"))
    return (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(F.to_date("timestamp").alias("day"), *by)
        .agg(F.count(value).alias("n"), F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"))
        .where("n > 0")
    )


def thresholds(
    sketches: DataFrame,
    quantile: float,
    start: date | None = None,
    end: date | None = None,
    by: Sequence[str] = ("service",),
) -> DataFrame:
    """The quantile of each group over the days from ``start`` to ``end``, both included.

    Reads the sketches alone: a row per day and group. ``by`` may leave groups out, which are then merged.
    """
    if not 0 <= quantile <= 1:
        raise ValueError(f"quantile must be 0..1, not {quantile}")
    if start is not None:
        sketches = sketches.where(F.col("day") >= F.lit(start))
    if end is not None:
        sketches = sketches.where(F.col("day") <= F.lit(end))
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    at = F.kll_sketch_get_quantile_double("sketch", F.lit(float(quantile)))
    return merged.select(*by, "n", at.alias("threshold"))


def above(df: DataFrame, limits: DataFrame, measure: Column, by: Sequence[str] = ("service",)) -> DataFrame:
    """All rows, with the ``threshold`` of their group and whether the measure is ``above`` it.

    A group without a threshold, and a NULL measure, is not above.
    """
    of = [F.col(c).alias(f"limit_{c}") for c in by]
    limits = limits.select(*of, F.col("threshold"))
    same = [F.col(c).eqNullSafe(F.col(f"limit_{c}")) for c in by]
    joined = df.join(limits, same, "left").drop(*[f"limit_{c}" for c in by])
    return joined.withColumn("above", F.coalesce(measure > F.col("threshold"), F.lit(False)))
