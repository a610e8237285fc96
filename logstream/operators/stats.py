"""Counts and rates over detected records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstream import model
from logstream.functions.clock import truncated, utc
from logstream.functions.codes import code, is_error


def is_flagged(df: DataFrame) -> Column:
    """The record's flag; an alert has none, and is flagged by its severity."""
    told = [F.col("is_anomaly")] if "is_anomaly" in df.columns else []
    told += [F.col("severity").isNotNull()] if "severity" in df.columns else []
    return F.coalesce(*told, F.lit(False))


def as_of_time(df: DataFrame, as_of: Column | datetime | None) -> Column:
    """The given time, or the newest event time of ``df`` as a scalar subquery.

    The subquery reads ``df`` once more. Where that is costly, give the time, or
    the newest time of the stored table as ``table.select(max).scalar()``.
    """
    if as_of is None:
        return df.select(F.max("timestamp")).scalar()
    return utc(as_of)


def window_stats(
    df: DataFrame,
    width: str = "1 minute",
    slide: str | None = "30 seconds",
    watermark: str | None = "5 minutes",
) -> DataFrame:
    """Sliding windows by service and level: volume, flagged share and scores.

    A stream that has its watermark already is given with ``watermark`` None.

    All measures are merged map-side, so a hot service sends one row per task,
    window and level into the shuffle.
    """
    if df.isStreaming and watermark is not None:
        df = df.withWatermark("timestamp", watermark)
    span = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return (
        df.groupBy(span.alias("window"), "service", "level")
        .agg(
            F.count("*").alias("total_logs"),
            F.count_if("is_anomaly").alias("anomaly_count"),
            F.avg("anomaly_score").alias("avg_anomaly_score"),
            F.max("anomaly_score").alias("max_anomaly_score"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "service",
            "level",
            "total_logs",
            "anomaly_count",
            "avg_anomaly_score",
            "max_anomaly_score",
            (F.col("anomaly_count") / F.col("total_logs")).alias("anomaly_rate"),
        )
    )


def live_counters(df: DataFrame) -> DataFrame:
    """Running totals: records, flagged ones, and error levels."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(is_flagged(df)).alias("anomalies"),
        F.count_if(is_error(F.col("level"))).alias("errors"),
    )


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("input"), "rows")


def observe_counts(df: DataFrame, name: str) -> DataFrame:
    """The same rows, with the counters collected as a side result of the running query."""
    return df.observe(
        name, F.count(F.lit(1)).alias("rows"), F.count_if(is_flagged(df)).alias("anomalies")
    )


def anomaly_trend(df: DataFrame, unit: str = "hour") -> DataFrame:
    """Flagged and normal records per unit of time."""
    return df.groupBy(truncated(df, unit).alias("bucket")).agg(
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(~F.col("is_anomaly")).alias("normal"),
    )


def service_breakdown(df: DataFrame) -> DataFrame:
    """Flagged records per service, with the worst severity among them."""
    rank = code(F.col("severity"), model.SEVERITY_RANKS, 0)
    names = {rank: name for name, rank in model.SEVERITY_RANKS.items()}
    worst = F.col("worst")
    return (
        df.where("is_anomaly")
        .groupBy("service")
        .agg(F.count("*").alias("anomalies"), F.max(rank).alias("worst"))
        .select(
            "service",
            "anomalies",
            F.coalesce(*[F.when(worst == r, name) for r, name in names.items()]).alias("severity"),
        )
    )


# Share of error levels at which a service counts as degraded, and as down.
DEGRADED_FROM, DOWN_FROM = 0.3, 0.6


def platform_snapshot(
    df: DataFrame,
    as_of: Column | datetime | None = None,
    label: str | None = None,
    services: DataFrame | None = None,
) -> DataFrame:
    """One row with the state of the platform at ``as_of``.

    Covers the last hour and today, and every service: one that is silent for an
    hour is down, however long ago it was last seen. ``services`` lists them in
    ``service``; without it the names are read from the whole of ``df``, and
    nothing else is. ``label`` names the true flag, for the accuracy of today's detection.
    """
    now = as_of_time(df, as_of)
    ts = F.col("timestamp")
    hour_ago = now - F.expr("INTERVAL 1 HOUR")
    day_began = F.date_trunc("day", now).cast(df.schema["timestamp"].dataType)
    recent = df.where((ts > F.least(hour_ago, day_began - F.expr("INTERVAL 1 SECOND"))) & (ts <= now))
    in_hour = ts > hour_ago
    today = ts >= day_began
    error = is_error(F.col("level"))
    flagged = F.col("is_anomaly")
    right = flagged == F.col(label) if label else F.lit(None).cast("boolean")
    known = F.col(label).isNotNull() if label else F.lit(False)
    per_service = recent.groupBy("service").agg(
        F.count_if(in_hour).alias("hour_logs"),
        F.count_if(in_hour & error).alias("hour_errors"),
        F.count_if(in_hour & flagged).alias("hour_anomalies"),
        F.count_if(in_hour & flagged & (F.col("severity") == "CRITICAL")).alias("hour_critical"),
        F.count_if(today).alias("day_logs"),
        F.count_if(today & error).alias("day_errors"),
        F.count_if(today & known).alias("day_labelled"),
        F.count_if(today & known & right).alias("day_right"),
    )
    if services is None:
        services = df.where(ts <= now)
    known_services = services.select(F.col("service").alias("known_service")).distinct()
    per_service = known_services.join(
        per_service, F.expr("known_service <=> service"), "left"
    ).drop("known_service")
    return snapshot_row(per_service, now)


def snapshot_row(per_service: DataFrame, now: Column) -> DataFrame:
    """The state of the platform from a row per known service with its counts of the last hour and today."""
    share = F.try_divide(F.col("hour_errors"), F.col("hour_logs"))
    silent = F.coalesce(F.col("hour_logs"), F.lit(0)) == 0
    total = per_service.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in per_service.columns
            if c != "service"
        ],
        F.count_if(~silent & (share < DEGRADED_FROM)).alias("healthy"),
        F.count_if(~silent & (share >= DEGRADED_FROM) & (share < DOWN_FROM)).alias("degraded"),
        F.count_if(silent | (share >= DOWN_FROM)).alias("down"),
    )
    return total.select(
        now.alias("timestamp"),
        F.struct(
            (F.col("hour_logs") / 3600).alias("logs_per_second"),
            F.col("day_logs").alias("total_logs_today"),
            F.coalesce(
                F.try_divide(F.col("day_errors"), F.col("day_logs")), F.lit(0.0)
            ).alias("error_rate"),
        ).alias("ingestion"),
        F.struct(
            F.col("hour_anomalies").alias("detected_last_hour"),
            F.col("hour_critical").alias("critical_alerts"),
            F.try_divide(F.col("day_right"), F.col("day_labelled")).alias("detection_accuracy"),
        ).alias("anomalies"),
        F.struct("healthy", "degraded", "down").alias("services"),
    )
