"""Alert rows and the feeds made of detected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstream import model
from logstream.functions import ids
from logstream.operators.features import feature_engineering
from logstream.operators.stats import window_stats

DESCRIBED_CHARS = 100
# What tells records of one time apart; the last three are the broker position.
IDENTITY = ("trace_id", "span_id", "service", "host", "message", "topic", "partition", "offset")


def description() -> Column:
    """One sentence with the head of the message; NULL if service or message is."""
    head = F.substring("message", 1, DESCRIBED_CHARS)
    return F.concat(F.lit("Anomaly detected in "), F.col("service"), F.lit(" service: "), head)


def to_alerts(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The flagged records as alerts.

    The id hashes what tells records apart, and the broker position where the
    input has one, so a replay gives the same ids and no two records share one.
    """
    ts = F.col("timestamp")
    told = [F.date_format(ts, "yyyyMMddHHmmssSSSSSS")]
    told += [F.col(c) for c in IDENTITY if c in df.columns]
    return df.where("is_anomaly").select(
        ids.alert_id(ts, *told).alias("alert_id"),
        (F.current_timestamp() if as_of is None else as_of).alias("detection_timestamp"),
        ts.alias("log_timestamp"),
        "service",
        "level",
        "host",
        "environment",
        "message",
        "anomaly_score",
        "severity",
        description().alias("description"),
        "trace_id",
        "span_id",
    )


def high_priority(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("severity") == "CRITICAL")


def route(detected: DataFrame, name: str, as_of: Column | None = None) -> DataFrame:
    """The rows a named feed receives, from the output of the rule detector."""
    if name == "processed":
        return detected
    if name == "anomalies":
        return to_alerts(detected, as_of)
    if name == "high_priority":
        return high_priority(to_alerts(detected, as_of))
    if name == "service_metrics":
        return window_stats(detected)
    if name == "training":
        return feature_engineering(detected.select(*_raw_columns(detected)))
    raise ValueError(f"unknown feed {name!r}; known: {sorted(set(model.TOPICS) - {'raw'})}")


def _raw_columns(df: DataFrame) -> list[str]:
    kept = (*model.LOG_FIELDS, "is_anomaly")
    return [c for c in df.columns if c in kept]
