"""Results kept up to date: mergeable rows per minute and service, a day replaced at a time.

Whatever a day's records, it is kept as at most a row per minute, service and severity. Trend, recent anomalies
and the platform's state are read from these rows; no record is read again.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstream.functions.clock import utc, utc_day
from logstream.functions.codes import is_error
from logstream.operators.alerts import description
from logstream.operators.search import anomaly_rows, check_limit
from logstream.operators.sketches import LOG_SIZE
from logstream.operators.stats import snapshot_row
from logstream.session import folders

_KEY = ("minute", "service", "severity")


def summarise(df: DataFrame, label: str | None = None) -> DataFrame:
    """Scored records as a row per minute, service and severity; records without a time have none.

    Counts, the greatest score, the newest anomaly with its description and a sketch of the hosts with
    anomalies: all of them merge, map-side here and over any longer time later. ``label`` names the true flag.
    """
    flagged = F.col("is_anomaly")
    known = F.col(label).isNotNull() if label else F.lit(False)
    right = known & (flagged == F.col(label)) if label else F.lit(False)
    latest = F.struct("timestamp", "trace_id", description().alias("description"))
    host = F.when(flagged, F.col("host"))
    minute = F.date_trunc("minute", "timestamp").cast(df.schema["timestamp"].dataType)
    return (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(minute.alias("minute"), "service", "severity")
        .agg(
            F.count("*").alias("logs"),
            F.count_if(is_error(F.col("level"))).alias("errors"),
            F.count_if(flagged).alias("anomalies"),
            F.count_if(known).alias("labelled"),
            F.count_if(right).alias("right"),
            F.max(F.when(flagged, F.col("anomaly_score"))).alias("score"),
            F.max(F.when(flagged, latest)).alias("latest"),
            F.hll_sketch_agg(host, LOG_SIZE).alias("hosts"),
        )
    )


def replace_days(df: DataFrame, path: str, label: str | None = None) -> None:
    """Writes the rows of all days that ``df`` has records of, each in place of what was there.

    ``df`` holds these days whole. Done again, it leaves the same; other days are not touched.
    """
    rows = summarise(df, label).withColumn("day", F.to_date("minute"))
    writer = rows.hint("rebalance", "day").sortWithinPartitions(*_KEY).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def summary_days(spark: SparkSession, path: str) -> list[date]:
    """The days that are kept, oldest first, from the folder names."""
    names = [name.partition("=")[2] for name in folders(spark, path) if name.startswith("day=")]
    return sorted(date.fromisoformat(name) for name in names)


def read_summaries(
    spark: SparkSession, path: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """The rows of the days from ``start`` to ``end``, both included."""
    rows = spark.read.schema(_columns(spark, path)).parquet(path)
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end))
    return rows


def _columns(spark: SparkSession, path: str) -> T.StructType:
    """The columns, from the newest day alone."""
    newest = spark.read.parquet(f"{path.rstrip('/')}/day={summary_days(spark, path)[-1]}").schema
    return T.StructType([*newest.fields, T.StructField("day", T.DateType())])


def kept_trend(summaries: DataFrame, unit: str = "hour") -> DataFrame:
    """Flagged and normal records per unit of time."""
    kind = summaries.schema["minute"].dataType
    bucket = F.date_trunc(unit, "minute").cast(kind).alias("bucket")
    sums = F.sum("anomalies").alias("anomalies"), F.sum("logs").alias("logs")
    by_unit = summaries.groupBy(bucket).agg(*sums)
    return by_unit.select("bucket", "anomalies", (F.col("logs") - F.col("anomalies")).alias("normal"))


def kept_recent_anomalies(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The groups of anomalies with the latest records, from the newest days that hold ``limit`` groups."""
    check_limit(limit)
    days = summary_days(spark, path)
    groups, taken, step = None, 0, 1
    while taken < len(days):
        taken, step = min(taken + step, len(days)), step * 2
        groups = _anomaly_groups(read_summaries(spark, path, days[-taken]))
        if groups.limit(limit).count() >= limit:
            break
    if groups is None:
        raise ValueError(f"nothing is kept at {path}")
    return anomaly_rows(groups).orderBy(F.desc("timestamp"), "service", "severity").limit(limit)


def _anomaly_groups(summaries: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "minute").cast(summaries.schema["minute"].dataType)
    flagged = summaries.where("anomalies > 0")
    return flagged.groupBy("service", "severity", hour.alias("hour")).agg(
        F.max("latest").alias("latest"),
        F.max("score").alias("score"),
        F.hll_sketch_estimate(F.hll_union_agg("hosts")).alias("affected_hosts"),
    )


def kept_snapshot(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    """The state of the platform as of a whole minute, which itself does not count.

    Counts are read from today and yesterday alone; of other days only the names of their services.
    """
    if as_of.second or as_of.microsecond:
        raise ValueError(f"{as_of} is no whole minute")
    day = utc_day(as_of)
    recent = read_summaries(spark, path, day - timedelta(days=1), day)
    kind = recent.schema["minute"].dataType
    now = utc(as_of).cast(kind)
    minute = F.col("minute")
    in_hour = minute >= now - F.expr("INTERVAL 1 HOUR")
    today = minute >= F.date_trunc("day", now).cast(kind)

    def total(count: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(count))), F.lit(0))

    per_service = recent.where(minute < now).groupBy("service").agg(
        total("logs", in_hour).alias("hour_logs"),
        total("errors", in_hour).alias("hour_errors"),
        total("anomalies", in_hour).alias("hour_anomalies"),
        total("anomalies", in_hour & (F.col("severity") == "CRITICAL")).alias("hour_critical"),
        total("logs", today).alias("day_logs"),
        total("errors", today).alias("day_errors"),
        total("labelled", today).alias("day_labelled"),
        total("right", today).alias("day_right"),
    )
    known = read_summaries(spark, path, end=day).where(minute < now)
    known = known.select(F.col("service").alias("known_service")).distinct()
    joined = known.join(per_service, F.expr("known_service <=> service"), "left").drop("known_service")
    return snapshot_row(joined, now)
