"""Queries on what is derived from the records and kept: sketches, dated rules, the file index."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.operators import summaries
from logstream.operators.dated_rules import detect_dated
from logstream.operators.sketches import distinct_minutes, distinct_over
from logstream.operators.summaries import read_summaries, replace_days
from logstream.operators.thresholds import above, daily_sketches, thresholds
from logstream.plans import fixture as fx
from logstream.plans.lookups import FOUND, RECENT_SQL
from logstream.plans.registry import query
from logstream.plans.storage import stream_config
from logstream.session import scratch, stored
from logstream.sources.indexed import search_indexed, write_indexed
from logstream.streaming import jobs
from logstream.streaming.sinks import read_latest

# --- sketches ----------------------------------------------------------------


@query("""SELECT date_trunc('hour', "timestamp") AS hour_start, service, count(*) AS "rows",
    count(DISTINCT host) AS hosts FROM arrived GROUP BY ALL""")
def stream_hosts_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts per hour and service, from the sketches per minute that a stream has stored."""
    path = scratch(spark, "hosts")
    jobs.start_hosts(spark, stream_config(spark, sf_dir), path).awaitTermination()
    minutes = read_latest(spark, path, jobs.HOSTS_KEY)
    hours = distinct_over(minutes, "hour", ("service",))
    return hours.select(fx.ntz("hour_start"), "service", "rows", F.col("distinct").alias("hosts"))


@query("""SELECT date_trunc('day', "timestamp") AS day_start, count(*) AS "rows",
    count(DISTINCT host) AS hosts FROM logs GROUP BY ALL""")
def hosts_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts per day over all services, united from the same rows of minutes and services."""
    minutes = stored(distinct_minutes(fx.logs(spark, sf_dir)), "minutes")
    days = distinct_over(minutes, "day", ())
    return days.select(fx.ntz("day_start"), "rows", F.col("distinct").alias("hosts"))


@query("""SELECT service, count(DISTINCT trace_id) AS traces, true AS within_5_percent
FROM logs GROUP BY service""")
def distinct_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of traces per service: the united estimate beside the exact count."""
    logs = fx.logs(spark, sf_dir)
    minutes = stored(distinct_minutes(logs, "trace_id"), "minutes")
    months = distinct_over(minutes, "year", ("service",)).select("service", "distinct")
    exact = logs.groupBy("service").agg(F.countDistinct("trace_id").alias("traces"))
    close = F.abs(F.col("distinct") - F.col("traces")) <= 0.05 * F.col("traces")
    return exact.join(months, "service").select("service", "traces", close.alias("within_5_percent"))


WEEK = (date(2024, 1, 8), date(2024, 1, 14))
WEEK_SQL = """CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"""


def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with a measure that hardly repeats: seconds of the day, unevenly stretched."""
    logs = fx.logs(spark, sf_dir)
    second = (F.hour("timestamp") * 60 + F.minute("timestamp")) * 60 + F.second("timestamp")
    return logs.withColumn("measure", F.pow(second.cast("double"), 2))


SIZE_SQL = """(SELECT *, CAST(pow((hour("timestamp") * 60 + minute("timestamp")) * 60
    + second("timestamp"), 2) AS DOUBLE) AS measure FROM logs)"""


@query(f"""SELECT service, count(*) AS n, true AS within_1_percent FROM {SIZE_SQL}
WHERE {WEEK_SQL} GROUP BY service""")
def moving_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % quantile of a week per service, merged from daily sketches, beside its true rank."""
    rows = _size(spark, sf_dir)
    limits = thresholds(stored(daily_sketches(rows, F.col("measure")), "sketches"), 0.95, *WEEK)
    week = rows.where(F.to_date("timestamp").between(*map(F.lit, WEEK)))
    judged = above(week, limits, F.col("measure")).groupBy("service").agg(
        F.count("*").alias("n"),
        F.avg((F.col("measure") < F.col("threshold")).cast("int")).alias("below"),
        F.avg((F.col("measure") <= F.col("threshold")).cast("int")).alias("up_to"),
    )
    # A value has the ranks from those below it to those up to it; one row has a rank of its own.
    room = 0.01 + 1 / F.col("n")
    close = (F.col("below") - room <= 0.95) & (F.col("up_to") + room >= 0.95)
    return judged.select("service", "n", close.alias("within_1_percent"))


# --- dated rules -------------------------------------------------------------

# Three versions of each service's rules: valid_from, position, name, kind, argument, score.
RULES = (
    ("2024-01-01 00:00:00", 1, "fatal", "level_is", "FATAL", 1.0),
    ("2024-01-01 00:00:00", 2, "long", "longer_than", "1000", 0.4),
    ("2024-01-10 06:30:00", 1, "panic", "mentions", "PANIC", 0.9),
    ("2024-01-10 06:30:00", 2, "errors", "level_is", "ERROR", 0.6),
    ("2024-01-10 06:30:00", 3, "long", "longer_than", "2000", 0.7),
    ("2024-01-20 12:00:00", 1, "refused", "mentions", "refused", 0.5),
    ("2024-01-20 12:00:00", 2, "early", "before_hour", "6", 0.2),
)
# auth-service has no rules before the 10th.
HAS_RULE = "NOT (service = 'auth-service' AND valid_from < TIMESTAMP '2024-01-10 00:00:00')"
RULES_SQL = f"""(SELECT * FROM (SELECT DISTINCT service FROM logs), (SELECT
        CAST(valid_from AS TIMESTAMP) AS valid_from, position, name, kind, argument,
        CAST(score AS DOUBLE) AS score
    FROM (VALUES {", ".join(map(str, RULES))}) AS rule (valid_from, position, name, kind, argument, score))
WHERE {HAS_RULE})"""


def _rules(logs: DataFrame) -> DataFrame:
    fields = ("valid_from", "position", "name", "kind", "argument", "score")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, rule)]) for rule in RULES]
    rules = logs.select("service").distinct().select("service", F.inline(F.array(*rows)))
    return rules.withColumn("valid_from", F.col("valid_from").cast("timestamp")).where(HAS_RULE)


@query(f"""SELECT event_id, rules_from, arg_min(name, position) FILTER (met) AS matched_rule,
    coalesce(max(score) FILTER (met), 0.0) AS anomaly_score, coalesce(bool_or(met), false) AS is_anomaly
FROM (SELECT l.*, v.valid_from AS rules_from FROM logs l
        ASOF LEFT JOIN (SELECT DISTINCT service, valid_from FROM {RULES_SQL}) v
        ON l.service = v.service AND l."timestamp" >= v.valid_from)
    LEFT JOIN (SELECT service AS of_service, valid_from, position, name, kind, argument, score
        FROM {RULES_SQL}) r ON service = of_service AND rules_from = r.valid_from,
    LATERAL (SELECT coalesce(CASE kind WHEN 'level_is' THEN level = argument
        WHEN 'mentions' THEN contains(lower(message), lower(argument))
        WHEN 'longer_than' THEN length(message) > TRY_CAST(argument AS DOUBLE)
        WHEN 'before_hour' THEN hour("timestamp") < TRY_CAST(argument AS DOUBLE) END, false) AS met)
GROUP BY event_id, rules_from""")
def detect_dated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record judged by the rules that were in force at its time."""
    logs = fx.logs(spark, sf_dir)
    found = detect_dated(logs, _rules(logs), fx.run_time())
    return found.select("event_id", fx.ntz("rules_from"), "matched_rule", "anomaly_score", "is_anomaly")


# --- searches that skip files ------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    root = scratch(spark, "indexed")
    write_indexed(fx.logs(spark, sf_dir), root, file_rows=500)
    return root


@query("""SELECT "timestamp", level, message, service, host, trace_id FROM logs
WHERE trace_id = (SELECT max(trace_id) FROM logs)""")
def search_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace out of all days, from the file that the index names."""
    wanted = fx.logs(spark, sf_dir).agg(F.max("trace_id")).first()[0]
    return search_indexed(spark, _indexed(spark, sf_dir), trace_id=wanted).select(*FOUND)


@query("""SELECT "timestamp", level, message, service, host, trace_id FROM logs
WHERE service = 'payment-service' AND level = 'ERROR'
    AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-20 00:00:00'
ORDER BY "timestamp" DESC, trace_id LIMIT 50""")
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest errors of a service in a fortnight, from the newest files that can hold them."""
    span = {"start": datetime(2024, 1, 5), "end": datetime(2024, 1, 20)}
    found = search_indexed(
        spark, _indexed(spark, sf_dir), 50, level="ERROR", service="payment-service", **span
    )
    return found.select(*FOUND)


# --- results kept up to date ---------------------------------------------------


def _summaries(spark: SparkSession, sf_dir: str) -> str:
    """Three increments of some days each, one of which is played again."""
    found, path = stored(fx.detected(spark, sf_dir), "found"), scratch(spark, "summaries")
    day = F.dayofmonth("timestamp")
    for first, last in ((1, 10), (11, 20), (21, 31), (11, 20)):
        replace_days(found.where(day.between(first, last)), path, "label")
    return path


@query("""SELECT date_trunc('hour', "timestamp") AS bucket,
    CAST(count_if(is_anomaly) AS BIGINT) AS anomalies,
    CAST(count_if(NOT is_anomaly) AS BIGINT) AS normal FROM scored GROUP BY 1""")
def kept_anomaly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.kept_trend(read_summaries(spark, _summaries(spark, sf_dir)))


@query(RECENT_SQL)
def kept_recent_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.kept_recent_anomalies(spark, _summaries(spark, sf_dir))


@query("""SELECT max(now) AS "timestamp",
    round(sum(hour_logs) / 3600, 9) AS logs_per_second,
    CAST(sum(day_logs) AS BIGINT) AS total_logs_today,
    round(coalesce(sum(day_errors) / nullif(sum(day_logs), 0), 0), 9) AS error_rate,
    CAST(sum(hour_anomalies) AS BIGINT) AS detected_last_hour,
    CAST(sum(hour_critical) AS BIGINT) AS critical_alerts,
    round(sum(day_right) / nullif(sum(day_logs), 0), 9) AS detection_accuracy,
    CAST(count_if(hour_logs > 0 AND hour_errors / hour_logs < 0.3) AS BIGINT) AS healthy,
    CAST(count_if(hour_logs > 0 AND hour_errors / hour_logs >= 0.3
        AND hour_errors / hour_logs < 0.6) AS BIGINT) AS degraded,
    CAST(count_if(hour_logs = 0 OR hour_errors / hour_logs >= 0.6) AS BIGINT) AS down
FROM (SELECT service, any_value(now) AS now, count_if(in_hour) AS hour_logs,
        count_if(in_hour AND error) AS hour_errors,
        count_if(in_hour AND is_anomaly) AS hour_anomalies,
        count_if(in_hour AND is_anomaly AND severity = 'CRITICAL') AS hour_critical,
        count_if(today) AS day_logs, count_if(today AND error) AS day_errors,
        count_if(today AND is_anomaly = label) AS day_right
    FROM (SELECT *, coalesce(level IN ('ERROR', 'FATAL'), false) AS error,
            "timestamp" >= now - INTERVAL 1 HOUR AS in_hour,
            "timestamp" >= date_trunc('day', now) AS today
        FROM scored, (SELECT TIMESTAMP '2024-01-25 18:30:00' AS now) WHERE "timestamp" < now)
    GROUP BY service)""")
def kept_platform_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as of a whole minute, of days that were kept."""
    at = datetime(2024, 1, 25, 18, 30)
    row = summaries.kept_snapshot(spark, _summaries(spark, sf_dir), at)
    flat = row.select("timestamp", "ingestion.*", "anomalies.*", "services.*")
    return flat.withColumns(
        {c: F.round(c, 9) for c in ("logs_per_second", "error_rate", "detection_accuracy")}
    )
