"""Point queries: search, recent records, the live feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.operators import alerts as al
from logstream.operators import search
from logstream.plans import fixture as fx
from logstream.plans.registry import query
from logstream.session import stored
from logstream.sources.streams import read_topics

WANTED = {
    "service": "payment-service",
    "level": "ERROR",
    "start": datetime(2024, 1, 5),
    "end": datetime(2024, 1, 20),
}
WANTED_SQL = """service = 'payment-service' AND level = 'ERROR'
    AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00'
    AND "timestamp" < TIMESTAMP '2024-01-20 00:00:00'"""
FOUND = ("timestamp", "level", "message", "service", "host", "trace_id")


@query(f"""SELECT "timestamp", level, message, service, host, trace_id FROM logs
WHERE {WANTED_SQL} ORDER BY "timestamp" DESC, trace_id LIMIT 100""")
def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_logs(fx.logs(spark, sf_dir), limit=100, **WANTED).select(*FOUND)


@query(f"""SELECT "timestamp", level, message, service, host, trace_id FROM logs
WHERE {WANTED_SQL}""")
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(fx.logs(spark, sf_dir), **WANTED).select(*FOUND)


@query(f"""SELECT count(*) AS total_count, 'payment-service' AS service, 'ERROR' AS level,
    '2024-01-05 00:00:00' AS "start", '2024-01-20 00:00:00' AS "end"
FROM logs WHERE {WANTED_SQL}""")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_summary(fx.logs(spark, sf_dir), **WANTED)
    return found.select("total_count", "filters_applied.*")


RECENT_SQL = f"""SELECT 'anom_' || {fx.digest_sql("service", "severity", "strftime(hour, '%Y%m%d%H%M%S')")}
        AS id,
    "timestamp", service, severity, score, description, affected_hosts
FROM (SELECT service, severity, date_trunc('hour', "timestamp") AS hour,
        max("timestamp") AS "timestamp", max(anomaly_score) AS score,
        arg_max(coalesce('Anomaly detected in ' || service || ' service: '
            || substr(message, 1, 100), chr(0)), "timestamp") AS told,
        nullif(told, chr(0)) AS description,
        count(DISTINCT host) AS affected_hosts
    FROM scored WHERE is_anomaly GROUP BY 1, 2, 3)
ORDER BY "timestamp" DESC, service, severity LIMIT 50"""


@query(RECENT_SQL)
def recent_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent_anomalies(fx.detected(spark, sf_dir))


FEED_SQL = """(SELECT "timestamp", level, service, message AS text, severity, anomaly_score, host,
        trace_id, is_anomaly AS flagged, '' AS alert_id FROM scored
    UNION ALL
    SELECT log_timestamp, level, service, coalesce(message, description), severity,
        anomaly_score, host, trace_id, true, alert_id FROM alerts)"""


def _feed_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = fx.detected(spark, sf_dir).drop("event_id", "label")
    return found, al.to_alerts(found, fx.run_time())


@query(f"SELECT * FROM {FEED_SQL}")
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.live_feed(*_feed_inputs(spark, sf_dir), limit=None)


@query(f"""SELECT * FROM {FEED_SQL} ORDER BY "timestamp" DESC, trace_id, alert_id LIMIT 1000""")
def live_feed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed reads the stored feeds; nothing is detected again for it."""
    return search.live_feed(*(stored(feed, "feed") for feed in _feed_inputs(spark, sf_dir)))


@query(f"""SELECT * FROM {FEED_SQL} WHERE level = 'FATAL' AND service = 'auth-service'""")
def live_feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = _feed_inputs(spark, sf_dir)
    return search.live_feed(*feeds, level="FATAL", service="auth-service", limit=None)


@query("""SELECT topic, count(*) AS "rows", CAST(count_if(flag IS NULL) AS BIGINT) AS no_flag,
    CAST(count_if(alert_id IS NULL) AS BIGINT) AS no_alert_id FROM (
    SELECT 'logs-processed' AS topic, is_anomaly AS flag, NULL AS alert_id FROM scored
    UNION ALL SELECT 'anomalies-detected', NULL, alert_id FROM alerts) GROUP BY topic""")
def topics_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of different shape read as one."""
    found, fired = _feed_inputs(spark, sf_dir)
    merged = read_topics({"logs-processed": found, "anomalies-detected": fired})
    return merged.groupBy("topic").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("is_anomaly").isNull()).alias("no_flag"),
        F.count_if(F.col("alert_id").isNull()).alias("no_alert_id"),
    )


@query("""SELECT service, date_trunc('minute', "timestamp") AS minute_start, "timestamp",
    trace_id, level, message
FROM logs, (SELECT max("timestamp") AS now FROM logs) WHERE "timestamp" > now - INTERVAL 1 HOUR""")
def recent_logs_by_service_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, now = fx.logs(spark, sf_dir), fx.newest(spark, sf_dir)
    rows = search.recent_by_service_minute(logs, now)
    return rows.select("service", "minute_start", "timestamp", "trace_id", "level", "message")


@query("""SELECT service, date_trunc('minute', "timestamp") AS minute_start, row_number() OVER (
        PARTITION BY service, minute_start ORDER BY "timestamp" DESC, trace_id) AS position, trace_id
FROM logs, (SELECT max("timestamp") AS now FROM logs) WHERE "timestamp" > now - INTERVAL 1 HOUR""")
def latest_logs_by_service_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of every service and minute of the last hour as ids, whole, newest first."""
    logs, now = fx.logs(spark, sf_dir), fx.newest(spark, sf_dir)
    rows = search.recent_by_service_minute(logs, now, positions=True)
    return rows.select("service", "minute_start", "position", "trace_id")


@query("""SELECT service, date_trunc('minute', "timestamp") AS minute_start, row_number() OVER (
        PARTITION BY service, minute_start ORDER BY "timestamp" DESC, trace_id) AS position,
    "timestamp", trace_id, level, message
FROM logs, (SELECT max("timestamp") AS now FROM logs) WHERE "timestamp" > now - INTERVAL 1 HOUR""")
def recent_positions_by_service_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the last hour with its position in the list of its service and minute."""
    logs, now = fx.logs(spark, sf_dir), fx.newest(spark, sf_dir)
    rows = search.recent_by_service_minute(logs, now, positions=True)
    return rows.select(
        "service", "minute_start", "position", "timestamp", "trace_id", "level", "message"
    )


@query("""SELECT service, CAST(position AS INT) AS position, "timestamp", trace_id, severity
FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY "timestamp" DESC, trace_id)
    AS position FROM scored WHERE is_anomaly) WHERE position <= 5""")
def top_anomalies_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.top_anomalies(fx.detected(spark, sf_dir), 5)
    return top.select("service", "position", "timestamp", "trace_id", "severity")
