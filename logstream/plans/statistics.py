"""Queries over many records: window statistics, counters, topics, quality, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.operators import alerts as al
from logstream.operators import stats, topics
from logstream.operators.evaluate import confusion_matrix
from logstream.operators.forecast import service_load_trend
from logstream.plans import fixture as fx
from logstream.plans.registry import query


def window_sql(source: str, width: str, slide: str) -> str:
    """Each record in its two windows; ``width`` is twice the ``slide``."""
    return f"""SELECT window_start, window_start + INTERVAL '{width}' AS window_end, service, level,
    count(*) AS total_logs, CAST(count_if(is_anomaly) AS BIGINT) AS anomaly_count,
    round(avg(anomaly_score), 9) AS avg_anomaly_score, max(anomaly_score) AS max_anomaly_score,
    round(count_if(is_anomaly) / count(*), 9) AS anomaly_rate
FROM (SELECT *, time_bucket(INTERVAL '{slide}', "timestamp") AS window_start FROM {source}
    UNION ALL
    SELECT *, time_bucket(INTERVAL '{slide}', "timestamp") - INTERVAL '{slide}' FROM {source})
GROUP BY ALL"""


def rounded(stats_rows: DataFrame) -> DataFrame:
    return stats_rows.withColumns(
        {c: F.round(c, 9) for c in ("avg_anomaly_score", "anomaly_rate")}
    )


@query(window_sql("scored", "1 minute", "30 seconds"))
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.window_stats(fx.detected(spark, sf_dir)))


@query(window_sql("scored", "1 hour", "30 minutes"))
def window_stats_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.window_stats(fx.detected(spark, sf_dir), "1 hour", "30 minutes"))


@query(window_sql("scored", "1 minute", "30 seconds"))
def service_metrics_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.route(fx.detected(spark, sf_dir), "service_metrics"))


@query("""SELECT count(*) AS total, CAST(count_if(is_anomaly) AS BIGINT) AS anomalies, CAST(count_if(level IN ('ERROR', 'FATAL')) AS BIGINT) AS errors FROM scored""")
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.live_counters(fx.detected(spark, sf_dir))


@query("""SELECT 'logs' AS input, count(*) AS "rows" FROM logs
    UNION ALL SELECT 'anomalies', count(*) FROM scored WHERE is_anomaly""")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.detected(spark, sf_dir)
    return stats.count_rows(found, "logs").union(
        stats.count_rows(found.where("is_anomaly"), "anomalies")
    )


@query("""SELECT date_trunc('hour', "timestamp") AS bucket,
    CAST(count_if(is_anomaly) AS BIGINT) AS anomalies,
    CAST(count_if(NOT is_anomaly) AS BIGINT) AS normal FROM scored GROUP BY 1""")
def anomaly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.anomaly_trend(fx.detected(spark, sf_dir))


@query("""SELECT service, count(*) AS anomalies,
    CASE max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity))
        WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM scored WHERE is_anomaly GROUP BY service""")
def service_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.service_breakdown(fx.detected(spark, sf_dir))


@query("""SELECT max(now) AS "timestamp",
    round(sum(hour_logs) / 3600, 9) AS logs_per_second,
    CAST(sum(day_logs) AS BIGINT) AS total_logs_today,
    round(sum(day_errors) / sum(day_logs), 9) AS error_rate,
    CAST(sum(hour_anomalies) AS BIGINT) AS detected_last_hour,
    CAST(sum(hour_critical) AS BIGINT) AS critical_alerts,
    round(sum(day_right) / sum(day_logs), 9) AS detection_accuracy,
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
            "timestamp" > now - INTERVAL 1 HOUR AS in_hour,
            "timestamp" >= date_trunc('day', now) AS today
        FROM (SELECT * REPLACE (CASE WHEN service = 'other-service'
                AND "timestamp" < TIMESTAMP '2024-01-08 00:00:00' THEN 'retired-service'
                ELSE service END AS service) FROM scored),
            (SELECT max("timestamp") AS now FROM logs))
    GROUP BY service)""")
def platform_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service was last seen weeks ago, and is down."""
    now = fx.newest(spark, sf_dir)
    long_ago = F.col("timestamp") < F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    retired = (F.col("service") == "other-service") & long_ago
    rows = fx.detected(spark, sf_dir).withColumn(
        "service", F.when(retired, "retired-service").otherwise(F.col("service"))
    )
    row = stats.platform_snapshot(rows, now, label="label")
    flat = row.select("timestamp", "ingestion.*", "anomalies.*", "services.*")
    return flat.withColumns(
        {c: F.round(c, 9) for c in ("logs_per_second", "error_rate", "detection_accuracy")}
    )


@query("""SELECT *, round(2 * precision * recall / (precision + recall), 9) AS f1_score
FROM (SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
        tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
        round((tp + fn) / (tp + fp + fn + tn), 9) AS anomaly_rate
    FROM (SELECT CAST(count_if(label AND is_anomaly) AS BIGINT) AS tp,
            CAST(count_if(NOT label AND is_anomaly) AS BIGINT) AS fp,
            CAST(count_if(label AND NOT is_anomaly) AS BIGINT) AS fn,
            CAST(count_if(NOT label AND NOT is_anomaly) AS BIGINT) AS tn FROM scored))""")
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = confusion_matrix(fx.detected(spark, sf_dir), "label", "is_anomaly")
    return matrix.withColumns({c: F.round(c, 9) for c in ("accuracy", "anomaly_rate", "f1_score")})


# --- topics ------------------------------------------------------------------

# Bytes of the JSON text of a record: each field that is there, with name, quotes and
# comma, and one backslash more for a line break.
_TEXT_BYTES = " + ".join(
    f"coalesce(strlen({name}) + {len(name) + 6}, 0)"
    for name in ("level", "service", "host", "environment", "trace_id", "span_id")
)
VALUE_BYTES = f"""CASE WHEN event_id % 103 = 0 THEN 8 ELSE 1 + {_TEXT_BYTES}
    + coalesce(strlen(replace(message, chr(10), 'nn')) + 13, 0) + 47
    + strlen('"metadata":{{"k":,"test_data":true,"batch_id":"batch-","synthetic_anomaly":}},')
    + strlen(json_extract_string(metadata, '$.k')) + strlen(CAST(event_id // 100 AS VARCHAR))
    + CASE WHEN event_id % 20 = 0 THEN 4 ELSE 5 END END"""

TOPIC_SQL = f"""(SELECT event_id, "timestamp", CAST(event_id % 6 AS INT) AS partition,
    event_id // 6 AS "offset", {VALUE_BYTES} AS value_bytes,
    ['logs-raw', 'logs-processed', 'anomalies-detected', 'service-metrics', '__offsets']
        [CAST(event_id % 5 + 1 AS INT)] AS topic FROM logs)"""

# The next offset to read: a few behind the end, more so in high partitions;
# the last partition was never committed.
LAG_SQL = f"""SELECT topic, CAST(sum(CASE WHEN partition = 5 THEN last + 1
    ELSE least(last + 1, 1 + 30 * partition) END) AS BIGINT) AS consumer_lag
FROM (SELECT topic, partition, max("offset") AS last FROM {TOPIC_SQL} GROUP BY ALL)
GROUP BY topic"""


def _committed(env: DataFrame) -> DataFrame:
    ends = env.where(F.col("partition") < 5).groupBy("topic", "partition")
    behind = F.max("offset") - 30 * F.col("partition")
    return ends.agg(F.greatest(behind, F.lit(0)).alias("committed"))


@query(f"""SELECT topic, date_trunc('hour', "timestamp") AS window_start, count(*) AS messages,
    CAST(sum(value_bytes) AS BIGINT) AS bytes, round(count(*) / 3600, 9) AS messages_per_sec,
    round(sum(value_bytes) / 3600, 9) AS bytes_per_sec
FROM {TOPIC_SQL} GROUP BY ALL""")
def topic_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = topics.topic_throughput(fx.topic_envelope(spark, sf_dir), 3600)
    rates = rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return rates.withColumns({c: F.round(c, 9) for c in ("messages_per_sec", "bytes_per_sec")})


@query(f"""SELECT date_trunc('day', "timestamp") AS window_start, count(*) AS messages,
    CAST(sum(value_bytes) AS BIGINT) AS bytes, count(DISTINCT topic) AS topics,
    round(count(*) / 86400, 9) AS messages_per_sec,
    round(sum(value_bytes) / 86400, 9) AS bytes_per_sec
FROM {TOPIC_SQL} GROUP BY ALL""")
def cluster_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = fx.topic_envelope(spark, sf_dir)
    rates = topics.cluster_throughput(topics.topic_throughput(env, 86400), 86400)
    rates = rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return rates.withColumns({c: F.round(c, 9) for c in ("messages_per_sec", "bytes_per_sec")})


@query(LAG_SQL)
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = fx.topic_envelope(spark, sf_dir)
    return topics.consumer_lag(env, _committed(env))


@query(f"""SELECT topic, count(DISTINCT partition) AS partitions FROM {TOPIC_SQL}
WHERE NOT starts_with(topic, '_') GROUP BY topic""")
def topic_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_inventory(fx.topic_envelope(spark, sf_dir))


@query(f"""SELECT i.topic, i.partitions, coalesce(l.consumer_lag, 0) AS consumer_lag,
    coalesce(l.consumer_lag, 0) > 100 AS lagging
FROM (SELECT topic, count(DISTINCT partition) AS partitions FROM {TOPIC_SQL}
    WHERE NOT starts_with(topic, '_') GROUP BY topic) i
LEFT JOIN (SELECT * FROM ({LAG_SQL}) WHERE topic <> 'service-metrics') l USING (topic)""")
def topic_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic has no metrics and is shown with zeros."""
    env = fx.topic_envelope(spark, sf_dir)
    lag = topics.consumer_lag(env, _committed(env)).where(F.col("topic") != "service-metrics")
    return topics.topic_details(topics.topic_inventory(env), lag)


# --- trends ------------------------------------------------------------------


@query("""SELECT service, count(*) AS units, round(avg(y), 6) AS mean_load,
    round(regr_slope(y, x), 6) AS slope,
    round(regr_intercept(y, x) + regr_slope(y, x) * (max(x) + 1), 6) AS predicted_load,
    round((regr_intercept(y, x) + regr_slope(y, x) * (max(x) + 1)) / avg(y) * 100 - 100, 6)
        AS change_pct,
    round(regr_r2(y, x), 6) AS confidence
FROM (SELECT s.service, date_diff('hour', s.lo, s.h) AS x, coalesce(c.y, 0) AS y
    FROM (SELECT service, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h
        FROM (SELECT service, date_trunc('hour', min("timestamp")) AS lo,
            date_trunc('hour', max("timestamp")) AS hi FROM logs GROUP BY service)) s
    LEFT JOIN (SELECT service, date_trunc('hour', "timestamp") AS h, count(*) AS y
        FROM logs GROUP BY ALL) c ON c.service = s.service AND c.h = s.h)
GROUP BY service""")
def load_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = service_load_trend(fx.logs(spark, sf_dir))
    return trend.withColumns(
        {
            c: F.round(c, 6)
            for c in ("mean_load", "slope", "predicted_load", "change_pct", "confidence")
        }
    )
