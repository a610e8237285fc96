"""Log records derived from the ``events`` table, for Spark and for the SQL oracle.

One text per column serves both engines. Every event becomes one record; the
branches cover each detector rule, missing and unknown levels, and missing,
empty, multi-line, long and over-long messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.functions.rows import computed_once
from logstream.operators.rules import detect_v3
from logstream.session import use_utc

LOG_COLUMNS = {
    "event_id": "event_id",
    "timestamp": "ts",
    "level": """CASE WHEN event_id % 97 = 0 THEN NULL
        WHEN event_id % 89 = 0 THEN 'TRACE'
        WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'FATAL'
        WHEN event_type = 'error' THEN 'ERROR'
        WHEN event_type = 'signup' THEN 'WARN'
        WHEN event_type = 'view' THEN 'DEBUG'
        ELSE 'INFO' END""",
    "message": """CASE WHEN event_id % 101 = 0 THEN NULL
        WHEN event_id % 24 = 0 THEN 'Unhandled NullPointerException in handler'
        WHEN event_id % 24 = 1 THEN 'upstream TIMEOUT after ' || CAST(user_id AS STRING) || 'ms'
        WHEN event_id % 24 = 2 THEN 'step failed' || chr(10) || 'see trace'
        WHEN event_id % 24 = 3 THEN 'worker out of memory'
        WHEN event_id % 24 = 4 THEN 'java heap space exhausted'
        WHEN event_id % 24 = 5 THEN 'Segmentation fault at 0x0'
        WHEN event_id % 24 = 6 THEN 'connection refused by peer'
        WHEN event_id % 24 = 7 THEN 'card declined'
        WHEN event_id % 24 = 8 THEN 'unauthorized token'
        WHEN event_id % 24 = 9 THEN repeat('abcdefghij', 201)
        WHEN event_id % 24 = 10 THEN repeat('w ', 160)
        WHEN event_id % 24 = 11 THEN repeat('x', 1200)
        WHEN event_id % 24 = 12 THEN 'slow  query, high load'
        WHEN event_id % 24 = 13 THEN ''
        WHEN event_id % 24 = 14 THEN 'kernel PANIC'
        WHEN event_id % 24 = 15 AND event_id % 7 = 0 THEN repeat('y', 10001)
        ELSE 'request served in ' || CAST(user_id AS STRING) || ' ms' END""",
    "service": """CASE user_id % 6 WHEN 0 THEN 'user-service' WHEN 1 THEN 'payment-service'
        WHEN 2 THEN 'inventory-service' WHEN 3 THEN 'notification-service'
        WHEN 4 THEN 'auth-service' ELSE 'other-service' END""",
    "host": "'host-' || CAST(user_id % 7 AS STRING)",
    "environment": """CASE WHEN event_id % 20 = 0 THEN 'development'
        WHEN event_id % 20 < 4 THEN 'staging' ELSE 'production' END""",
    "metadata": "props",
    "trace_id": "'trace-' || CAST(event_id AS STRING)",
    "span_id": "'span-' || CAST(event_id % 1000 AS STRING)",
}

# The label of the generators: one record in twenty.
LABEL = "event_id % 20 = 0"
# A time after all events, in place of the clock.
RUN_TIME = "2024-02-01 00:00:00"


def run_time() -> Column:
    return F.lit(RUN_TIME).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records. Filters on the time still reach the scan."""
    columns = {name: F.expr(sql).alias(name) for name, sql in LOG_COLUMNS.items()}
    stored = [columns.pop(name) for name in ("event_id", "timestamp", "metadata")]
    derived = computed_once(F.struct(*columns.values()))
    return events(spark, sf_dir).select(*stored, derived)


def newest(spark: SparkSession, sf_dir: str) -> Column:
    """Time of the last event; reads one column of the table."""
    return events(spark, sf_dir).select(F.max("ts")).scalar()


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with flag, score and severity, and the label."""
    return detect_v3(logs(spark, sf_dir)).withColumn("label", F.expr(LABEL))


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a topic holds them; one value in 103 is not JSON."""
    event_id = F.col("event_id")
    metadata = F.struct(
        F.get_json_object("metadata", "$.k").cast("bigint").alias("k"),
        F.lit(True).alias("test_data"),
        F.concat(F.lit("batch-"), F.expr("event_id DIV 100")).alias("batch_id"),
        F.expr(LABEL).alias("synthetic_anomaly"),
    )
    wire_time = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    record = F.struct(
        wire_time.alias("timestamp"),
        *["level", "message", "service", "host", "environment"],
        metadata.alias("metadata"),
        *["trace_id", "span_id"],
    )
    value = F.when(event_id % 103 == 0, F.lit("not json")).otherwise(F.to_json(record))
    return logs(spark, sf_dir).select(
        F.col("service").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit("logs-raw").alias("topic"),
        (event_id % 6).cast("int").alias("partition"),
        F.expr("event_id DIV 6").alias("offset"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
    )


def topic_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope spread over five topics, one of them internal."""
    names = ["logs-raw", "logs-processed", "anomalies-detected", "service-metrics", "__offsets"]
    topic = F.element_at(
        F.array(*map(F.lit, names)), (F.col("offset") * 6 + F.col("partition")).cast("int") % 5 + 1
    )
    return envelope(spark, sf_dir).withColumn("topic", topic)


def ntz(name: str) -> Column:
    """A zoned time as the plain UTC time that the oracle compares."""
    return F.col(name).cast("timestamp_ntz").alias(name)


# --- oracle side -------------------------------------------------------------

LOGS_SQL = "SELECT {} FROM events".format(
    ",\n".join(f'{sql} AS "{name}"' for name, sql in LOG_COLUMNS.items())
)

FEATURES_SQL = """SELECT *,
    CAST(hour("timestamp") AS INT) AS hour,
    CAST(dayofweek("timestamp") + 1 AS INT) AS day_of_week,
    CAST(length(message) AS INT) AS message_length,
    CAST(len(string_split(message, ' ')) AS INT) AS word_count,
    CAST(CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2
         WHEN 'ERROR' THEN 3 WHEN 'FATAL' THEN 4 ELSE 1 END AS INT) AS level_numeric,
    CAST(regexp_matches(message, '(?i)exception') AS INT) AS has_exception,
    CAST(regexp_matches(message, '(?i)timeout') AS INT) AS has_timeout,
    CAST(regexp_matches(message, '(?i)failed') AS INT) AS has_failed
FROM logs"""

SCORED_SQL = """SELECT *,
    rule IS NOT NULL AS is_anomaly,
    CASE WHEN anomaly_score >= 0.9 THEN 'CRITICAL' WHEN anomaly_score >= 0.7 THEN 'HIGH'
         WHEN anomaly_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    event_id % 20 = 0 AS label
FROM (SELECT *,
    CASE WHEN level = 'FATAL' THEN 'fatal_level'
         WHEN regexp_matches(message, '(?i)(out of memory|heap space)') THEN 'memory_text'
         WHEN regexp_matches(message, '(?i)segmentation fault') THEN 'crash_text'
         WHEN regexp_matches(message,
             '(?i)(exception|error|failed|timeout|refused|panic|critical)') THEN 'failure_text'
         WHEN message_length > 2000 THEN 'very_long_message'
         WHEN word_count > 150 THEN 'many_words'
         WHEN hour < 6 AND level IN ('ERROR', 'FATAL') THEN 'early_error'
         WHEN service = 'payment-service' AND regexp_matches(message, '(?i)declined')
             THEN 'payment_declined'
         WHEN service = 'auth-service' AND regexp_matches(message, '(?i)unauthorized')
             THEN 'auth_unauthorized'
    END AS rule,
    CAST(CASE WHEN level = 'FATAL' THEN 1.0
         WHEN regexp_matches(message, '(?i)(out of memory|heap space)') THEN 0.95
         WHEN level = 'ERROR' THEN 0.8 WHEN has_exception = 1 THEN 0.7
         WHEN has_timeout = 1 THEN 0.6 WHEN has_failed = 1 THEN 0.5 ELSE 0.1 END AS DOUBLE)
    AS anomaly_score
FROM features)"""

# What is left of the records after a trip through the envelope.
ARRIVED_SQL = "SELECT * FROM scored WHERE event_id % 103 <> 0"



def digest_sql(*parts: str) -> str:
    """md5 over the parts, each with its length, as the ids have it."""
    told = [f"coalesce(length({part}) || ':' || {part}, '-')" for part in parts]
    return "md5(" + " || '|' || ".join(told) + ")"


TIME_TEXT = """strftime("timestamp", '%Y%m%d%H%M%S%f')"""

# An anomaly as an alert; {digest} is over the record and its broker position, where it has one.
ALERTS_SQL = """SELECT
    'alert_' || strftime("timestamp", '%Y%m%d%H%M%S') || '_' || {digest} AS alert_id,
    TIMESTAMP '2024-02-01 00:00:00' AS detection_timestamp,
    "timestamp" AS log_timestamp, service, level, host, environment, message,
    anomaly_score, severity,
    'Anomaly detected in ' || service || ' service: ' || substr(message, 1, 100) AS description,
    trace_id, span_id
FROM {source} WHERE is_anomaly"""
IDENTITY_SQL = (TIME_TEXT, "trace_id", "span_id", "service", "host", "message")
POSITION_SQL = ("'logs-raw'", "CAST(event_id % 6 AS VARCHAR)", "CAST(event_id // 6 AS VARCHAR)")


def oracle(body: str) -> str:
    """``body`` with the derived inputs it may name: logs, features, scored, arrived, alerts."""
    inputs = {
        "logs": LOGS_SQL,
        "features": FEATURES_SQL,
        "scored": SCORED_SQL,
        "arrived": ARRIVED_SQL,
        "alerts": ALERTS_SQL.format(digest=digest_sql(*IDENTITY_SQL), source="scored"),
        "sent_alerts": ALERTS_SQL.format(
            digest=digest_sql(*IDENTITY_SQL, *POSITION_SQL), source="arrived"
        ),
    }
    named = ",\n".join(f"{name} AS ({sql})" for name, sql in inputs.items())
    return f"WITH {named}\n{body}"
