"""Queries over single records: parsing, validation, features, rules, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream import model
from logstream.functions import clock, text
from logstream.operators import alerts as al
from logstream.operators import batches, features, parse, rules, validate
from logstream.operators.split import hash_split
from logstream.plans import fixture as fx
from logstream.plans.registry import query

# --- parsing -----------------------------------------------------------------


@query("""SELECT "timestamp", level, message, service, host, environment, trace_id, span_id,
    '{"k":' || json_extract_string(metadata, '$.k') || ',"test_data":true,"batch_id":"batch-'
        || (event_id // 100) || '","synthetic_anomaly":'
        || CASE WHEN label THEN 'true' ELSE 'false' END || '}' AS metadata,
    "timestamp" AS kafka_timestamp, 'logs-raw' AS topic, event_id // 6 AS offset,
    CAST(event_id % 6 AS INT) AS partition
FROM arrived""")
def parse_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.drop_incomplete(parse.parse_logs(fx.envelope(spark, sf_dir)))
    return rows.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("timestamp", "kafka_timestamp")}
    )


@query("""SELECT message, level, service, "timestamp", "timestamp" AS kafka_timestamp
FROM arrived WHERE message IS NOT NULL AND level IS NOT NULL""")
def parse_four_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.parse_logs(fx.envelope(spark, sf_dir), model.MID)
    rows = rows.drop("topic", "partition", "offset")
    return parse.drop_incomplete(rows, ("message", "level")).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("timestamp", "kafka_timestamp")}
    )


@query("""SELECT "timestamp",
    CASE WHEN event_id % 103 <> 0 THEN message END AS message,
    CASE WHEN event_id % 103 <> 0 THEN level END AS level,
    CASE WHEN event_id % 103 <> 0 THEN service END AS service FROM logs""")
def parse_three_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.parse_logs(fx.envelope(spark, sf_dir), model.MINIMAL)
    return rows.select(fx.ntz("timestamp"), "message", "level", "service")


@query("""SELECT "timestamp" AS kafka_timestamp, 'logs-raw' AS topic,
    CAST(event_id % 6 AS INT) AS partition, event_id // 6 AS offset, 'not json' AS raw
FROM logs WHERE event_id % 103 = 0""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dead = parse.split_malformed(fx.envelope(spark, sf_dir))
    return dead.withColumn("kafka_timestamp", F.col("kafka_timestamp").cast("timestamp_ntz"))


@query("""SELECT "timestamp", level, message, service, trace_id FROM arrived""")
def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = parse.split_malformed(fx.envelope(spark, sf_dir))
    return good.select(fx.ntz("timestamp"), "level", "message", "service", "trace_id")


@query("""SELECT trace_id, 'true' AS test_data, 'batch-' || (event_id // 100) AS batch_id,
    CASE WHEN label THEN 'true' ELSE 'false' END AS synthetic_anomaly,
    json_extract_string(metadata, '$.k') AS k FROM arrived""")
def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.drop_incomplete(parse.parse_logs(fx.envelope(spark, sf_dir)))
    keys = ("test_data", "batch_id", "synthetic_anomaly", "k")
    for key in keys:
        rows = parse.metadata_field(rows, key)
    return rows.select("trace_id", *keys)


@query("""SELECT "timestamp", level, message, service, host, environment, trace_id, span_id,
    is_anomaly, anomaly_score, severity FROM scored""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed records to topic values and back, at full time precision."""
    kept = ["timestamp", "level", "message", "service", "host", "environment", "trace_id"]
    kept += ["span_id", "is_anomaly", "anomaly_score", "severity"]
    sent = fx.detected(spark, sf_dir).select(*kept)
    sent = sent.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    read = F.from_json("value", sent.schema).alias("log")
    received = parse.as_values(sent).select(read).select("log.*")
    return received.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# --- validation and batches --------------------------------------------------

VALID_SQL = """(level IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL')
    AND length(message) BETWEEN 1 AND 10000) IS TRUE"""


@query(f"""SELECT trace_id, level, length(message) AS message_chars FROM logs WHERE {VALID_SQL}""")
def validate_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = validate.validate(fx.logs(spark, sf_dir))
    chars = F.length("message").cast("bigint").alias("message_chars")
    return good.select("trace_id", "level", chars)


@query(f"""SELECT trace_id, level, length(message) AS message_chars,
    concat_ws(',',
        CASE WHEN (level IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL')) IS NOT TRUE
             THEN 'level' END,
        CASE WHEN (length(message) BETWEEN 1 AND 10000) IS NOT TRUE THEN 'message' END) AS reasons
FROM logs WHERE NOT {VALID_SQL}""")
def validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = validate.validate(fx.logs(spark, sf_dir))
    chars = F.length("message").cast("bigint").alias("message_chars")
    return bad.select("trace_id", "level", chars, F.array_join("reasons", ",").alias("reasons"))


def _with_gaps(df: DataFrame) -> DataFrame:
    """Takes out some times, environments and trace ids, which the defaults fill in again."""
    return df.withColumns(
        {
            "timestamp": F.expr("CASE WHEN event_id % 19 <> 0 THEN timestamp END"),
            "environment": F.expr("CASE WHEN event_id % 17 <> 0 THEN environment END"),
            "trace_id": F.expr(
                "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN '' "
                "ELSE trace_id END"
            ),
        }
    )


FILLED_SQL = f"""SELECT event_id, level, message, service, "timestamp", environment,
    CASE WHEN event_id % 13 > 1 THEN trace_id
        ELSE 'log_' || {fx.digest_sql(fx.TIME_TEXT, "service", "message")} END AS log_id
FROM (SELECT event_id, level, message, service, trace_id,
    CASE WHEN event_id % 19 <> 0 THEN "timestamp" ELSE TIMESTAMP '2024-02-01 00:00:00' END
        AS "timestamp",
    CASE WHEN event_id % 17 <> 0 THEN environment ELSE 'production' END AS environment
    FROM logs)"""


@query(f"""SELECT event_id, "timestamp", environment, log_id FROM ({FILLED_SQL})""")
def apply_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = validate.apply_defaults(_with_gaps(fx.logs(spark, sf_dir)), fx.run_time())
    return filled.select("event_id", "timestamp", "environment", "log_id")


@query(f"""SELECT event_id, "timestamp", level, message, service, environment, log_id
FROM ({FILLED_SQL}) WHERE {VALID_SQL}""")
def ingest_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = batches.ingest(_with_gaps(fx.logs(spark, sf_dir)), fx.run_time())
    return taken.select(
        "event_id", "timestamp", "level", "message", "service", "environment", "log_id"
    )


# A third of the records share one batch; the others come in fours.
BATCH_SQL = """CASE WHEN event_id % 3 = 0 THEN 'bulk'
    WHEN event_id % 50 = 1 THEN NULL
    ELSE 'batch-' || CAST(floor(event_id / 4) AS BIGINT) END"""


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logs(spark, sf_dir).withColumn("batch_id", F.expr(BATCH_SQL))


# The batches that are taken; a record without a batch is one of its own.
TAKEN_SQL = f"""(SELECT * FROM (SELECT *, {BATCH_SQL} AS batch_id FROM logs)
WHERE CASE WHEN batch_id IS NULL THEN {VALID_SQL} ELSE batch_id IN (
    SELECT batch_id FROM (SELECT *, {BATCH_SQL} AS batch_id FROM logs)
    WHERE batch_id IS NOT NULL
    GROUP BY batch_id HAVING count(*) <= 10000 AND bool_and({VALID_SQL})) END)"""


@query(f"SELECT batch_id, event_id, level, service FROM {TAKEN_SQL}")
def batch_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = batches.accept_batches(_batched(spark, sf_dir))
    return accepted.select("batch_id", "event_id", "level", "service")


@query(f"""SELECT *, CASE WHEN failed = 0 THEN 'success' WHEN processed = 0 THEN 'refused'
    ELSE 'partial_success' END AS status
FROM (SELECT b.batch_id, count(t.event_id) AS processed, count(*) - count(t.event_id) AS failed
    FROM (SELECT *, {BATCH_SQL} AS batch_id FROM logs) b LEFT JOIN {TAKEN_SQL} t USING (event_id)
    GROUP BY b.batch_id)""")
def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.batch_outcome(_batched(spark, sf_dir))


# Batches of two: some have a bad level or time in the second entry, and some no id.
NESTED_SQL = f"""(SELECT *, {VALID_SQL} AND event_id % 11 <> 0 AND event_id % 23 <> 0 AS taken,
    CASE WHEN event_id % 13 = 0
        THEN 'batch-logs-raw-' || (event_id % 6) || '-' || (event_id // 6)
        ELSE 'batch-' || event_id END AS batch_id FROM logs)"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record arrives in a JSON batch of two."""
    event_id = F.col("event_id")
    fields = ["message", "service", "host", "environment", "trace_id"]

    def entry(part: int, level, sent):
        return F.struct(
            level.alias("level"), *fields, F.lit(f"{part}").alias("span_id"), sent.alias("timestamp")
        )

    second = F.when(event_id % 11 == 0, F.lit("LOUD")).otherwise(F.col("level"))
    sent = F.col("timestamp").cast("string")
    unclear = F.when(event_id % 23 == 0, F.lit("yesterday")).otherwise(sent)
    request = F.to_json(
        F.struct(
            F.when(event_id % 13 != 0, F.concat(F.lit("batch-"), "event_id")).alias("batch_id"),
            F.array(entry(1, F.col("level"), sent), entry(2, second, unclear)).alias("logs"),
        )
    )
    requests = fx.logs(spark, sf_dir).select(
        request.alias("value"),
        F.lit("logs-raw").alias("topic"),
        (event_id % 6).alias("partition"),
        F.expr("event_id DIV 6").alias("offset"),
    )
    return batches.judge_batches(parse.parse_batches(requests))


@query(f"""SELECT batch_id, event_id, level, service, part, "timestamp", environment
FROM (SELECT *, unnest([1, 2]) AS part FROM {NESTED_SQL} WHERE taken)""")
def ingest_nested_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches.explode_batches(_nested(spark, sf_dir), fx.run_time())
    return rows.select(
        "batch_id",
        F.substring_index("trace_id", "-", -1).cast("bigint").alias("event_id"),
        "level",
        "service",
        F.col("span_id").cast("int").alias("part"),
        fx.ntz("timestamp"),
        "environment",
    )


@query(f"""SELECT batch_id, CAST(CASE WHEN taken THEN 2 ELSE 0 END AS BIGINT) AS processed,
    CAST(CASE WHEN taken THEN 0 ELSE 2 END AS BIGINT) AS failed,
    CASE WHEN taken THEN 'success' ELSE 'refused' END AS status FROM {NESTED_SQL}""")
def nested_batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.nested_outcome(_nested(spark, sf_dir))


# --- features ----------------------------------------------------------------


@query("""SELECT event_id, hour, day_of_week, message_length, word_count, level_numeric,
    has_exception, has_timeout, has_failed FROM features""")
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_stream_features(fx.logs(spark, sf_dir))
    names = ["hour", "day_of_week", "message_length", "word_count", "level_numeric"]
    return rows.select("event_id", *names, "has_exception", "has_timeout", "has_failed")


ALL_FEATURES_SQL = """SELECT event_id, hour, day_of_week, message_length, word_count,
    level_numeric, has_exception, has_timeout, has_failed,
    CAST(minute("timestamp") AS INT) AS minute,
    CASE WHEN day_of_week IN (1, 7) THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN hour >= 9 AND hour <= 17 THEN 1 ELSE 0 END AS is_business_hours,
    CASE WHEN hour >= 22 OR hour <= 6 THEN 1 ELSE 0 END AS is_night_time,
    CAST(regexp_matches(message, '(?i)(error|failure|critical|fatal)') AS INT)
        AS has_error_keywords,
    CAST(regexp_matches(message, '(?i)(slow|high|exceed)') AS INT) AS has_performance_keywords,
    CASE WHEN word_count > 0 THEN round(log2(word_count) * message_length / 1000, 9)
         ELSE 0.0 END AS message_entropy,
    CASE service WHEN 'user-service' THEN 1 WHEN 'payment-service' THEN 2
        WHEN 'inventory-service' THEN 3 WHEN 'notification-service' THEN 4
        WHEN 'auth-service' THEN 5 ELSE 0 END AS service_encoded,
    CASE environment WHEN 'production' THEN 2 WHEN 'staging' THEN 1 ELSE 0 END
        AS environment_encoded
FROM features"""


@query(ALL_FEATURES_SQL)
def feature_engineering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.feature_engineering(fx.logs(spark, sf_dir))
    rows = rows.withColumn("message_entropy", F.round("message_entropy", 9))
    return rows.select("event_id", "minute", *model.ANOMALY_FEATURES)


@query("""SELECT doc_id, CAST(length(text) AS INT) AS message_length,
    CAST(len(string_split(text, ' ')) AS INT) AS word_count,
    regexp_matches(text, '(?i)(error|failure|critical|fatal)') AS error_words,
    regexp_matches(text, '(?i)(slow|high|exceed)') AS performance_words
FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message measures over long texts in several languages."""
    body = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.length(body).alias("message_length"),
        text.space_pieces(body).alias("word_count"),
        text.mentions(body, model.ERROR_WORDS).alias("error_words"),
        text.mentions(body, model.PERFORMANCE_WORDS).alias("performance_words"),
    )


@query("""SELECT event_id, CASE WHEN substr(md5(CASE WHEN event_id % 3 > 0 THEN trace_id
    ELSE '{"event_id":' || event_id || '}' END), 1, 2) < 'cd' THEN 'train' ELSE 'test' END AS part
FROM logs""")
def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the records have no trace id and are split by what they hold."""
    traced = F.expr("CASE WHEN event_id % 3 > 0 THEN trace_id END").alias("trace_id")
    train, test = hash_split(fx.logs(spark, sf_dir).select("event_id", traced))
    return train.select("event_id", F.lit("train").alias("part")).union(
        test.select("event_id", F.lit("test").alias("part"))
    )


# --- detectors ---------------------------------------------------------------


@query("""SELECT event_id, level FROM logs WHERE level = 'ERROR' OR length(message) > 1000""")
def detect_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.detect_v1(fx.logs(spark, sf_dir)).select("event_id", "level")


@query("""SELECT event_id, level, TIMESTAMP '2024-02-01 00:00:00' AS detection_timestamp,
    CAST(CASE level WHEN 'FATAL' THEN 1.0 WHEN 'ERROR' THEN 0.8 ELSE 0.6 END AS DOUBLE)
        AS anomaly_score
FROM logs WHERE level IN ('ERROR', 'FATAL') OR length(message) > 1000
    OR regexp_matches(message, '(?i)(exception|timeout|failed|critical)')""")
def detect_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.detect_v2(fx.logs(spark, sf_dir), as_of=fx.run_time())
    return found.select("event_id", "level", "detection_timestamp", "anomaly_score")


@query("""SELECT event_id, is_anomaly, rule AS matched_rule, anomaly_score, severity
FROM scored""")
def detect_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.detected(spark, sf_dir).select(
        "event_id", "is_anomaly", "matched_rule", "anomaly_score", "severity"
    )


@query("""SELECT event_id, CASE WHEN regexp_matches(message, '(?i)panic') THEN 'panic'
        WHEN environment = 'production' AND level = 'WARN' THEN 'live_warning' END AS matched_rule,
    CAST(CASE WHEN regexp_matches(message, '(?i)panic') THEN 0.92
        WHEN environment = 'production' AND level = 'WARN' THEN 0.55 ELSE 0.0 END AS DOUBLE)
        AS anomaly_score,
    CASE WHEN regexp_matches(message, '(?i)panic') THEN 'CRITICAL'
        WHEN environment = 'production' AND level = 'WARN' THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM logs""")
def detect_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table of the user's own."""
    own = (
        rules.Rule("panic", rules.has_word(["panic"]), 0.92),
        rules.Rule("live_warning", "environment = 'production' AND level = 'WARN'", 0.55),
    )
    found = rules.detect_v3(fx.logs(spark, sf_dir), rules=own, scores=own, default_score=0.0)
    return found.select("event_id", "matched_rule", "anomaly_score", "severity")


@query("""SELECT is_anomaly, severity, count(*) AS "rows" FROM scored GROUP BY 1, 2""")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = fx.detected(spark, sf_dir).groupBy("is_anomaly", "severity")
    return grouped.agg(F.count("*").alias("rows"))


# --- alerts and feeds --------------------------------------------------------


@query("SELECT * FROM alerts")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.route(fx.detected(spark, sf_dir), "anomalies", fx.run_time())


@query("SELECT * FROM alerts WHERE severity = 'CRITICAL'")
def alerts_high_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.route(fx.detected(spark, sf_dir), "high_priority", fx.run_time())


@query("""SELECT service, severity, count(*) AS alerts, max(log_timestamp) AS last_seen
FROM sent_alerts GROUP BY 1, 2""")
def alerts_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: raw topic values to alerts, by service and severity."""
    logs = parse.drop_incomplete(parse.parse_logs(fx.envelope(spark, sf_dir)))
    fired = al.to_alerts(rules.detect_v3(logs))
    return fired.groupBy("service", "severity").agg(
        F.count("*").alias("alerts"),
        F.max("log_timestamp").cast("timestamp_ntz").alias("last_seen"),
    )


@query("SELECT * FROM sent_alerts")
def alerts_from_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert ids include the broker position when the input has one."""
    logs = parse.drop_incomplete(parse.parse_logs(fx.envelope(spark, sf_dir)))
    fired = al.to_alerts(rules.detect_v3(logs), fx.run_time())
    return fired.withColumn("log_timestamp", F.col("log_timestamp").cast("timestamp_ntz"))


@query("""SELECT "timestamp", level, message, service, host, environment, metadata, trace_id,
    span_id, hour, day_of_week, message_length, word_count, level_numeric, has_exception,
    has_timeout, has_failed, is_anomaly, rule AS matched_rule, anomaly_score, severity
FROM scored""")
def processed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.route(fx.detected(spark, sf_dir).drop("event_id", "label"), "processed")


@query(f"""SELECT f.* EXCLUDE (event_id), s.trace_id, s.is_anomaly
FROM ({ALL_FEATURES_SQL}) f JOIN scored s USING (event_id)""")
def training_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = al.route(fx.detected(spark, sf_dir), "training")
    rows = rows.withColumn("message_entropy", F.round("message_entropy", 9))
    return rows.select("trace_id", "is_anomaly", "minute", *model.ANOMALY_FEATURES)


@query("""SELECT event_id, strftime("timestamp", '%Y%m%d%H%M%S') AS stamp FROM logs""")
def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logs(spark, sf_dir).select("event_id", clock.stamp(F.col("timestamp")).alias("stamp"))
