"""Record shapes and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- record shapes -----------------------------------------------------------

TEXT, TIME, BYTES = T.StringType(), T.TimestampType(), T.BinaryType()
INT, LONG, FLAG = T.IntegerType(), T.LongType(), T.BooleanType()


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FULL = _record(
    timestamp=TIME,
    level=TEXT,
    message=TEXT,
    service=TEXT,
    host=TEXT,
    environment=TEXT,
    metadata=TEXT,
    trace_id=TEXT,
    span_id=TEXT,
)
MID = _record(message=TEXT, level=TEXT, service=TEXT, timestamp=TIME)
MINIMAL = _record(message=TEXT, level=TEXT, service=TEXT)
ENVELOPE = _record(
    key=BYTES, value=BYTES, topic=TEXT, partition=INT, offset=LONG, timestamp=TIME
)
# Submitted records, whose times are read only after they were looked at.
SUBMITTED = T.StructType([T.StructField("timestamp", TEXT), *FULL.fields[1:]])
# The entries of a batch stay JSON until each is read by itself.
BATCH = _record(batch_id=TEXT, logs=T.ArrayType(TEXT))
TRAINING = _record(
    timestamp=TIME,
    level=TEXT,
    message=TEXT,
    service=TEXT,
    host=TEXT,
    environment=TEXT,
    message_length=INT,
    word_count=INT,
    is_anomaly=FLAG,
    trace_id=TEXT,
    span_id=TEXT,
)
LOG_FIELDS = FULL.fieldNames()

# --- fixed values: enumerations and codes ------------------------------------

LEVEL_CODES = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "FATAL": 4}
UNKNOWN_LEVEL_CODE = 1
ERROR_LEVELS = ("ERROR", "FATAL")

SEVERITY_BANDS = (("CRITICAL", 0.9), ("HIGH", 0.7), ("MEDIUM", 0.5))
LOWEST_SEVERITY = "LOW"
SEVERITY_RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

SERVICE_CODES = {
    "user-service": 1,
    "payment-service": 2,
    "inventory-service": 3,
    "notification-service": 4,
    "auth-service": 5,
}
ENVIRONMENT_CODES = {"production": 2, "staging": 1}
DEFAULT_ENVIRONMENT = "production"

# --- fixed values: words looked for in messages, all lower case --------------

MEMORY_WORDS = ("out of memory", "heap space")
CRASH_WORDS = ("segmentation fault",)
FAILURE_WORDS = ("exception", "error", "failed", "timeout", "refused", "panic", "critical")
SHORT_FAILURE_WORDS = ("exception", "timeout", "failed", "critical")
ERROR_WORDS = ("error", "failure", "critical", "fatal")
PERFORMANCE_WORDS = ("slow", "high", "exceed")

# --- fixed values: limits of an accepted record ------------------------------

MAX_MESSAGE = 10_000
MAX_NAME = 100
MAX_ENVIRONMENT = 50
MAX_BATCH = 10_000
MAX_SEARCH = 10_000

# --- fixed values: detector limits -------------------------------------------

LONG_MESSAGE = 1000
VERY_LONG_MESSAGE = 2000
MANY_WORDS = 150
EARLY_HOUR = 6

# --- fixed values: topics ----------------------------------------------------

TOPICS = {
    "raw": "logs-raw",
    "processed": "logs-processed",
    "anomalies": "anomalies-detected",
    "high_priority": "alerts-high-priority",
    "training": "ml-training-data",
    "service_metrics": "service-metrics",
}

# The model input, in vector order.
ANOMALY_FEATURES = (
    "hour",
    "day_of_week",
    "is_weekend",
    "is_business_hours",
    "is_night_time",
    "level_numeric",
    "message_length",
    "word_count",
    "message_entropy",
    "has_exception",
    "has_timeout",
    "has_failed",
    "has_error_keywords",
    "has_performance_keywords",
    "service_encoded",
    "environment_encoded",
)
CLASSIFIER_FEATURES = (
    "message_length",
    "word_count",
    "hour",
    "day_of_week",
    "is_weekend",
    "is_business_hours",
    "has_exception",
    "has_timeout",
    "has_failed",
    "has_error_keywords",
    "has_performance_keywords",
    "message_entropy",
    "service_encoded",
    "environment_encoded",
)

# Micro-second ISO text; the default of to_json cuts to milliseconds.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
