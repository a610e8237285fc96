"""JSON values to typed rows and back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstream import model
from logstream.functions.rows import computed_once


def parse_logs(
    df: DataFrame, schema: T.StructType = model.FULL, keep_envelope: bool = True
) -> DataFrame:
    """One column per field of ``schema``; malformed JSON gives NULL fields.

    With ``keep_envelope`` the broker time, topic, partition and offset stay. A schema
    without an event time takes the broker time for it.
    """
    log = computed_once(F.from_json(F.col("value").cast("string"), schema))
    if "timestamp" not in schema.names:
        return df.select("timestamp", log)
    if not keep_envelope:
        return df.select(log)
    kept = [c for c in ("topic", "partition", "offset") if c in df.columns]
    return df.select(log, F.col("timestamp").alias("kafka_timestamp"), *kept)


def submitted(value: Column) -> Column:
    """A submitted record as a struct, with what the checks and defaults look at.

    ``timestamp_text`` is the time as it was sent, ``timestamp`` its value or NULL, and
    ``environment_sent`` whether the record names an environment, be it null.
    """
    log = F.from_json(value, model.SUBMITTED)
    return F.struct(
        F.try_to_timestamp(log["timestamp"]).alias("timestamp"),
        *[log[name].alias(name) for name in model.LOG_FIELDS if name != "timestamp"],
        log["timestamp"].alias("timestamp_text"),
        F.array_contains(F.json_object_keys(value), "environment").alias("environment_sent"),
    )


def parse_submitted(df: DataFrame) -> DataFrame:
    """Submitted records of an envelope, with ``raw``, the value as it was sent.

    What is no JSON object is ``malformed`` and has NULL fields.
    """
    raw = F.col("value").cast("string")
    kept = [c for c in ("topic", "partition", "offset") if c in df.columns]
    read = df.select(
        computed_once(submitted(raw)), raw.alias("raw"), F.col("timestamp").alias("arrived"), *kept
    )
    # Only a value that has no keys at all does not say whether it names an environment.
    malformed = F.col("environment_sent").isNull().alias("malformed")
    fields = [c for c in read.columns if c not in ("raw", "arrived", *kept)]
    return read.select(*fields, "raw", malformed, "arrived", *kept)


def parse_batches(df: DataFrame) -> DataFrame:
    """JSON values that hold a whole batch each, as ``batch_id``, ``logs`` and ``raw``.

    The entries stay JSON. A batch without an id is named by its place in the topic, or
    where there is none by its text.
    """
    raw = F.col("value").cast("string")
    place = [c for c in ("topic", "partition", "offset") if c in df.columns]
    own = F.concat_ws("-", F.lit("batch"), *place) if place else F.concat(F.lit("batch-"), F.md5(raw))
    read = df.select(
        computed_once(F.from_json(raw, model.BATCH)),
        own.alias("own_id"),
        raw.alias("raw"),
        *[F.col(c).alias("arrived") for c in ("timestamp",) if c in df.columns],
    )
    named = F.coalesce(F.nullif("batch_id", F.lit("")), "own_id")
    return read.withColumn("batch_id", named).drop("own_id")


def drop_incomplete(df: DataFrame, required: Iterable[str] = ("timestamp",)) -> DataFrame:
    """Rows with a value in each required column; drops malformed records too."""
    return df.dropna(subset=list(required))


def parse_marked(df: DataFrame, schema: T.StructType = model.FULL) -> DataFrame:
    """One column per field, the envelope, whether the value is ``malformed``, and its ``raw``
    text if it is. A missing value is malformed too."""
    lenient = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    text = F.col("value").cast("string")
    envelope = [c for c in ("topic", "partition", "offset") if c in df.columns]
    parsed = df.select(
        F.col("timestamp").alias("kafka_timestamp"),
        *envelope,
        text.alias("raw"),
        computed_once(F.struct(F.from_json(text, lenient, options).alias("log"))),
    )
    bad = F.col("raw").isNull() | F.col("log._corrupt_record").isNotNull()
    raw = F.when(bad, F.col("raw")).alias("raw")
    marked = parsed.select("log.*", "kafka_timestamp", *envelope, bad.alias("malformed"), raw)
    return marked.drop("_corrupt_record")


def dead_letters(marked: DataFrame) -> DataFrame:
    """What was no JSON, with its place in the topic and its ``raw`` text."""
    kept = [c for c in ("kafka_timestamp", "arrived", "topic", "partition", "offset") if c in marked.columns]
    return marked.where("malformed").select(*kept, "raw")


def split_malformed(
    df: DataFrame, schema: T.StructType = model.FULL
) -> tuple[DataFrame, DataFrame]:
    """(rows that are JSON, dead letters with their raw text).

    A missing value is a dead letter too.
    """
    marked = parse_marked(df, schema)
    return marked.where(~F.col("malformed")).drop("malformed", "raw"), dead_letters(marked)


def metadata_field(df: DataFrame, key: str, alias: str | None = None) -> DataFrame:
    """Adds the text of one key of the ``metadata`` JSON."""
    return df.withColumn(alias or key, F.get_json_object("metadata", f"$.{key}"))


def json_value(*columns: str | Column) -> Column:
    """The columns as one JSON text, with times in full precision."""
    return F.to_json(F.struct(*columns), {"timestampFormat": model.JSON_TIME})


def as_values(df: DataFrame) -> DataFrame:
    """Each row as a JSON ``value``, as topics hold it."""
    return df.select(json_value(*[F.col(c) for c in df.columns]).alias("value"))
