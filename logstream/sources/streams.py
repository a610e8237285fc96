"""Stream sources. Each gives the broker envelope, whatever it reads from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream import model

# Broker client settings, in milliseconds.
SESSION_TIMEOUT_MS = "10000"
REQUEST_TIMEOUT_MS = "20000"


def kafka_options(
    servers: str,
    topics: Iterable[str],
    starting: str = "latest",
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of the Kafka source.

    ``starting`` only counts for a query without a checkpoint. The rate limit is
    for the whole query, not per partition.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": "false",
        "kafka.session.timeout.ms": SESSION_TIMEOUT_MS,
        "kafka.request.timeout.ms": REQUEST_TIMEOUT_MS,
    }
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def file_options(max_per_trigger: int | None = None) -> dict[str, str]:
    return {} if max_per_trigger is None else {"maxFilesPerTrigger": str(max_per_trigger)}


def read_log_stream(
    spark: SparkSession,
    kind: str,
    location: str,
    topics: Iterable[str] = (model.TOPICS["raw"],),
    starting: str = "latest",
    max_per_trigger: int | None = None,
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """An unbounded envelope frame.

    ``kind`` is one of

    * ``kafka``: ``location`` is the server list;
    * ``parquet``: a folder of envelope rows; only the given topics are kept;
    * ``text``: a folder of files with one JSON value per line, whose broker
      time is the file's modification time.

    File sources start with the files present, and have no ``starting``.
    """
    topics = tuple(topics)
    extra = dict(extra or {})
    if kind == "kafka":
        options = kafka_options(location, topics, starting, max_per_trigger)
        return spark.readStream.format("kafka").options(**{**options, **extra}).load()
    reader = spark.readStream.options(**{**file_options(max_per_trigger), **extra})
    if kind == "parquet":
        return reader.schema(model.ENVELOPE).parquet(location).where(F.col("topic").isin(*topics))
    if kind == "text":
        return reader.text(location).select(
            F.lit(None).cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.lit(topics[0]).alias("topic"),
            F.col("_metadata.file_modification_time").alias("timestamp"),
        )
    raise ValueError(f"unknown source kind {kind!r}: kafka, parquet or text")


def read_topics(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Several feeds as one frame; ``topic`` tells them apart, absent columns are NULL."""
    tagged = [df.withColumn("topic", F.lit(topic)) for topic, df in feeds.items()]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged
