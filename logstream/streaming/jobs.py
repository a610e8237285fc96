"""The running detectors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logstream import model
from logstream.functions.ids import digest
from logstream.operators import parse
from logstream.operators.alerts import route, to_alerts
from logstream.operators.batches import (
    explode_batches,
    ingest,
    judge_batches,
    nested_outcome,
    refused_batches,
)
from logstream.operators.parse import (
    drop_incomplete,
    parse_batches,
    parse_logs,
    parse_marked,
    parse_submitted,
)
from logstream.operators.repeats import without_repeats
from logstream.operators.rules import detect_v1, detect_v2, detect_v3
from logstream.operators.sketches import distinct_minutes
from logstream.operators.stats import live_counters, window_stats
from logstream.operators.validate import validate
from logstream.sources.streams import read_log_stream
from logstream.streaming.late import LATE_COLUMNS, before_bound, late_bound, late_entries
from logstream.streaming.monitor import ProgressLog
from logstream.streaming.offsets import commit
from logstream.streaming.sinks import (
    Sink,
    every,
    fan_out,
    prune_batches,
    upsert_latest,
    write_batch,
    write_latest,
    write_stream,
)

# Seconds between triggers.
ALERT_SECONDS = 10
SIMPLE_SECONDS = 15
CONSOLE_SECONDS = 30
STATS_SECONDS = 60
STATS_WIDTH, STATS_SLIDE = "1 minute", "30 seconds"


@dataclass(frozen=True)
class StreamConfig:
    """What to read, where results and checkpoints go.

    ``feeds`` is a server list for Kafka sinks, or a folder. ``trigger``
    replaces the trigger of every query, as a test or a catch-up run needs.
    ``prefix`` sets the query names of one configuration apart from another's.
    ``repeats`` is how long after its arrival a message may come again and is then
    left out; without it nothing is. ``late`` takes the rows that windows are closed to.
    ``commits`` is a folder in which the feeds note how far they have come.
    """

    source: str
    location: str
    feeds: str
    checkpoints: str
    sink: str = "values"
    topic: str = model.TOPICS["raw"]
    starting: str = "latest"
    max_per_trigger: int | None = None
    console: bool = False
    trigger: Mapping | None = None
    watermark: str = "5 minutes"
    prefix: str = ""
    dead_letters: Sink | None = None
    late: Sink | None = None
    repeats: str | None = None
    commits: str | None = None

    def feed(self, name: str) -> Sink:
        topic = model.TOPICS[name]
        if self.sink == "kafka":
            return Sink("kafka", self.feeds, topic)
        return Sink(self.sink, f"{self.feeds.rstrip('/')}/{topic}", topic)

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoints.rstrip('/')}/{name}"

    def name(self, query: str) -> str:
        return f"{self.prefix}{query}"

    def paced(self, seconds: int) -> Mapping:
        return self.trigger or every(seconds)


def detected_logs(envelope: DataFrame) -> DataFrame:
    """Envelope to scored records: parse, drop what has no time, features, rules."""
    return detect_v3(drop_incomplete(parse_logs(envelope)))


def open_source(spark: SparkSession, config: StreamConfig) -> DataFrame:
    sent = read_log_stream(
        spark,
        config.source,
        config.location,
        topics=(config.topic,),
        starting=config.starting,
        max_per_trigger=config.max_per_trigger,
    )
    return sent if config.repeats is None else without_repeats(sent, within=config.repeats)


def start_ingest(
    spark: SparkSession, config: StreamConfig, quarantine: Sink, dead_letters: Sink
) -> StreamingQuery:
    """Submitted records to the raw feed; what cannot be taken, as it was sent, elsewhere.

    Records that break a rule go to quarantine with their reasons, values that are no JSON to
    the dead letters. The time of arrival stands in for a missing event time; one that was
    sent but cannot be read breaks a rule.
    """
    records = parse_submitted(open_source(spark, config))

    def accepted(batch: DataFrame) -> DataFrame:
        taken = ingest(batch.where(~F.col("malformed")), F.col("arrived"))
        return taken.select(*model.LOG_FIELDS, "log_id")

    def refused(batch: DataFrame) -> DataFrame:
        _, bad = validate(batch.where(~F.col("malformed")))
        return bad.drop("malformed", "environment_sent")

    routes = {
        "raw": (accepted, config.feed("raw")),
        "quarantine": (refused, quarantine),
        "dead_letters": (parse.dead_letters, dead_letters),
    }
    checkpoint, trigger = config.checkpoint("ingest"), config.paced(ALERT_SECONDS)
    return fan_out(records, routes, checkpoint, trigger, config.name("ingest"))


def start_batch_ingest(
    spark: SparkSession, config: StreamConfig, quarantine: Sink, outcomes: Sink
) -> StreamingQuery:
    """Nested batches: the entries of accepted ones to the raw feed, refused ones as they were
    sent to quarantine, and an outcome row for each. ``batch`` is the id: a table of micro-batches
    has a ``batch_id`` of its own."""
    judged = judge_batches(parse_batches(open_source(spark, config)))
    routes = {
        "raw": (lambda batch: explode_batches(batch, F.col("arrived")), config.feed("raw")),
        "quarantine": (
            lambda batch: refused_batches(batch).withColumnRenamed("batch_id", "batch"),
            quarantine,
        ),
        "outcomes": (
            lambda batch: nested_outcome(batch).withColumnRenamed("batch_id", "batch"),
            outcomes,
        ),
    }
    checkpoint, trigger = config.checkpoint("batches"), config.paced(ALERT_SECONDS)
    return fan_out(judged, routes, checkpoint, trigger, config.name("batches"))


def start_feeds(
    spark: SparkSession, config: StreamConfig, feeds: Iterable[str], name: str = "feeds"
) -> StreamingQuery:
    """Any of the feeds processed, anomalies, high_priority and training, from one read.

    Records are parsed and scored once for all of them. With ``config.dead_letters`` values
    that are no JSON go there.
    """
    marked = detect_v3(parse_marked(open_source(spark, config)))

    def rows_of(feed: str):
        def rows(batch: DataFrame) -> DataFrame:
            logs = batch.where(~F.col("malformed")).drop("malformed", "raw")
            return route(drop_incomplete(logs), feed)

        return rows

    routes = {feed: (rows_of(feed), config.feed(feed)) for feed in feeds}
    if config.dead_letters is not None:
        routes["dead_letters"] = (parse.dead_letters, config.dead_letters)
    checkpoint, trigger = config.checkpoint(name), config.paced(ALERT_SECONDS)

    def note(batch: DataFrame, batch_id: int) -> None:
        commit(spark, f"{config.commits.rstrip('/')}/{name}", batch, batch_id)

    done = None if config.commits is None else note
    return fan_out(marked, routes, checkpoint, trigger, config.name(name), done)


def start_alerts(spark: SparkSession, config: StreamConfig) -> StreamingQuery:
    """Alerts and critical alerts."""
    return start_feeds(spark, config, ("anomalies", "high_priority"), "alerts")


def start_processed(spark: SparkSession, config: StreamConfig) -> StreamingQuery:
    """Every record with its flag, score and severity."""
    return start_feeds(spark, config, ("processed",), "processed")


def start_training(spark: SparkSession, config: StreamConfig) -> StreamingQuery:
    """Every record with its features, for training."""
    return start_feeds(spark, config, ("training",), "training")


def start_console(spark: SparkSession, config: StreamConfig) -> StreamingQuery:
    """Alerts as they come, on the console, at a pace of its own."""
    return write_stream(
        to_alerts(detected_logs(open_source(spark, config))),
        Sink("console"),
        config.checkpoint("console"),
        trigger=config.paced(CONSOLE_SECONDS),
        name=config.name("console"),
    )


def _timed_logs(spark: SparkSession, config: StreamConfig) -> DataFrame:
    """Scored records for windows. These have one watermark, on event time: repeats are looked for within it."""
    logs = detected_logs(open_source(spark, replace(config, repeats=None)))
    if config.repeats is None:
        return logs
    key = digest(*[F.col(c) for c in model.LOG_FIELDS])
    return without_repeats(logs, key, "timestamp", config.watermark)


def _statistics(config: StreamConfig, logs: DataFrame) -> DataFrame:
    watermark = None if config.repeats is not None else config.watermark
    return window_stats(logs, STATS_WIDTH, STATS_SLIDE, watermark)


def start_service_metrics(spark: SparkSession, config: StreamConfig) -> StreamingQuery:
    """Window statistics as messages: each time a window changes, its newest values.

    Readers keep the message of the greatest ``batch_id`` of a window.
    """
    stats = _statistics(config, _timed_logs(spark, config))
    feed = config.feed("service_metrics")

    def send(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.withColumn("sent_in", F.lit(batch_id)), feed, batch_id)

    return (
        stats.writeStream.outputMode("update")
        .foreachBatch(send)
        .option("checkpointLocation", config.checkpoint("service_metrics"))
        .trigger(**config.paced(STATS_SECONDS))
        .queryName(config.name("service_metrics"))
        .start()
    )


def start_stats(spark: SparkSession, config: StreamConfig, path: str) -> StreamingQuery:
    """Sliding window statistics, upserted to a table at ``path``."""
    stats = _statistics(config, _timed_logs(spark, config))
    return write_latest(
        stats, path, config.checkpoint("stats"), config.paced(STATS_SECONDS), config.name("stats")
    )


def start_windows(spark: SparkSession, config: StreamConfig, path: str) -> StreamingQuery:
    """Sliding window statistics from one state: a table at ``path`` and messages of the metrics topic.

    With ``config.late`` each row that came too late for a window goes there, with that window, so that
    nothing sent is lost: :func:`~logstream.streaming.late.merged_windows` brings both together.
    """
    checkpoint, feed = config.checkpoint("windows"), config.feed("service_metrics")
    if config.late is not None and config.repeats is not None:
        raise ValueError("late rows are not searched for repeats: give late or repeats")
    logs = _timed_logs(spark, config)
    stats = _statistics(config, logs)
    results = stats
    if config.late is not None:
        # The rows go the same way as the results, through the same micro-batches.
        kept = [c for c in LATE_COLUMNS if c not in ("window_start", "window_end")]
        results = stats.unionByName(logs.select(*kept), allowMissingColumns=True)

    def send(batch: DataFrame, batch_id: int) -> None:
        needed = is_stats = F.col("window_start").isNotNull()
        if config.late is not None:
            bound = late_bound(spark, checkpoint, batch_id)
            needed = is_stats | before_bound(bound)
        # The micro-batch runs once for all that is written; of its rows those that may be late stay.
        found = batch.where(needed).persist()
        try:
            if config.late is not None:
                late = late_entries(found.where(~is_stats).select(*kept), bound, STATS_WIDTH, STATS_SLIDE)
                write_batch(late, config.late, batch_id)
            changed = found.where(is_stats).select(*stats.columns)
            upsert_latest(changed, path, batch_id)
            write_batch(changed.withColumn("sent_in", F.lit(batch_id)), feed, batch_id)
        finally:
            found.unpersist()

    return (
        results.writeStream.outputMode("update")
        .foreachBatch(send)
        .option("checkpointLocation", checkpoint)
        .trigger(**config.paced(STATS_SECONDS))
        .queryName(config.name("windows"))
        .start()
    )


HOSTS_KEY = ("window_start", "window_end", "service")


def start_hosts(spark: SparkSession, config: StreamConfig, path: str) -> StreamingQuery:
    """Sketches of the hosts per minute and service, upserted to a table at ``path``.

    :func:`~logstream.operators.sketches.distinct_over` counts the hosts of any longer time from
    ``read_latest(spark, path, HOSTS_KEY)``.
    """
    logs = detected_logs(open_source(spark, replace(config, repeats=None)))
    minutes = distinct_minutes(logs, "host", ("service",), config.watermark)
    trigger, name = config.paced(STATS_SECONDS), config.name("hosts")
    return write_latest(minutes, path, config.checkpoint("hosts"), trigger, name, key=HOSTS_KEY)


def start_counters(spark: SparkSession, config: StreamConfig, path: str) -> StreamingQuery:
    """Running totals, one row per micro-batch; read with :func:`read_counters`.

    Only the newest folders are kept.
    """
    totals = live_counters(detected_logs(open_source(spark, config)))
    table = Sink("parquet", path)

    def send(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, table, batch_id)
        prune_batches(spark, path)

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(send)
        .option("checkpointLocation", config.checkpoint("counters"))
        .trigger(**config.paced(ALERT_SECONDS))
        .queryName(config.name("counters"))
        .start()
    )


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals; other folders are not opened."""
    history = spark.read.parquet(path)
    newest = history.select(F.max("batch_id")).scalar()
    return history.where(F.col("batch_id") == newest).drop("batch_id")


def start_all(
    spark: SparkSession,
    config: StreamConfig,
    stats_path: str,
    progress: ProgressLog | None = None,
) -> dict[str, StreamingQuery]:
    """The whole detector: all feeds from one read, window statistics and metrics from one state, and
    the console if asked for.

    With ``progress`` its events are recorded. If one query cannot start, those already
    running are stopped.
    """
    if progress is not None:
        spark.streams.addListener(progress)
    running: dict[str, StreamingQuery] = {}
    try:
        feeds = ("processed", "anomalies", "high_priority", "training")
        running["feeds"] = start_feeds(spark, config, feeds)
        running["windows"] = start_windows(spark, config, stats_path)
        if config.console:
            running["console"] = start_console(spark, config)
    except Exception:
        stop_all(running)
        raise
    return running


def stop_all(queries: Mapping[str, StreamingQuery]) -> None:
    for query in queries.values():
        query.stop()


def run_until_stopped(spark: SparkSession, queries: Mapping[str, StreamingQuery]) -> None:
    """Waits until all queries have ended, one fails or the user interrupts; stops the rest.

    The error of a failed query is raised here.
    """
    try:
        while any(query.isActive for query in queries.values()):
            spark.streams.awaitAnyTermination()
            spark.streams.resetTerminated()
        for query in queries.values():
            if query.exception():
                raise query.exception()
    except KeyboardInterrupt:
        pass
    finally:
        stop_all(queries)


def start_simple(
    spark: SparkSession,
    config: StreamConfig,
    version: int = 1,
    sink: Sink | None = None,
) -> StreamingQuery:
    """The detectors without features: version 1 on three fields, version 2 on four.

    They write to the console unless told otherwise.
    """
    envelope = open_source(spark, config)
    if version == 1:
        found = detect_v1(parse_logs(envelope, model.MINIMAL))
        trigger = config.trigger
    elif version == 2:
        logs = drop_incomplete(parse_logs(envelope, model.MID), ("message", "level"))
        found = detect_v2(logs)
        trigger = config.paced(SIMPLE_SECONDS)
    else:
        raise ValueError(f"no simple detector version {version}")
    name = f"detector_v{version}"
    return write_stream(
        found,
        sink or Sink("console"),
        config.checkpoint(name),
        trigger=trigger,
        name=config.name(name),
    )
