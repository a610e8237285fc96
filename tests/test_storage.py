"""The lake and the streams."""

import json
import time
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logstream import model, session
from logstream.operators.features import feature_engineering
from logstream.operators.parse import drop_incomplete, parse_logs
from logstream.operators.rules import detect_v3
from logstream.operators.stats import window_stats
from logstream.plans import fixture
from logstream.session import scratch
from logstream.sources import lake, rows, streams
from logstream.streaming import jobs, monitor, sinks

BASE = datetime(2024, 1, 3, 12, 0, tzinfo=timezone.utc)
ONCE = sinks.ONCE


# --- lake --------------------------------------------------------------------


def test_lake_round_trip(spark, log, tmp_path):
    root = str(tmp_path / "lake")
    df = log(*[{"timestamp": BASE + timedelta(days=d), "trace_id": f"d{d}"} for d in (0, 1, 3)])
    lake.write_lake(df, root)
    assert (tmp_path / "lake" / "year=2024" / "month=01" / "day=03").is_dir()
    found = lake.read_lake(spark, root, date(2024, 1, 3), date(2024, 1, 5))
    assert sorted(r.trace_id for r in found.collect()) == ["d0", "d1"]
    last = lake.read_last_days(spark, root, days_back=2, today=date(2024, 1, 6))
    assert sorted(r.trace_id for r in last.collect()) == ["d1", "d3"]
    typed = lake.read_lake(spark, root, date(2024, 1, 6), date(2024, 1, 6), df.schema)
    assert [r.trace_id for r in typed.collect()] == ["d3"]
    assert lake.read_lake(spark, root, date(2030, 1, 1), date(2030, 1, 2)).count() == 0


def test_lake_reads_only_the_days_asked_for(spark, log, tmp_path):
    root = str(tmp_path / "lake")
    lake.write_lake(log(*[{"timestamp": BASE + timedelta(days=d)} for d in range(5)]), root)
    days = lake.read_lake(spark, root, date(2024, 1, 4), date(2024, 1, 5))
    plan = days._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "make_date(year" in filters
    assert days.select(F.input_file_name()).distinct().count() == 2


def test_a_day_becomes_few_files(spark, tmp_path):
    day = spark.range(20_000).repartition(16).select(
        F.lit(BASE).alias("timestamp"), F.col("id").cast("string").alias("trace_id")
    )
    lake.write_lake(day, str(tmp_path / "lake"))
    assert len(list((tmp_path / "lake").rglob("*.parquet"))) == 1


def test_rows_source(spark):
    row = (BASE, "INFO", "m", "s", "h", "e", 1, 1, None, "t", "p")
    df = rows.from_rows(spark, [row])
    assert df.schema == model.TRAINING and df.first().is_anomaly is None


# --- sources and sinks -------------------------------------------------------


def test_kafka_settings():
    options = streams.kafka_options("a:1,b:2", ["x", "y"], max_per_trigger=500)
    assert options["subscribe"] == "x,y" and options["startingOffsets"] == "latest"
    assert options["failOnDataLoss"] == "false" and options["maxOffsetsPerTrigger"] == "500"
    assert options["kafka.session.timeout.ms"] == "10000"
    sink = sinks.Sink("kafka", "a:1", "out", {"kafka.linger.ms": "10"})
    assert sink.write_options() == {
        "kafka.bootstrap.servers": "a:1", "topic": "out", "kafka.acks": "all",
        "kafka.retries": "3", "kafka.linger.ms": "10",
    }
    assert jobs.StreamConfig("kafka", "a:1", "a:1", "/c", sink="kafka").feed("high_priority").topic == "alerts-high-priority"


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        streams.read_log_stream(spark, "pigeon", "x")


def test_a_checkpoint_is_required(spark):
    with pytest.raises(ValueError):
        sinks.write_stream(spark.readStream.format("rate").load(), sinks.Sink("parquet", "x"), None)


def test_text_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"message": "it failed", "level": "ERROR", "service": "s"}\nnot json\n')
    config = jobs.StreamConfig("text", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), trigger=ONCE)
    sink = sinks.Sink("parquet", str(tmp_path / "found"))
    jobs.start_simple(spark, config, 1, sink).awaitTermination()
    (row,) = spark.read.parquet(sink.location).collect()
    assert row.message == "it failed" and row.timestamp is not None
    with pytest.raises(ValueError):
        jobs.start_simple(spark, config, 7)


def wait_until(done):
    for _ in range(50):
        if done():
            return
        time.sleep(0.2)


def values_file(folder, name, records):
    folder.mkdir(exist_ok=True)
    text = "".join(json.dumps({"level": "INFO", "service": "s", "message": "m", **r}) + "\n" for r in records)
    (folder / name).write_text(text)


def at(**parts):
    return (BASE + timedelta(**parts)).isoformat(sep=" ")


def stats_config(tmp_path, **more):
    return jobs.StreamConfig(
        "text", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), trigger=ONCE, **more
    )


def test_one_file_per_trigger(spark, tmp_path):
    for i in range(3):
        values_file(tmp_path / "in", f"{i}.json", [{"timestamp": at(minutes=i)}])
    query = jobs.start_processed(spark, stats_config(tmp_path, max_per_trigger=1))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3


# --- streams -----------------------------------------------------------------


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    topic = str(tmp_path / "topic")
    fixture.envelope(spark, sf_dir).repartition(4).write.parquet(topic)
    config = jobs.StreamConfig("parquet", topic, str(tmp_path / "out"), str(tmp_path / "c"), trigger=ONCE)
    query = jobs.start_stats(spark, config, str(tmp_path / "stats"))
    query.awaitTermination()
    streamed = sinks.read_latest(spark, str(tmp_path / "stats"))
    logs = drop_incomplete(parse_logs(spark.read.parquet(topic)))
    batch = window_stats(detect_v3(logs))
    places = [F.round(c, 9).alias(c) if c.startswith("a") and c.endswith(("score", "rate")) else F.col(c) for c in batch.columns]
    assert streamed.count() == batch.count() > 0
    assert streamed.select(places).exceptAll(batch.select(places)).count() == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    records = [
        [{"timestamp": at(), "service": "base"}],
        [{"timestamp": at(minutes=20), "service": "ahead"}],
        [{"timestamp": at(seconds=1), "service": "late"}],
    ]
    config = stats_config(tmp_path)
    log = monitor.ProgressLog()
    spark.streams.addListener(log)
    try:
        for i, batch in enumerate(records):
            values_file(tmp_path / "in", f"{i}.json", batch)
            jobs.start_stats(spark, config, str(tmp_path / "stats")).awaitTermination()
        wait_until(lambda: sum(r[2] == "stopped" for r in log.rows()) == 3)
    finally:
        spark.streams.removeListener(log)
    late = log.late_rows("stats")
    found = sinks.read_latest(spark, str(tmp_path / "stats"))
    assert {r.service for r in found.collect()} == {"base", "ahead"}
    assert late == 2


def test_every_event_is_kept(spark, tmp_path):
    """Far more triggers than a query remembers itself."""
    path = str(tmp_path / "events")
    log = monitor.ProgressLog(spark, path, chunk=100)

    class State:
        numRowsDroppedByWatermark = 1

    class Progress:
        name, runId, batchId, numInputRows, stateOperators = "q", "r", 0, 1, [State]
        processedRowsPerSecond, eventTime = 1.0, {}

    class Event:
        progress, runId, exception = Progress, "r", None

    for _ in range(250):
        log.onQueryProgress(Event)
    assert log.late_rows("q") == 250 and len(log.rows()) == 50
    log.onQueryTerminated(Event)
    stored = spark.read.parquet(path)
    assert stored.count() == 251 and stored.agg(F.sum("late_rows_dropped")).first()[0] == 250


def test_events_are_written_by_time(spark, tmp_path):
    path = str(tmp_path / "events")
    log = monitor.ProgressLog(spark, path, chunk=100, seconds=0.2)
    log._add("q", "r", "started", None, None, None, None, None, None)
    assert len(log.rows()) == 1
    time.sleep(0.3)
    log.onQueryIdle(None)
    assert not log.rows() and spark.read.parquet(path).count() == 1


def test_compaction_keeps_the_result(spark, tmp_path):
    path, config = str(tmp_path / "stats"), stats_config(tmp_path)
    for i in range(4):
        records = [{"timestamp": at(days=2) if i == 3 else at(seconds=i)}]
        values_file(tmp_path / "in", f"{i}.json", records)
        jobs.start_stats(spark, config, path).awaitTermination()
    before = sorted(sinks.read_latest(spark, path).collect())
    folders = len(list((tmp_path / "stats").rglob("batch_id=*")))
    for _ in range(2):
        sinks.compact_latest(spark, path, "2024-01-04")
        assert sorted(sinks.read_latest(spark, path).collect()) == before
    closed = list((tmp_path / "stats" / "window_day=2024-01-03").glob("batch_id=*"))
    assert [f.name for f in closed] == ["batch_id=-1"]
    assert len(list((tmp_path / "stats").rglob("batch_id=*"))) < folders


def test_counters_keep_few_folders(spark, tmp_path):
    path, config = str(tmp_path / "counters"), stats_config(tmp_path)
    for i in range(4):
        values_file(tmp_path / "in", f"{i}.json", [{"timestamp": at(seconds=i)}, {"level": "FATAL", "timestamp": at()}])
        jobs.start_counters(spark, config, path).awaitTermination()
    row = jobs.read_counters(spark, path).first()
    assert (row.total, row.anomalies) == (8, 4)
    assert len(list((tmp_path / "counters").glob("batch_id=*"))) == 2


def test_ingest_keeps_what_it_refuses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"level": "INFO", "service": "s", "message": "m", "environment": null}', "not json"]
    lines += ['{"level": "INFO", "service": "s", "message": "m", "timestamp": "garbage"}']
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    quarantine, dead = (sinks.Sink("parquet", str(tmp_path / n)) for n in ("q", "d"))
    config = stats_config(tmp_path)
    jobs.start_ingest(spark, config, quarantine, dead).awaitTermination()
    (refused,) = spark.read.parquet(quarantine.location).collect()
    assert refused.raw == lines[2] and refused.reasons == ["timestamp"]
    assert [r.raw for r in spark.read.parquet(dead.location).collect()] == ["not json"]
    (taken,) = [json.loads(r.value) for r in spark.read.text(config.feed("raw").location).collect()]
    assert "environment" not in taken and taken["timestamp"]


def test_dead_letters_of_the_feeds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("not json\n")
    dead = sinks.Sink("parquet", str(tmp_path / "d"))
    config = stats_config(tmp_path, dead_letters=dead)
    jobs.start_feeds(spark, config, ("processed", "anomalies")).awaitTermination()
    assert spark.read.parquet(dead.location).first().raw == "not json"
    assert spark.read.text(config.feed("processed").location).count() == 0


def test_batches_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"level": "INFO", "service": "s", "message": "m"}
    lines = [{"batch_id": "a", "logs": [good, good]}, {"batch_id": "b", "logs": [good, {}]}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    quarantine, outcomes = (sinks.Sink("parquet", str(tmp_path / n)) for n in ("q", "o"))
    config = stats_config(tmp_path)
    jobs.start_batch_ingest(spark, config, quarantine, outcomes).awaitTermination()
    assert spark.read.text(config.feed("raw").location).count() == 2
    assert json.loads(spark.read.parquet(quarantine.location).first().raw) == lines[1]
    found = {r.batch: (r.processed, r.failed, r.status) for r in spark.read.parquet(outcomes.location).collect()}
    assert found == {"a": (2, 0, "success"), "b": (0, 2, "refused")}


def test_restart_goes_on_without_loss_or_repeats(spark, tmp_path):
    config = stats_config(tmp_path)
    for i in range(3):
        values_file(tmp_path / "in", f"{i}.json", [{"timestamp": at(seconds=i), "level": "FATAL", "trace_id": f"t{i}"}])
        jobs.start_alerts(spark, config).awaitTermination()
        jobs.start_stats(spark, config, str(tmp_path / "stats")).awaitTermination()
        jobs.start_counters(spark, config, str(tmp_path / "counters")).awaitTermination()
    sent = spark.read.text(config.feed("anomalies").location).collect()
    assert sorted(json.loads(r.value)["trace_id"] for r in sent) == ["t0", "t1", "t2"]
    assert spark.read.text(config.feed("high_priority").location).count() == 3
    latest = sinks.read_latest(spark, str(tmp_path / "stats"), since="2024-01-03")
    assert [r.total_logs for r in latest.collect()] == [3, 3]
    assert sinks.read_latest(spark, str(tmp_path / "stats"), since="2024-01-04").count() == 0
    assert jobs.read_counters(spark, str(tmp_path / "counters")).first().total == 3


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    sink = sinks.Sink("parquet", str(tmp_path / "t"), files=1)
    for _ in range(2):
        sinks.write_batch(spark.range(5), sink, 0)
    sinks.write_batch(spark.range(5), sink, 1)
    assert spark.read.parquet(sink.location).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 5), (1, 5)]
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 2


def test_features_on_a_stream(spark, tmp_path):
    values_file(tmp_path / "in", "a.json", [{"timestamp": at(), "message": "slow"}])
    logs = parse_logs(streams.read_log_stream(spark, "text", str(tmp_path / "in")))
    sink = sinks.Sink("parquet", str(tmp_path / "f"))
    sinks.write_stream(feature_engineering(logs), sink, str(tmp_path / "c"), trigger=ONCE).awaitTermination()
    assert spark.read.parquet(sink.location).first().has_performance_keywords == 1


def test_lake_from_a_stream(spark, tmp_path):
    values_file(tmp_path / "in", "a.json", [{"timestamp": at(days=d)} for d in range(2)])
    logs = drop_incomplete(parse_logs(streams.read_log_stream(spark, "text", str(tmp_path / "in"))))
    lake.write_lake_stream(logs, str(tmp_path / "lake"), str(tmp_path / "c"), ONCE, "lake", files=1).awaitTermination()
    assert lake.read_lake(spark, str(tmp_path / "lake"), date(2024, 1, 4), date(2024, 1, 4)).count() == 1


# --- lifecycle ---------------------------------------------------------------


def test_start_all_and_stop_all(spark, tmp_path, capfd):
    values_file(tmp_path / "in", "a.json", [{"timestamp": at(), "level": "FATAL"}])
    log = monitor.ProgressLog()
    try:
        config = stats_config(tmp_path, console=True)
        queries = jobs.start_all(spark, config, str(tmp_path / "stats"), log)
        assert sorted(queries) == ["console", "feeds", "windows"]
        jobs.run_until_stopped(spark, queries)
        for query in queries.values():
            assert not query.isActive
        wait_until(lambda: sum(r[2] == "stopped" for r in log.rows()) == 3)
        wait_until(lambda: {r[0] for r in log.rows() if r[2] == "progress"} == set(queries))
        for feed in ("processed", "anomalies", "high_priority", "training", "service_metrics"):
            assert spark.read.text(config.feed(feed).location).count() > 0
    finally:
        spark.streams.removeListener(log)
        spark.streams.resetTerminated()
    events = {r[2] for r in log.rows()}
    assert {"started", "progress", "stopped"} <= events
    log.flush(spark, str(tmp_path / "progress"))
    assert not log.rows() and spark.read.parquet(str(tmp_path / "progress")).count() >= 3


def test_a_failing_query_is_reported_and_the_others_stop(spark, tmp_path):
    values_file(tmp_path / "in", "a.json", [{"timestamp": at()}])
    waiting = jobs.StreamConfig("text", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"))

    def fail(batch, batch_id):
        raise RuntimeError("sink is gone")

    source = streams.read_log_stream(spark, "text", str(tmp_path / "in"))
    queries = {
        "processed": jobs.start_processed(spark, waiting),
        "broken": source.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "b")).start(),
    }
    with pytest.raises(Exception, match="sink is gone"):
        jobs.run_until_stopped(spark, queries)
    assert not any(query.isActive for query in queries.values())
    spark.streams.resetTerminated()


def test_a_failed_start_stops_the_others(spark, tmp_path, monkeypatch):
    values_file(tmp_path / "in", "a.json", [{"timestamp": at()}])

    def fail(*_):
        raise RuntimeError("no stats")

    monkeypatch.setattr(jobs, "start_windows", fail)
    config = jobs.StreamConfig("text", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"))
    with pytest.raises(RuntimeError):
        jobs.start_all(spark, config, str(tmp_path / "stats"))
    assert not spark.streams.active
    spark.streams.resetTerminated()


def test_scratch_is_the_shared_folder(spark):
    class Session:
        def __init__(self, **settings):
            self.conf = settings

    named = Session(**{"spark.checkpoint.dir": "hdfs://x/ck/", "spark.master": "yarn"})
    path = scratch(named, "lake")
    assert path.startswith("hdfs://x/ck/logstream/lake-")
    # There is no such cluster to clear it from.
    session._made.remove(path)
    with pytest.raises(ValueError):
        scratch(Session(**{"spark.master": "yarn"}), "lake")
    assert scratch(spark, "a") != scratch(spark, "a")
