"""Repeats, batches over several triggers and late rows, trigger by trigger."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logstream import model
from logstream.operators.repeats import without_repeats
from logstream.sources import streams
from logstream.streaming import jobs, late, sinks
from logstream.streaming.batches import accept_streamed_batches

BASE = datetime(2024, 1, 3, 12, 0, tzinfo=timezone.utc)
ONCE = sinks.ONCE


def at(**parts):
    return BASE + timedelta(**parts)


@pytest.fixture
def topic(spark, tmp_path):
    """Appends messages to a topic: value, arrival, offset."""
    path, sent = str(tmp_path / "topic"), [0]

    def send(*messages):
        rows = []
        for value, arrived in messages:
            text = value if value is None or isinstance(value, str) else json.dumps(value)
            rows.append((None, None if text is None else text.encode(), "logs-raw", 0, sent[0], arrived))
            sent[0] += 1
        schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    send.path = path
    return send


def record(n, when=BASE, **more):
    plain = {"timestamp": when.isoformat(sep=" "), "level": "FATAL", "service": "s", "message": "m"}
    return {**plain, "trace_id": f"t{n}", **more}


def config_of(topic, tmp_path, **more):
    return jobs.StreamConfig(
        "parquet", topic.path, str(tmp_path / "out"), str(tmp_path / "c"), trigger=ONCE, **more
    )


# --- repeats -----------------------------------------------------------------


def test_repeats_are_left_out_across_a_restart_and_expire(spark, topic, tmp_path):
    config = config_of(topic, tmp_path, repeats="10 minutes")

    def run():
        query = jobs.start_feeds(spark, config, ("processed",))
        query.awaitTermination()
        return query.lastProgress.stateOperators[0]

    def seen():
        values = spark.read.text(config.feed("processed").location).collect()
        return sorted(json.loads(r.value)["trace_id"] for r in values)

    topic((record(1), at()), (record(2), at()), (record(1), at(seconds=1)), (record(3, at(days=-9)), at()))
    run()
    # An old event time is not a late arrival.
    assert seen() == ["t1", "t2", "t3"]
    topic((record(2), at(minutes=2)), (record(4), at(minutes=2)))
    run()
    assert seen() == ["t1", "t2", "t3", "t4"]
    # Much later traffic: the state of the first messages goes, that of new ones stays.
    topic((record(5), at(hours=1)))
    run()
    topic((record(6), at(hours=1)))
    assert run().numRowsTotal == 2
    assert seen() == ["t1", "t2", "t3", "t4", "t5", "t6"]


def test_repeats_of_a_table(spark, topic):
    topic((record(1), at()), (record(1), at(days=4)), (record(2), at()), (None, at()), (None, at()), ("", at()))
    found = without_repeats(spark.read.parquet(topic.path)).collect()
    assert sorted(r.offset for r in found) == [0, 2, 3, 4, 5]
    by_id = spark.createDataFrame([(BASE, "a", 1), (BASE, None, 2), (BASE, None, 3), (BASE, "a", 1)], "timestamp timestamp, id string, _sent_key int")
    found = without_repeats(by_id, F.col("id")).collect()
    assert sorted(r._sent_key for r in found) == [1, 2, 3]
    assert without_repeats(by_id.limit(0), F.col("id")).count() == 0


def test_statistics_without_repeats(spark, topic, tmp_path):
    config = config_of(topic, tmp_path, repeats="10 minutes")
    topic((record(1), at()), (record(1), at(seconds=5)), (record(2), at()))
    jobs.start_windows(spark, config, str(tmp_path / "stats")).awaitTermination()
    topic((record(2), at(minutes=1)))
    jobs.start_windows(spark, config, str(tmp_path / "stats")).awaitTermination()
    assert {r.total_logs for r in sinks.read_latest(spark, str(tmp_path / "stats")).collect()} == {2}
    with pytest.raises(ValueError):
        both = config_of(topic, tmp_path, repeats="1 minute", late=sinks.Sink("parquet", "x"))
        jobs.start_windows(spark, both, str(tmp_path / "other"))


# --- batches over several triggers --------------------------------------------


def accepted(spark, topic, tmp_path, **settings):
    schema = model.FULL.add("batch_id", "string") if "batch_id" not in model.FULL.names else model.FULL
    entries = streams.read_log_stream(spark, "parquet", topic.path)
    from logstream.operators.parse import parse_logs

    taken = accept_streamed_batches(parse_logs(entries, schema), **settings)
    sink = sinks.Sink("parquet", str(tmp_path / "taken"))
    query = sinks.write_stream(taken, sink, str(tmp_path / "c"), trigger=ONCE)
    query.awaitTermination()
    found = spark.read.schema("batch_id string, trace_id string").parquet(sink.location).collect()
    return sorted(((r.batch_id, r.trace_id) for r in found if r.batch_id != "open"), key=str), query


def test_a_batch_is_judged_once_it_is_over(spark, topic, tmp_path):
    def entry(batch, n, **more):
        return record(n, batch_id=batch, **more)

    topic((entry("a", 1), at()), (entry("b", 2), at()), (entry(None, 3), at()), (entry(None, 4, level="x"), at()))
    found, _ = accepted(spark, topic, tmp_path)
    # Entries without a batch go on at once, the others wait.
    assert found == [(None, "t3")]
    topic((entry("a", 5), at(seconds=50)), (entry("b", 6, message=""), at(seconds=50)), (entry("c", 7), at(seconds=50)))
    accepted(spark, topic, tmp_path)
    # Two triggers on, later traffic shows that the batches are over.
    for minute in (10, 11):
        topic((entry("open", minute), at(minutes=minute)))
        found, query = accepted(spark, topic, tmp_path)
    assert [f for f in found if f[0]] == [("a", "t1"), ("a", "t5"), ("c", "t7")]
    # Nothing of them waits any more, once the longest batch would be over.
    for hour in (3, 4, 5):
        topic((entry("open", hour), at(hours=hour)))
        _, query = accepted(spark, topic, tmp_path)
    assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) < 8


def test_too_large_and_too_long_batches(spark, topic, tmp_path):
    rows = [(record(n, batch_id="many"), at()) for n in range(4)]
    rows += [(record(n, batch_id="few"), at()) for n in range(10, 13)]
    rows += [(record(100 + n, batch_id="slow"), at(seconds=40 * n)) for n in range(4)]
    topic(*rows)
    accepted(spark, topic, tmp_path, most=3, longest="90 seconds")
    for hour in (1, 2):
        topic((record(99, batch_id="open"), at(hours=hour)))
        found, _ = accepted(spark, topic, tmp_path, most=3, longest="90 seconds")
    assert {batch for batch, _ in found} == {"few"} and len(found) == 3


# --- parts of a topic, and late rows -------------------------------------------


def test_parts_in_several_files_are_a_trigger_each(spark, tmp_path):
    from logstream.plans.storage import _in_files

    path, seen = str(tmp_path / "parts"), []
    rows = spark.range(0, 40, 1, 4)
    # Each task has rows of the first part, one of the second, none of the third, two of the last.
    parts = [rows.where(f"id % 10 IN ({n})") for n in ("0, 1", "2", "3")]
    parts = [parts[0], parts[1].where("id < 10"), parts[2].where("id < 0"), parts[2].where("id < 20")]
    files = _in_files(parts, path)
    assert files == 4 and len({r.f for r in spark.read.parquet(path).where("id % 10 < 2").select(F.input_file_name().alias("f")).collect()}) == 4
    stream = spark.readStream.schema("id long").options(**streams.file_options(files)).parquet(path)
    query = stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r.id for r in batch.collect())))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(**ONCE).start().awaitTermination()
    assert [batch for batch in seen if batch] == [[0, 1, 10, 11, 20, 21, 30, 31], [2], [3, 13]]


def test_a_micro_batch_of_windows_runs_once(spark, topic, tmp_path):
    """Late rows, table and messages come from one run of the micro-batch."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    plain = jobs.detected_logs
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jobs, "detected_logs", lambda sent: plain(sent).mapInArrow(counted, plain(sent).schema))
        config = config_of(topic, tmp_path, late=sinks.Sink("parquet", str(tmp_path / "late")))
        topic(*[(record(n), at(seconds=n)) for n in range(10)])
        jobs.start_windows(spark, config, str(tmp_path / "stats")).awaitTermination()
    # Once for the windows and once for the late rows; the closing batch has no rows.
    assert read.value == 20


def test_late_rows_are_kept_and_merged(spark, topic, tmp_path):
    sink, path = sinks.Sink("parquet", str(tmp_path / "late")), str(tmp_path / "stats")
    config = config_of(topic, tmp_path, late=sink)
    # One second is late for both of its windows; the last record for the first of its two.
    times = [at(), at(minutes=20), at(minutes=20), at(seconds=1), at(minutes=14, seconds=40)]
    for n, when in enumerate(times):
        topic((record(n, when), at(minutes=n)))
        jobs.start_windows(spark, config, path).awaitTermination()
    lost = spark.read.parquet(sink.location)
    assert sorted((r.trace_id, r.window_end.minute) for r in lost.collect())[:2] == [("t3", 0), ("t3", 1)]
    on_time = sinks.read_latest(spark, path)
    total = on_time.agg(F.sum("total_logs")).first()[0] + lost.count()
    assert total == 2 * len(times)
    merged = late.merged_windows(on_time, lost)
    rows = [json.loads(r.value) for r in spark.read.parquet(topic.path).selectExpr("CAST(value AS STRING) value").collect()]
    assert merged.agg(F.sum("total_logs")).first()[0] == 2 * len(rows)
    first = merged.where(F.col("window_start") == F.lit(BASE)).first()
    assert (first.total_logs, first.anomaly_count, first.anomaly_rate, first.avg_anomaly_score) == (2, 2, 1.0, 1.0)


def test_merging_adds_up(spark):
    schema = "window_start timestamp, window_end timestamp, service string, level string, "
    stats = spark.createDataFrame(
        [(BASE, BASE, "s", None, 4, 1, 0.25, 0.7, 0.25)],
        schema + "total_logs long, anomaly_count long, avg_anomaly_score double, max_anomaly_score double, anomaly_rate double",
    )
    rows = spark.createDataFrame(
        [(BASE, BASE, "s", None, BASE, True, 1.0, "t"), (BASE, BASE, "new", "INFO", BASE, False, 0.1, "t")],
        schema + "timestamp timestamp, is_anomaly boolean, anomaly_score double, trace_id string",
    )
    found = {r.service: r for r in late.merged_windows(stats, rows).collect()}
    assert (found["s"].total_logs, found["s"].avg_anomaly_score, found["s"].max_anomaly_score) == (5, 0.4, 1.0)
    assert found["s"].anomaly_rate == 0.4 and found["new"].total_logs == 1
    assert late.merged_windows(stats, rows.limit(0)).count() == 1
    assert late.merged_windows(stats.limit(0), rows).count() == 2


# --- offsets -----------------------------------------------------------------


def test_commits_say_where_a_query_is(spark, topic, tmp_path):
    from logstream.operators.topics import consumer_lag
    from logstream.streaming.offsets import committed

    config = config_of(topic, tmp_path, commits=str(tmp_path / "commits"))
    path = f"{config.commits}/feeds"
    assert committed(spark, path).count() == 0
    for turn in range(3):
        topic((record(turn), at()), ("not json", at()))
        lag = consumer_lag(spark.read.parquet(topic.path), committed(spark, path)).first()
        assert lag.consumer_lag == 2
        jobs.start_feeds(spark, config, ("processed",)).awaitTermination()
        (row,) = committed(spark, path).collect()
        assert (row.topic, row.partition, row.committed) == ("logs-raw", 0, 2 * turn + 2)
    assert len(list((tmp_path / "commits" / "feeds").glob("batch_id=*"))) <= 2


# --- state -------------------------------------------------------------------


def test_looking_into_the_state(spark, topic, tmp_path):
    from logstream.streaming import state

    config = config_of(topic, tmp_path)
    checkpoint = config.checkpoint("windows")
    topic((record(1), at()), (record(2, level="INFO"), at()))
    jobs.start_windows(spark, config, str(tmp_path / "stats")).awaitTermination()
    found = state.open_windows(spark, checkpoint)
    assert sorted((r.window_end.minute, r.level, r.total_logs, r.max_anomaly_score) for r in found.collect()) == [
        (0, "FATAL", 1, 1.0), (0, "INFO", 1, 0.1), (1, "FATAL", 1, 1.0), (1, "INFO", 1, 0.1),
    ]
    skew = state.state_skew(found).first()
    assert skew["keys"] == 4 and 0.25 <= skew["share"] <= 1 and skew["partitions"] <= 4
    # Later rows close these windows; an earlier micro-batch can still be read.
    topic((record(3, at(hours=1)), at()))
    jobs.start_windows(spark, config, str(tmp_path / "stats")).awaitTermination()
    assert state.open_windows(spark, checkpoint).count() == 2
    assert state.open_windows(spark, checkpoint, batch_id=0).count() == 4
    (operator,) = state.state_operators(spark, checkpoint).collect()
    assert operator.operatorName == "stateStoreSave"
