"""Parsing, validation, batches, features, detectors, alerts."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logstream import model
from logstream.operators import alerts, batches, features, parse, rules, validate
from logstream.operators.split import hash_split

NOON = datetime(2024, 1, 3, 12, 0, tzinfo=timezone.utc)


def envelope(spark, values):
    rows = [
        (None, None if v is None else bytearray(v.encode()), "logs-raw", 0, i, NOON)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, model.ENVELOPE)


def text_of(df, column="timestamp"):
    stamp = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return [r[0] for r in df.select(stamp).collect()]


# --- parsing -----------------------------------------------------------------


def test_time_forms(spark):
    values = [
        json.dumps({"timestamp": t, "message": "m"})
        for t in (
            "2024-01-01 00:00:07.179575+00:00",
            "2024-01-01T00:00:07.179575Z",
            "2024-01-01T02:00:07.179575+02:00",
            "yesterday",
        )
    ]
    df = parse.parse_logs(envelope(spark, values))
    assert text_of(df) == ["2024-01-01 00:00:07.179575"] * 3 + [None]
    assert parse.drop_incomplete(df).count() == 3


def test_malformed_rows_keep_their_place(spark):
    values = ["not json", '{"message": "half', None, "[]", '{"message": "ok", "level": "INFO"}']
    env = envelope(spark, values)
    rows = parse.parse_logs(env).orderBy("offset").collect()
    assert [r.message for r in rows] == [None, None, None, None, "ok"]
    assert rows[0].partition == 0 and rows[0].kafka_timestamp is not None
    three = parse.parse_logs(env, model.MINIMAL)
    assert three.columns == ["timestamp", "message", "level", "service"] and three.count() == 5
    four = parse.drop_incomplete(parse.parse_logs(env, model.MID), ("message", "level"))
    assert [r.message for r in four.collect()] == ["ok"]


def test_bare_parse_and_metadata_object(spark):
    value = '{"metadata": {"test_data": true, "n": {"a": [1, 2]}}, "message": "m"}'
    df = parse.parse_logs(envelope(spark, [value]), keep_envelope=False)
    assert df.columns == model.LOG_FIELDS
    df = parse.metadata_field(parse.metadata_field(df, "test_data"), "n.a[1]", "second")
    row = df.first()
    assert json.loads(row.metadata) == {"test_data": True, "n": {"a": [1, 2]}}
    assert (row.test_data, row.second) == ("true", "2")


def test_dead_letters_and_good_rows_are_all_rows(spark):
    values = ["not json", "{", None, '{"message": "ok"}', '{"timestamp": "bad time"}']
    good, dead = parse.split_malformed(envelope(spark, values))
    assert good.count() + dead.count() == len(values)
    assert [r.message for r in good.collect()] == ["ok"]
    assert sorted(r.offset for r in dead.collect()) == [0, 1, 2, 4]
    assert {r.raw for r in dead.collect()} == {"not json", "{", None, '{"timestamp": "bad time"}'}


def test_values_keep_microseconds_and_drop_nulls(spark, log):
    at = datetime(2024, 1, 1, 0, 0, 7, 179575, tzinfo=timezone.utc)
    (row,) = parse.as_values(log({"timestamp": at, "host": None})).collect()
    value = json.loads(row.value)
    assert value["timestamp"] == "2024-01-01T00:00:07.179575Z" and "host" not in value


# --- validation --------------------------------------------------------------


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, []),
        ({"level": None}, ["level"]),
        ({"level": "info"}, ["level"]),
        ({"message": ""}, ["message"]),
        ({"message": None}, ["message"]),
        ({"message": "é" * 10_000}, []),
        ({"message": "é" * 10_001}, ["message"]),
        ({"service": "s" * 100}, []),
        ({"service": "s" * 101}, ["service"]),
        ({"service": None}, ["service"]),
        ({"host": None, "environment": None, "trace_id": None, "span_id": None}, []),
        ({"host": "h" * 101, "environment": "e" * 51}, ["host", "environment"]),
        ({"environment": "e" * 50, "trace_id": "t" * 101, "span_id": "s" * 101}, ["trace_id", "span_id"]),
    ],
)
def test_validation(log, change, broken):
    good, bad = validate.validate(log(change))
    assert good.count() == (not broken)
    assert [r.reasons for r in bad.collect()] == ([broken] if broken else [])


def test_defaults(log):
    at = datetime(2024, 5, 5, tzinfo=timezone.utc)
    df = log({"timestamp": None, "environment": None, "trace_id": ""}, {"trace_id": "t2"})
    first, second = validate.apply_defaults(df, at).collect()
    assert first.environment == "production" and first.log_id.startswith("log_")
    assert second.log_id == "t2"
    assert text_of(validate.apply_defaults(df, at))[0] == "2024-05-05 00:00:00.000000"
    assert validate.apply_defaults(df).where("timestamp IS NULL").count() == 0


# --- batches -----------------------------------------------------------------


def batch_rows(spark, log, sizes, bad=()):
    records = [{"span_id": f"{i}", "trace_id": f"{b}.{i}"} for b, n in sizes.items() for i in range(n)]
    for record in records:
        if record["trace_id"] in bad:
            record["level"] = "LOUD"
    batch = F.substring_index("trace_id", ".", 1)
    return log(*records).withColumn("batch_id", F.nullif(batch, F.lit("none")))


def test_accept_batches(spark, log):
    df = batch_rows(spark, log, {"a": 3, "b": 4, "c": 2, "none": 3}, bad=["c.1", "none.2"])
    kept = batches.accept_batches(df, most=3)
    assert kept.columns == df.columns
    assert sorted(r.trace_id for r in kept.collect()) == ["a.0", "a.1", "a.2", "none.0", "none.1"]
    kept = batches.accept_batches(df, most=4)
    assert sorted({r.batch_id or "" for r in kept.collect()}) == ["", "a", "b"]


@pytest.mark.parametrize("most", [1, 2, 3, 10_000])
def test_batches_are_accounted_for(spark, log, most):
    """Accepted and refused are the input, and the outcome says the same as the acceptance."""
    df = batch_rows(spark, log, {"a": 1, "b": 3, "c": 2, "none": 4}, bad=["c.1", "none.0"])
    outcome = batches.batch_outcome(df, most).agg(F.sum("processed"), F.sum("failed")).first()
    assert outcome[0] + outcome[1] == df.count()
    assert outcome[0] == batches.accept_batches(df, most).count()


def test_long_batch_ids(spark, log):
    long_id = "z" * 300
    df = batch_rows(spark, log, {"a": 2, "b": 5}).replace("b", long_id, "batch_id")
    assert {r.batch_id for r in batches.accept_batches(df, most=2).collect()} == {"a"}
    assert {r.batch_id for r in batches.accept_batches(df, most=5).collect()} == {"a", long_id}


def test_batch_outcome(spark, log):
    df = batch_rows(spark, log, {"a": 2, "b": 3, "none": 1}, bad=["b.0", "b.2"])
    found = {r.batch_id: (r.processed, r.failed, r.status) for r in batches.batch_outcome(df).collect()}
    assert found == {
        "a": (2, 0, "success"), "b": (0, 3, "refused"), None: (1, 0, "success"),
    }


def test_nested_batches(spark):
    def request(name, *levels):
        logs = [{"level": v, "message": "m", "service": "s"} for v in levels]
        return json.dumps({"batch_id": name, "logs": logs})

    values = [request("a", "INFO", "WARN"), request("b", "INFO", "LOUD"), request("c"), "not json"]
    late = {"batch_id": None, "logs": [{"level": "INFO", "message": "m", "service": "s", "timestamp": "soon"}]}
    null = {"logs": [{"level": "INFO", "message": "m", "service": "s", "environment": None}]}
    judged = batches.judge_batches(parse.parse_batches(envelope(spark, [*values, json.dumps(late), json.dumps(null)])))
    rows = batches.explode_batches(judged).collect()
    named = [(r.batch_id, r.level, r.environment) for r in rows if r.batch_id == "a"]
    assert named == [("a", "INFO", "production"), ("a", "WARN", "production")]
    (other,) = [r for r in rows if r.batch_id != "a"]
    assert other.batch_id.startswith("batch-") and other.environment is None and other.timestamp is not None
    assert batches.explode_batches(judged).columns == ["batch_id", *model.LOG_FIELDS, "log_id"]
    outcome = batches.nested_outcome(judged)
    assert outcome.agg(F.sum("processed"), F.sum("failed")).first() == (3, 3)
    assert sorted(r.status for r in outcome.collect()) == ["refused"] * 4 + ["success"] * 2
    assert "not json" in {r.raw for r in batches.refused_batches(judged).collect()}
    long = request("z", *["INFO"] * 10_001)
    too_long = batches.judge_batches(parse.parse_batches(envelope(spark, [long])))
    assert batches.explode_batches(too_long).count() == 0


def test_ingest_takes_valid_entries(log):
    taken = batches.ingest(log({"trace_id": "a"}, {"level": None, "trace_id": "b"}))
    assert [r.log_id for r in taken.collect()] == ["a"]


# --- features ----------------------------------------------------------------


def test_given_measures_are_kept(spark, log):
    df = log({"message": "a b c"}).withColumn("word_count", F.lit(99))
    row = features.feature_engineering(df).first()
    assert (row.word_count, row.message_length) == (99, 5)


def test_null_message_gives_null_flags(log):
    row = features.feature_engineering(log({"message": None, "level": None, "service": None})).first()
    assert row.has_exception is None and row.message_length is None and row.word_count is None
    assert (row.message_entropy, row.level_numeric, row.service_encoded) == (0.0, 1, 0)


def test_feature_columns(log):
    found = features.feature_engineering(log({})).columns
    assert set(model.ANOMALY_FEATURES) <= set(found) and "lower_message" not in found


# --- detectors ---------------------------------------------------------------


def at_hour(hour):
    return datetime(2024, 1, 3, hour, 30, tzinfo=timezone.utc)


def test_detector_v1(log):
    df = log(
        {"trace_id": "a", "level": "ERROR"}, {"trace_id": "b", "message": "x" * 1000},
        {"trace_id": "c", "message": "x" * 1001}, {"trace_id": "d", "level": "FATAL"},
        {"trace_id": "e", "level": None, "message": None},
        {"trace_id": "f", "level": None, "message": "x" * 1001},
    )
    assert [r.trace_id for r in rules.detect_v1(df).collect()] == ["a", "c", "f"]


def test_detector_v2(log):
    df = log(
        {"trace_id": "a", "level": "ERROR"}, {"trace_id": "b", "level": "FATAL"},
        {"trace_id": "c", "message": "Timeout"}, {"trace_id": "d", "message": "panic"},
        {"trace_id": "e", "message": "y" * 1001},
    )
    found = {r.trace_id: r.anomaly_score for r in rules.detect_v2(df).collect()}
    assert found == {"a": 0.8, "b": 1.0, "c": 0.6, "e": 0.6}


@pytest.mark.parametrize(
    "change, flagged, score",
    [
        ({}, False, 0.1),
        ({"level": "FATAL"}, True, 1.0),
        ({"level": "FATAL", "message": None}, True, 1.0),
        ({"level": None, "message": None}, False, 0.1),
        ({"message": "Java HEAP space"}, True, 0.95),
        ({"level": "ERROR", "message": "out of memory"}, True, 0.95),
        ({"message": "Segmentation fault"}, True, 0.1),
        ({"message": "an Exception"}, True, 0.7),
        ({"message": "timeout and exception"}, True, 0.7),
        ({"message": "timeout, failed"}, True, 0.6),
        ({"message": "it failed"}, True, 0.5),
        ({"message": "connection refused"}, True, 0.1),
        ({"message": "x" * 2000}, False, 0.1),
        ({"message": "x" * 2001}, True, 0.1),
        ({"message": " " * 149}, False, 0.1),
        ({"message": " " * 150}, True, 0.1),
        ({"level": "ERROR", "timestamp": at_hour(5)}, True, 0.8),
        ({"level": "ERROR", "timestamp": at_hour(6)}, False, 0.8),
        ({"level": "WARN", "timestamp": at_hour(3)}, False, 0.1),
        ({"message": "card Declined"}, False, 0.1),
        ({"message": "card Declined", "service": "payment-service"}, True, 0.1),
        ({"message": "Unauthorized", "service": "auth-service"}, True, 0.1),
        ({"message": "Unauthorized", "service": None}, False, 0.1),
    ],
)
def test_detector_v3(log, change, flagged, score):
    (row,) = rules.detect_v3(log(change)).collect()
    assert (row.is_anomaly, row.anomaly_score) == (flagged, score)
    assert (row.matched_rule is not None) == flagged


def test_own_rules(log):
    own = [rules.Rule("quote", rules.has_word(["it's", "a\\b"]), 0.9), rules.Rule("late", "hour = 23", 0.3)]
    df = log({"message": "IT'S so"}, {"message": "x A\\B"}, {"timestamp": at_hour(23)}, {})
    found = [(r.matched_rule, r.severity) for r in rules.detect_v3(df, own, own, 0.0).collect()]
    assert found == [("quote", "CRITICAL"), ("quote", "CRITICAL"), ("late", "LOW"), (None, "LOW")]


# --- alerts ------------------------------------------------------------------


def test_alerts(spark, log):
    found = rules.detect_v3(
        log({"level": "FATAL", "message": "é" * 300}, {"level": "FATAL", "message": None}, {})
    )
    one, two = alerts.to_alerts(found).collect()
    assert one.description == "Anomaly detected in user-service service: " + "é" * 100
    assert two.description is None and one.detection_timestamp is not None
    again = alerts.to_alerts(found.repartition(3)).collect()
    assert {r.alert_id for r in again} == {one.alert_id, two.alert_id}
    alike = rules.detect_v3(log(*[{"level": "FATAL", "trace_id": None, "service": s} for s in "ab"]))
    assert len({r.alert_id for r in alerts.to_alerts(alike).collect()}) == 2
    placed = found.withColumns({"partition": F.lit(1), "offset": F.lit(5)})
    assert one.alert_id not in {r.alert_id for r in alerts.to_alerts(placed).collect()}


def test_routes(log):
    found = rules.detect_v3(log({"level": "FATAL"}, {"message": "it failed"}, {}))
    sizes = {name: alerts.route(found, name).count() for name in set(model.TOPICS) - {"raw", "service_metrics"}}
    assert sizes == {"processed": 3, "anomalies": 2, "high_priority": 1, "training": 3}
    assert alerts.route(found, "service_metrics").agg(F.sum("total_logs")).first()[0] == 6
    with pytest.raises(ValueError):
        alerts.route(found, "nowhere")


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("trace_id"))
    train, test = hash_split(df)
    assert train.count() + test.count() == 5000 and 3900 < train.count() < 4100
    again, _ = hash_split(df.repartition(7))
    assert again.exceptAll(train).count() == 0
    untraced = df.withColumns({"message": F.col("trace_id"), "trace_id": F.lit(None).cast("string")})
    train, test = hash_split(untraced)
    assert 3900 < train.count() < 4100 and train.count() + test.count() == 5000
    everything, nothing = hash_split(df, share=1.0)
    assert (everything.count(), nothing.count()) == (5000, 0)
