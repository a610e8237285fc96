"""Window statistics, counters, topics, quality, forecast, search."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from logstream import model
from logstream.operators import batches, search, stats, topics
from logstream.operators.evaluate import confusion_matrix
from logstream.operators.forecast import service_load_trend
from logstream.operators.rules import detect_v3
from logstream.sources.lake import write_lake
from logstream.sources.streams import read_topics

START = datetime(2024, 1, 3, 12, 0, tzinfo=timezone.utc)


def after(**parts):
    return START + timedelta(**parts)


# --- windows and counters ----------------------------------------------------


def test_each_record_is_in_two_windows(log):
    found = detect_v3(log({"timestamp": after(seconds=45)}, {"timestamp": after(seconds=50), "level": "FATAL"}))
    rows = stats.window_stats(found).orderBy("window_start", "level").collect()
    starts = [(r.window_start.replace(tzinfo=timezone.utc), r.level) for r in rows]
    assert starts == [(after(seconds=0), "FATAL"), (after(seconds=0), "INFO"),
                      (after(seconds=30), "FATAL"), (after(seconds=30), "INFO")]
    assert [(r.total_logs, r.anomaly_count, r.anomaly_rate) for r in rows] == [(1, 1, 1.0), (1, 0, 0.0)] * 2
    assert stats.window_stats(found, "1 hour", None).count() == 2


def test_live_counters_by_shape(log):
    found = detect_v3(log({"level": "FATAL"}, {"level": "ERROR"}, {"level": None}))
    by_flag = stats.live_counters(found.drop("severity")).first()
    assert tuple(by_flag) == (3, 1, 2)
    assert stats.live_counters(found).first().anomalies < stats.live_counters(found).first().total
    assert stats.live_counters(found.drop("is_anomaly")).first().anomalies == 3
    assert stats.live_counters(log({})).first().anomalies == 0


def test_observed_counts(spark, log):
    from pyspark.sql import Observation

    found = detect_v3(log({"level": "FATAL"}, {}))
    counts = Observation("seen")
    assert stats.observe_counts(found.drop("severity"), counts).count() == 2
    assert counts.get == {"rows": 2, "anomalies": 1}


def test_snapshot(log):
    def records(service, errors, total, hours):
        return [
            {"service": service, "level": "ERROR" if i < errors else "INFO", "timestamp": after(hours=hours)}
            for i in range(total)
        ]

    rows = (
        records("fine", 1, 10, 0) + records("weak", 3, 10, 0) + records("bad", 6, 10, 0)
        + records("silent", 0, 2, -2) + records("old", 0, 2, -24 * 8) + records("later", 0, 1, 1)
    )
    found = detect_v3(log(*rows)).withColumn("label", F.col("level") == "ERROR")
    row = stats.platform_snapshot(found, START, label="label").first()
    assert row.services.asDict() == {"healthy": 1, "degraded": 1, "down": 3}
    assert row.ingestion.total_logs_today == 32
    assert row.ingestion.logs_per_second == pytest.approx(30 / 3600)
    assert row.ingestion.error_rate == pytest.approx(10 / 32)
    assert row.anomalies.detection_accuracy == pytest.approx(22 / 32)
    by_default = stats.platform_snapshot(found).first()
    assert by_default.services.asDict() == {"healthy": 1, "degraded": 0, "down": 5}
    listed = log({"service": "never seen"}).select("service")
    row = stats.platform_snapshot(found, START, services=listed).first()
    assert row.services.asDict() == {"healthy": 0, "degraded": 0, "down": 1}
    empty = stats.platform_snapshot(found.where("false"), START).first()
    assert empty.ingestion.total_logs_today == 0 and empty.anomalies.detection_accuracy is None


def test_service_breakdown_ranks_severity(log):
    found = detect_v3(log({"message": "it failed"}, {"level": "FATAL"}, {"service": "x", "message": "refused"}, {}))
    rows = {r.service: (r.anomalies, r.severity) for r in stats.service_breakdown(found).collect()}
    assert rows == {"user-service": (2, "CRITICAL"), "x": (1, "LOW")}


# --- quality -----------------------------------------------------------------


def test_confusion_matrix(spark):
    pairs = [(True, True)] * 3 + [(False, True)] + [(True, False)] * 2 + [(False, False)] * 4 + [(None, True)]
    df = spark.createDataFrame(pairs, "y BOOLEAN, p BOOLEAN")
    row = confusion_matrix(df, "y", "p").first()
    assert (row.tp, row.fp, row.fn, row.tn) == (3, 1, 2, 4)
    assert (row.accuracy, row.precision, row.recall, row.anomaly_rate) == (0.7, 0.75, 0.6, 0.5)
    assert row.f1_score == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    none = confusion_matrix(df.where("y IS NULL"), "y", "p").first()
    assert set(none) == {0, 0.0}


# --- topics ------------------------------------------------------------------


def test_lag(spark):
    rows = [(None, bytearray(b"abc"), "a", p, o, START) for p in (0, 1) for o in range(10)]
    env = spark.createDataFrame(rows + [(None, bytearray(b""), "_x", 0, 4, START)], model.ENVELOPE)
    committed = spark.createDataFrame([("a", 0, 7), ("_x", 0, 99)], "topic STRING, partition INT, committed BIGINT")
    assert {r.topic: r.consumer_lag for r in topics.consumer_lag(env, committed).collect()} == {"a": 13, "_x": 0}
    assert [tuple(r) for r in topics.topic_inventory(env).collect()] == [("a", 2)]
    (rate,) = topics.topic_throughput(env.where("topic = 'a'")).collect()
    assert (rate.messages, rate.bytes, rate.messages_per_sec, rate.bytes_per_sec) == (20, 60, 20 / 60, 1.0)
    quiet = topics.topic_details(topics.topic_inventory(env), topics.topic_throughput(env.where("false")).drop("window_start"))
    assert quiet.first().messages_per_sec == 0.0


def test_read_topics(log):
    merged = read_topics({"a": log({}).select("message"), "b": log({}).select("level")})
    assert sorted((r.topic, r.message, r.level) for r in merged.collect()) == [("a", "all well", None), ("b", None, "INFO")]


# --- forecast ----------------------------------------------------------------


def test_trend_counts_quiet_hours_as_zero(log):
    loads = [5, 0, 0, 7, 9, 0, 12]
    rows = [{"timestamp": after(hours=h, minutes=i)} for h, n in enumerate(loads) for i in range(n)]
    row = service_load_trend(log(*rows), horizon=2).first()
    x, y = np.arange(len(loads)), np.array(loads)
    slope, base = np.polyfit(x, y, 1)
    assert row.units == 7 and row.mean_load == pytest.approx(y.mean())
    assert row.slope == pytest.approx(slope)
    assert row.predicted_load == pytest.approx(base + slope * 8)
    assert row.change_pct == pytest.approx((base + slope * 8) / y.mean() * 100 - 100)
    assert row.confidence == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)


def test_trend_of_a_single_unit_is_unknown(log):
    row = service_load_trend(log({}, {})).first()
    assert (row.units, row.mean_load, row.slope, row.confidence) == (1, 2.0, None, None)


# --- search ------------------------------------------------------------------


def test_search_bounds(log):
    df = log(*[{"timestamp": after(minutes=m), "trace_id": f"t{m}"} for m in range(5)])
    found = search.search_logs(df, start=after(minutes=1), end=after(minutes=3))
    assert [r.trace_id for r in found.collect()] == ["t2", "t1"]
    assert [r.trace_id for r in search.search_logs(df, limit=1).collect()] == ["t4"]
    summary = search.search_summary(df, service="user-service", level="FATAL").first()
    assert summary.total_count == 0 and summary.filters_applied.level == "FATAL"
    for limit in (0, 10_001):
        with pytest.raises(ValueError):
            search.search_logs(df, limit=limit)


@pytest.mark.parametrize("limit", [1, 7, 40, 200, 500])
def test_newest_is_the_sorted_head(spark, limit):
    """Many rows share a minute or even a time; some hours are empty."""
    df = spark.range(200).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id % 7 as int), "
               "cast(id % 3 as int), id % 2)").alias("timestamp"),
        F.format_string("t%03d", F.col("id")).alias("trace_id"),
    )
    found = [r.trace_id for r in search.newest(df, limit).collect()]
    order = sorted(df.collect(), key=lambda r: r.trace_id)
    order = sorted(order, key=lambda r: r.timestamp, reverse=True)
    assert found == [r.trace_id for r in order][:limit]


def test_rows_without_a_time_come_last(log):
    rows = log({"timestamp": None, "trace_id": "a"}, {"trace_id": "b"}, {"timestamp": None, "trace_id": "c"})
    found = [[r.trace_id for r in search.newest(rows, n).collect()] for n in (1, 2, 5)]
    assert found == [["b"], ["b", "a"], ["b", "a", "c"]]


def test_newest_counts_the_days_of_the_lake_by_folder(spark, log, tmp_path):
    from logstream.sources.lake import write_lake

    rows = [{"timestamp": after(hours=5 * h), "trace_id": f"t{h:02d}"} for h in range(20)]
    write_lake(log(*rows), str(tmp_path / "lake"))
    lake = spark.read.parquet(str(tmp_path / "lake"))
    found = search.newest(lake, 7)
    assert [r.trace_id for r in found.collect()] == [f"t{h:02d}" for h in range(19, 12, -1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "PartitionFilters: [" in plan


def test_a_search_of_the_lake_opens_only_the_days_it_needs(spark, log, tmp_path):
    rows = [{"timestamp": after(hours=12 * h), "trace_id": f"t{h:02d}", "service": f"s{h % 2}"} for h in range(40)]
    root = str(tmp_path / "lake")
    write_lake(log(*rows), root)
    plain = spark.read.parquet(root)
    # Days that are not needed cannot be read any more.
    for part in tmp_path.glob("lake/year=*/month=*/day=*/*.parquet"):
        if int(part.parent.name[4:]) < 15:
            part.write_bytes(b"broken")
    found = search.search_lake(spark, root, 5).collect()
    assert [r.trace_id for r in found] == [f"t{h:02d}" for h in range(39, 34, -1)]
    found = search.search_lake(spark, root, 3, service="s1", end=after(hours=12 * 37)).collect()
    assert [r.trace_id for r in found] == ["t35", "t33", "t31"]
    with pytest.raises(Exception):
        plain.collect()


def test_a_search_of_the_lake_equals_a_search_of_its_rows(spark, log, tmp_path):
    rows = [{"timestamp": after(hours=7 * h), "trace_id": f"t{h:02d}"} for h in range(20)] + [{"timestamp": None}]
    root = str(tmp_path / "lake")
    write_lake(log(*rows), root)
    for limit in (1, 4, 20, 21, 100):
        want = [r.trace_id for r in search.search_logs(log(*rows), limit).collect()]
        assert [r.trace_id for r in search.search_lake(spark, root, limit).collect()] == want
    with pytest.raises(ValueError):
        search.search_lake(spark, root, 0)


def test_helper_columns_do_not_clash(spark, log):
    rows = log({"trace_id": "a"}, {"trace_id": "b"}).withColumns(
        {c: F.lit("kept") for c in ("_part", "_row", "_n", "_first", "_before", "_place", "_salt", "_key", "_taken")}
    )
    for made in (search.numbered_per_group(rows, ["service"]), search.newest_per_group(rows, ["service"], 2)):
        assert made.columns == [*rows.columns, "position"]
        assert [(r.position, r.trace_id, r._part, r._n) for r in made.orderBy("position").collect()] == [
            (1, "a", "kept", "kept"), (2, "b", "kept", "kept"),
        ]
    batched = rows.withColumn("batch_id", F.lit("x"))
    taken = batches.accept_batches(batched)
    assert taken.columns == batched.columns and taken.where("_salt = 'kept' AND _key = 'kept'").count() == 2


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_newest_per_group_is_the_sorted_head(spark, n):
    df = spark.range(3000).select(
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id % 50 as int))").alias("timestamp"),
        F.format_string("t%04d", "id").alias("trace_id"),
        F.lit("m").alias("message"),
        F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("service"),
    )
    found = search.newest_per_group(df, ["service"], n)
    for service in ("hot", "cold"):
        order = df.where(F.col("service") == service).orderBy(F.desc("timestamp"), "trace_id")
        want = [r.trace_id for r in order.limit(n).collect()]
        got = [r.trace_id for r in found.where(F.col("service") == service).orderBy("position").collect()]
        assert got == want


def test_search_does_not_depend_on_the_machine_zone(log, monkeypatch):
    import time
    from datetime import datetime, timezone

    rows = log({"timestamp": datetime(2024, 1, 5, 1, tzinfo=timezone.utc)})
    for zone in ("UTC", "America/New_York"):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        try:
            found = search.matching(rows, start=datetime(2024, 1, 5), end=datetime(2024, 1, 6))
            assert found.count() == 1
            at = stats.platform_snapshot(detect_v3(rows), datetime(2024, 1, 5, 1, 30)).first()
            assert at.ingestion.total_logs_today == 1
        finally:
            monkeypatch.undo()
            time.tzset()


def test_recent_anomalies(log):
    rows = [
        {"level": "FATAL", "host": "a", "message": "first", "trace_id": "1"},
        {"level": "FATAL", "host": "b", "message": "second", "trace_id": "2", "timestamp": after(minutes=9)},
        {"level": "FATAL", "host": "b", "message": None, "trace_id": "3", "timestamp": after(hours=2)},
        {"host": "c"},
    ]
    new, old = search.recent_anomalies(detect_v3(log(*rows))).collect()
    assert new.description is None and new.affected_hosts == 1
    assert old.description.endswith("second") and old.affected_hosts == 2 and old.severity == "CRITICAL"
    assert old.id != new.id and old.score == 1.0


def test_recent_by_service_minute(log):
    rows = [{"timestamp": after(minutes=m, seconds=s), "trace_id": f"{m}.{s}"} for m in (0, 1, 61) for s in (0, 5)]
    listed = search.recent_by_service_minute(log(*rows), after(minutes=61, seconds=2))
    assert [r.trace_id for r in listed.collect()] == ["1.5", "61.0"]
    longer = search.recent_by_service_minute(log(*rows), after(minutes=62), "2 hours", positions=True)
    assert [(r.trace_id, r.position) for r in longer.collect()] == [
        ("0.5", 1), ("0.0", 2), ("1.5", 1), ("1.0", 2), ("61.5", 1), ("61.0", 2),
    ]
    by_default = search.recent_by_service_minute(log(*rows))
    assert [r.trace_id for r in by_default.collect()] == ["61.5", "61.0"]


def test_recent_positions_count_every_record(log):
    rows = [
        {"timestamp": after(seconds=s), "trace_id": f"{s:02}{t}", "service": service}
        for s in range(40) for t in "ab" for service in ("user-service", None)
    ]
    listed = search.recent_by_service_minute(log(*rows), after(minutes=1), positions=True).collect()
    assert len(listed) == 160
    want = [f"{s:02}{t}" for s in reversed(range(40)) for t in "ab"]
    for service in ("user-service", None):
        of = [r for r in listed if r.service == service]
        assert [(r.position, r.trace_id) for r in of] == list(enumerate(want, 1))


def test_top_anomalies(log):
    rows = [{"level": "FATAL", "timestamp": after(minutes=m), "trace_id": f"t{m}"} for m in range(4)]
    top = search.top_anomalies(detect_v3(log(*rows)), 2).orderBy("position").collect()
    assert [(r.position, r.trace_id) for r in top] == [(1, "t3"), (2, "t2")]


def test_live_feed_mixes_shapes(spark, log):
    from logstream.operators.alerts import to_alerts

    found = detect_v3(log({"trace_id": "a"}, {"trace_id": "b", "level": "FATAL", "message": None}))
    feed = search.live_feed(found.drop("severity", "anomaly_score"), to_alerts(found)).collect()
    assert sorted((r.trace_id, r.flagged, r.text) for r in feed if r.trace_id == "a") == [("a", False, "all well")]
    assert len([r for r in feed if r.trace_id == "b" and r.flagged]) == 2
    only = search.live_feed(found, to_alerts(found), level="INFO", service="user-service")
    assert [r.trace_id for r in only.collect()] == ["a"]
