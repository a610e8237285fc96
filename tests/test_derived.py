"""Sketches, thresholds, dated rules and the indexed lake."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logstream.operators import dated_rules, search, sketches, stats, summaries, thresholds
from logstream.operators.rules import detect_v3
from logstream.sources import indexed

BASE = datetime(2024, 1, 3, 12, 0, tzinfo=timezone.utc)


def after(**parts):
    return BASE + timedelta(**parts)


# --- sketches ----------------------------------------------------------------


def test_distinct_counts_add_up(log):
    rows = [{"timestamp": after(minutes=m), "host": f"h{m % 3}", "service": f"s{m % 2}"} for m in range(120)]
    rows += [{"host": None, "service": "empty"}]
    minutes = sketches.distinct_minutes(log(*rows))
    assert minutes.count() == 121
    hours = {(r.service, r.hour_start): (r.rows, r.distinct) for r in sketches.distinct_over(minutes).collect()}
    assert sorted(hours.values()) == [(1, 0), (30, 3), (30, 3), (30, 3), (30, 3)]
    (day,) = sketches.distinct_over(minutes, "day", ()).collect()
    assert (day.rows, day.distinct) == (121, 3)
    assert sketches.distinct_over(minutes.limit(0)).count() == 0


def test_estimates_of_many_values(spark):
    df = spark.range(40_000).select(
        (F.lit(BASE) + F.expr("make_dt_interval(0, 0, 0, id % 7200)")).alias("timestamp"),
        F.lit("s").alias("service"),
        (F.col("id") % 20_000).cast("string").alias("host"),
    )
    (found,) = sketches.distinct_over(sketches.distinct_minutes(df), "day").collect()
    assert abs(found.distinct - 20_000) < 1000


# --- thresholds --------------------------------------------------------------


def test_merged_thresholds_keep_their_rank(spark):
    df = spark.range(60_000).select(
        (F.lit(BASE) + F.expr("make_dt_interval(cast(id % 6 as int))")).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("service"),
        F.pow(F.col("id") / 1000, 3).alias("value"),
    )
    days = thresholds.daily_sketches(df, F.col("value")).cache()
    assert days.count() == 6
    for start, end in ((None, None), (date(2024, 1, 4), date(2024, 1, 6))):
        part = df if start is None else df.where(F.to_date("timestamp").between(F.lit(start), F.lit(end)))
        for q in (0.5, 0.95, 0.999):
            limits = thresholds.thresholds(days, q, start, end)
            shares = thresholds.above(part, limits, F.col("value")).groupBy("service").agg(F.avg((~F.col("above")).cast("int")).alias("share"))
            found = shares.collect()
            assert len(found) == 2 and all(abs(r.share - q) < 0.01 for r in found)
    (both,) = thresholds.thresholds(days, 0.5, by=()).collect()
    assert both.n == 60_000 and abs(both.threshold - 30**3) < 0.03 * 30**3
    with pytest.raises(ValueError):
        thresholds.thresholds(days, 1.5)


def test_thresholds_of_odd_rows(log):
    rows = log({"service": None}, {"service": "a", "message": None}, {"service": "b", "timestamp": None}, {"service": "c"})
    days = thresholds.daily_sketches(rows, F.length("message"))
    limits = thresholds.thresholds(days, 0.95)
    assert {(r.service, r.n, r.threshold) for r in limits.collect()} == {(None, 1, 8.0), ("c", 1, 8.0)}
    judged = thresholds.above(rows, limits, F.length("message") + 1)
    assert {(r.service, r.above) for r in judged.collect()} == {(None, True), ("a", False), ("b", False), ("c", True)}
    assert thresholds.thresholds(days.limit(0), 0.95).count() == 0


# --- dated rules -------------------------------------------------------------


def test_rules_of_the_time(spark, log):
    rules = spark.createDataFrame(
        [
            ("user-service", after(), 2, "long", "longer_than", "3", 0.4),
            ("user-service", after(), 1, "info", "level_is", "INFO", 0.2),
            ("user-service", after(hours=30), 1, "none", "no_such_kind", "x", 0.9),
            ("user-service", after(hours=30), 2, "odd", "longer_than", "many", 0.9),
            ("other", after(days=-400), 1, "all", "longer_than", "0", 1.0),
        ],
        dated_rules.RULE_ROW,
    )
    hours = (-1, 0, 29, 30, 400)
    rows = [{"timestamp": after(hours=h), "trace_id": str(h)} for h in hours]
    rows += [{"timestamp": None}, {"service": None}, {"service": "other", "message": None, "level": None}]
    logs = log(*rows).withColumns({c: F.lit("mine") for c in ("_day", "_met", "version", "matched_rule")})
    found = dated_rules.detect_dated(logs, rules, after(days=3)).collect()
    assert len(found) == len(rows) and all(r._day == r._met == r.version == "mine" for r in found)
    got = {r.trace_id: (r.matched_rule, r.anomaly_score, r.is_anomaly) for r in found if r.trace_id != "t1"}
    assert got["-1"] == (None, 0.0, False)
    assert got["0"] == got["29"] == ("info", 0.4, True)
    assert got["30"] == got["400"] == (None, 0.0, False)
    assert [r.rules_from for r in found if r.trace_id == "30"] == [after(hours=30).replace(tzinfo=None)]
    # Beyond ``until`` no rule is known.
    assert [r.rules_from for r in found if r.trace_id == "400"] == [None]
    assert not any(r.is_anomaly for r in found if r.trace_id == "t1")
    assert dated_rules.detect_dated(logs.limit(0), rules, after()).count() == 0
    assert dated_rules.detect_dated(logs, rules.limit(0), after()).where("is_anomaly").count() == 0


# --- indexed lake ------------------------------------------------------------


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("indexed") / "lake")
    rows = spark.range(4000).select(
        (F.lit(BASE) + F.expr("make_dt_interval(0, cast(id % 96 as int), 0, id / 100)")).alias("timestamp"),
        F.when(F.col("id") % 7 == 0, "ERROR").otherwise("INFO").alias("level"),
        F.format_string("s%d", F.col("id") % 5).alias("service"),
        F.when(F.col("id") % 1000 == 999, None).otherwise(F.format_string("t%d", F.expr("id DIV 2"))).alias("trace_id"),
        F.lit("m").alias("message"),
    )
    rows.write.parquet(f"{root}-plain")
    plain = spark.read.parquet(f"{root}-plain")
    indexed.write_indexed(plain.where("level = 'INFO'"), root, 150)
    indexed.write_indexed(plain.where("level = 'ERROR'"), root, 150)
    return plain, root


def ids(frame):
    return [(r.timestamp, r.trace_id, r.service) for r in frame.collect()]


def test_a_trace_search_opens_two_files(spark, lake):
    plain, root = lake
    assert len(indexed.files_for(spark, root)) >= 20
    for trace in ("t0", "t777", "t1998"):
        # Two records share a trace; they may lie in a file each.
        named = indexed.files_for(spark, root, trace_id=trace)
        assert 1 <= len(named) <= 2
        found = indexed.search_indexed(spark, root, trace_id=trace)
        opened = {file.removeprefix("file:").lstrip("/") for file in found.inputFiles()}
        assert opened == {file.removeprefix("file:").lstrip("/") for file, _, _ in named}
        assert sorted(ids(found)) == sorted(ids(plain.where(F.col("trace_id") == trace))) and found.count() == 2
    assert ids(indexed.search_indexed(spark, root, trace_id="no such")) == []


@pytest.mark.parametrize(
    "filters",
    [
        {},
        {"service": "s3"},
        {"level": "ERROR"},
        {"service": "s1", "level": "ERROR", "start": after(hours=30), "end": after(hours=60)},
        {"start": after(days=90)},
        {"service": "nobody"},
    ],
)
def test_searches_equal_those_of_the_plain_table(spark, lake, filters):
    from logstream.operators.search import search_logs

    plain, root = lake
    for limit in (1, 60, 1000):
        want = [(t, s) for t, _, s in ids(search_logs(plain, limit, **filters))]
        found = indexed.search_indexed(spark, root, limit, **filters)
        assert [(t, s) for t, _, s in ids(found)] == want


def test_a_narrow_search_skips_files(spark, lake):
    _, root = lake
    every = indexed.files_for(spark, root)
    some = indexed.files_for(spark, root, service="s3", start=after(hours=20), end=after(hours=26))
    assert 0 < len(some) < len(every) / 3
    # The newest few rows need few of the files that could hold them.
    assert len(indexed.search_indexed(spark, root, 5).inputFiles()) < len(every) / 3


def test_small_files_share_a_task(spark, tmp_path):
    """As many tasks as the rows need, however small the files are to be."""
    root = str(tmp_path / "lake")
    rows = spark.range(4000).select(
        (F.lit(BASE) + F.expr("make_dt_interval(0, 0, 0, id)")).alias("timestamp"),
        F.format_string("s%d", F.col("id") % 5).alias("service"),
        F.format_string("t%d", F.col("id")).alias("trace_id"),
    )
    indexed.write_indexed(rows, root, 100)
    named = indexed.files_for(spark, root)
    assert sorted(count for _, _, count in named) == [100] * 40
    # A file's name begins with its task's number.
    assert len({file.rpartition("/")[2][:10] for file, _, _ in named}) == 1


def test_what_broke_off_is_not_found(spark, lake, monkeypatch):
    """Files that the index does not name do not count."""
    plain, root = lake
    before = len(indexed.files_for(spark, root))

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(indexed, "_index", fail)
    with pytest.raises(RuntimeError):
        indexed.write_indexed(plain.limit(10), root)
    assert len(indexed.files_for(spark, root)) == before


# --- results kept up to date ---------------------------------------------------


def test_kept_results_follow_the_records(spark, log, tmp_path):
    levels = ("FATAL", "INFO", "ERROR")
    rows = [
        {
            "timestamp": after(hours=5 * n),
            "level": levels[n % 3],
            "service": "ab"[n % 2] if n % 7 else None,
            "host": f"h{n}",
            "trace_id": f"t{n:02d}",
        }
        for n in range(30)
    ]
    path = str(tmp_path / "kept")
    found = detect_v3(log(*rows, {"timestamp": None, "level": "FATAL"}))
    day = F.to_date("timestamp")
    for first, last in ((3, 5), (6, 7), (8, 9), (6, 7)):
        summaries.replace_days(found.where(F.dayofmonth(day).between(first, last)), path)
    timed = found.where("timestamp IS NOT NULL")
    kept = summaries.read_summaries(spark, path)
    for unit in ("hour", "day"):
        want = stats.anomaly_trend(timed, unit)
        assert sorted(summaries.kept_trend(kept, unit).collect()) == sorted(want.collect())
    for limit in (1, 3, 50):
        want = search.recent_anomalies(timed, limit)
        assert summaries.kept_recent_anomalies(spark, path, limit).select(want.columns).collect() == want.collect()
    at = after(days=4, minutes=1)
    assert summaries.kept_snapshot(spark, path, at).collect() == stats.platform_snapshot(timed, at).collect()
    with pytest.raises(ValueError):
        summaries.kept_snapshot(spark, path, after(seconds=1))
    # A day that comes again changed replaces what was kept of it, and nothing else.
    summaries.replace_days(timed.where(F.dayofmonth(day) == 6).where("level <> 'FATAL'"), path)
    total = summaries.read_summaries(spark, path).agg(F.sum("logs")).first()[0]
    assert total == timed.where("NOT (day(timestamp) = 6 AND level = 'FATAL')").count()


def test_recent_anomalies_open_the_newest_days(spark, log, tmp_path):
    path = str(tmp_path / "kept")
    rows = [{"timestamp": after(days=d), "level": "FATAL", "trace_id": str(d)} for d in range(8)]
    summaries.replace_days(detect_v3(log(*rows)), path)
    for file in tmp_path.glob("kept/day=2024-01-0[3-5]/*.parquet"):
        file.write_bytes(b"broken")
    # Spark takes the columns from some file: give it one that is whole.
    found = summaries.kept_recent_anomalies(spark, path, 3).collect()
    assert [r.timestamp.day for r in found] == [10, 9, 8]
    assert summaries.summary_days(spark, path)[0].day == 3
