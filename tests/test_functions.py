import re

import pytest
from pyspark.sql import functions as F

from logstream import model
from logstream.functions import clock, codes, ids, text

TEXTS = ["", " ", "a  b", "a b ", " a", "w " * 160, "überall größe", "日本 語", "x\ny z", "a b", None]


def test_space_pieces_is_split_size(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    rows = df.select("t", text.space_pieces(F.col("t")).alias("n"), F.size(F.split("t", " ")).alias("m"))
    for row in rows.collect():
        assert row.n == row.m
        if row.t is not None:
            assert row.n == len(row.t.split(" "))


@pytest.mark.parametrize("words", [model.FAILURE_WORDS, model.MEMORY_WORDS, model.PERFORMANCE_WORDS])
def test_mentions_is_case_insensitive_find(spark, words):
    samples = [
        "ExCePtIoN!", "no\nOUT OF memory", "Heap  Space", "slowly", "", None, "faİled", "FAİLED",
        "tımeout", "ERRÖR", "critıcal PANIC", "Überhigh", "exceeds", "refuſed", "Kernel panic",
    ]
    df = spark.createDataFrame([(t,) for t in samples], "t STRING")
    rows = df.select("t", text.mentions(F.col("t"), words).alias("hit"))
    for row in rows.collect():
        pattern = "|".join(words)
        expected = None if row.t is None else bool(re.search(pattern, row.t, re.I | re.A))
        assert row.hit == expected, row.t


def test_entropy(spark):
    df = spark.createDataFrame([(8, 100), (1, 50), (0, 5), (None, None)], "w INT, n INT")
    found = [r[0] for r in df.select(text.length_weighted_entropy(F.col("w"), F.col("n"))).collect()]
    assert found == [0.3, 0.0, 0.0, 0.0]


def test_codes(spark):
    df = spark.createDataFrame([("DEBUG",), ("FATAL",), ("debug",), (None,)], "level STRING")
    assert [r[0] for r in df.select(codes.level_code(F.col("level"))).collect()] == [0, 4, 1, 1]
    names = spark.createDataFrame([("auth-service",), ("x",), (None,)], "s STRING")
    assert [r[0] for r in names.select(codes.service_code(F.col("s"))).collect()] == [5, 0, 0]


def test_severity_edges(spark):
    scores = [1.0, 0.9, 0.8999, 0.7, 0.6999, 0.5, 0.4999, 0.0]
    df = spark.createDataFrame([(s,) for s in scores], "s DOUBLE")
    found = [r[0] for r in df.select(codes.severity(F.col("s"))).collect()]
    assert found == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_parts_of_day(spark):
    hours = spark.range(24).select(
        "id", F.expr("timestamp_ntz'2024-01-01 00:30:00' + make_interval(0,0,0,0,cast(id as int))").alias("t")
    )
    t = F.col("t")
    rows = hours.select("id", clock.is_night_time(t).alias("n"), clock.is_business_hours(t).alias("b")).collect()
    assert {r.id for r in rows if r.n} == {22, 23, 0, 1, 2, 3, 4, 5, 6}
    assert {r.id for r in rows if r.b} == set(range(9, 18))
    days = spark.range(7).select(
        F.expr("timestamp_ntz'2024-01-01 00:30:00' + make_interval(0,0,0,cast(id as int))").alias("t")
    )
    assert [r[0] for r in days.orderBy("t").select(clock.is_weekend(t)).collect()] == [0, 0, 0, 0, 0, 1, 1]


def test_ids(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678901' AS ts, CAST(NULL AS STRING) AS m, '' AS e")
    ts, m, e = F.col("ts"), F.col("m"), F.col("e")
    row = df.select(
        ids.alert_id(ts, F.lit("a"), m), ids.alert_id(ts, F.lit("a"), e), ids.alert_id(ts, F.lit("b"), m),
        ids.log_id(F.lit("t9"), ts, m, m), ids.log_id(e, ts, m, m), ids.log_id(m, ts, m, m),
    ).first()
    assert row[0].startswith("alert_20240102030405_") and len(row[0]) == 21 + 32
    assert len({row[0], row[1], row[2]}) == 3
    assert row[3] == "t9" and row[4] == row[5] and row[4].startswith("log_")
