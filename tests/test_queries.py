"""Every registered query against its oracle, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry_points
import check
from logstream.operators import batches
from logstream.plans import records, registry

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
TRAINS = {
    "cluster_sizes", "model_scores", "anomaly_model_metrics", "level_classifier",
    "level_classifier_one_hot", "level_classifier_tuned", "anomaly_classifier",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    return check.connect(sf_dir)


def test_only_model_fits_go_without_an_oracle():
    assert set(QUERIES) - set(ORACLES) == TRAINS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_oracle(spark, sf_dir, db, name):
    frame = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLES[name])
    assert check.compare(frame.toPandas(), want.df()) is None
    assert check.type_differences(frame, want) is None


CHECKS = {"anomaly_model_checks", "classifier_checks"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINS - CHECKS - {n for n in QUERIES if "stream" in n}))
def test_plan_stays_in_the_jvm_without_cross_joins(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "InPandas", "InArrow"):
        assert node not in plan, node


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_search_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["search_logs"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts,2024-01-05" in pushed and "LessThan(ts,2024-01-20" in pushed
    assert "TakeOrderedAndProject" in plan


def test_a_stored_table_gets_all_search_filters(spark, sf_dir, tmp_path):
    from datetime import datetime

    from logstream.operators import search
    from logstream.plans import fixture

    fixture.logs(spark, sf_dir).write.parquet(str(tmp_path / "logs"))
    stored = spark.read.parquet(str(tmp_path / "logs"))
    found = search.search_logs(stored, service="auth-service", level="ERROR", start=datetime(2024, 1, 5))
    details = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    rows, counted = details.split("===== Subqueries =====")
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", rows).group(1)
    for part in ("EqualTo(service,auth-service)", "EqualTo(level,ERROR)", "GreaterThanOrEqual(timestamp,2024"):
        assert part in pushed
    # The minute to start from is found on three columns, and reaches the scan too.
    assert "GreaterThanOrEqual(timestamp,ScalarSubquery" in pushed
    assert "ReadSchema: struct<timestamp:timestamp_ntz,level:string,service:string>" in counted


def test_json_is_parsed_once(spark, sf_dir):
    plan = plan_of(QUERIES["alerts_by_service"](spark, sf_dir))
    assert plan.count("from_json(") == 1
    assert len(re.findall(r"lower\(", plan)) == 1


def test_top_n_is_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["top_anomalies_by_service"](spark, sf_dir))
    before = plan.split("Exchange hashpartitioning", 1)[1]
    assert "Partial" in before and "WindowGroupLimit" in before


def test_only_the_wanted_columns_are_read(spark, sf_dir):
    plan = plan_of(QUERIES["train_split"](spark, sf_dir))
    assert set(re.findall(r"ReadSchema: struct<(.*?)>", plan)) <= {"event_id:bigint,user_id:bigint,event_type:string", "event_id:bigint"}


def test_batch_sizes_are_counted_once(spark, sf_dir):
    """Two scans, the sizes and the rows, and one aggregation by batch for both verdicts."""
    df = QUERIES["batch_accept"](spark, sf_dir)
    df.collect()
    assert plan_of(df).split("== Initial Plan ==")[0].count("Scan parquet") <= 2
    # With batches that are too large both verdicts are needed.
    df = batches.accept_batches(records._batched(spark, sf_dir), most=50)
    found = {r.batch_id for r in df.collect()}
    assert found and "bulk" not in found
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1
