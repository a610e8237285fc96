"""Models: invariants rather than values, since fits depend on partitioning."""

import math

import pytest
from pyspark.sql import functions as F

from logstream import model as fixed
from logstream.ml import anomaly, classify, runs
from logstream.operators.split import hash_split
from logstream.plans import fixture
from logstream.sources import streams
from logstream.operators.parse import drop_incomplete, parse_logs
from logstream.streaming import sinks


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    logs = fixture.logs(spark, sf_dir)
    return logs.withColumn("is_anomaly", F.expr(fixture.LABEL)).cache()


@pytest.fixture(scope="module")
def trained(spark, labelled, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("model"))
    result = anomaly.train_anomaly_model(labelled, k=5, path=f"{folder}/m", runs_path=f"{folder}/runs")
    return (*result, folder)


def test_metrics(spark, labelled, trained):
    _, threshold, metrics, _ = trained
    train, test = hash_split(labelled)
    incomplete = train.where("message IS NULL").count()
    assert metrics["skipped_records"] == incomplete > 0
    assert metrics["training_records"] == train.count() - incomplete
    assert metrics["threshold"] == threshold > 0
    assert -1 <= metrics["silhouette_score"] <= 1
    counted = sum(metrics[c] for c in ("tp", "fp", "fn", "tn"))
    assert counted == test.where("message IS NOT NULL").count()
    positives = test.where("message IS NOT NULL AND is_anomaly").count()
    assert metrics["anomaly_rate"] == pytest.approx(positives / counted)


def test_distance_is_to_the_own_centre(spark, labelled, trained):
    fitted, threshold, metrics, _ = trained
    train, _ = hash_split(anomaly.model_input(labelled))
    assigned = anomaly.assign_clusters(train, fitted)
    total = assigned.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    assert total == pytest.approx(metrics["training_cost"], rel=1e-6)
    centres = fitted.stages[-1].clusterCenters()
    for row in assigned.select("features", "cluster", "distance").limit(20).collect():
        vector = row.features.toArray()
        assert row.distance == pytest.approx(math.dist(vector, centres[row.cluster]), rel=1e-9)
        assert row.distance <= min(math.dist(vector, c) for c in centres) + 1e-9
    flagged = assigned.where(F.col("distance") > threshold).count() / assigned.count()
    assert flagged <= 0.06


def test_saved_model_scores_the_same(spark, labelled, trained, tmp_path):
    fitted, threshold, _, _ = trained
    target = anomaly.save_model(fitted, threshold, str(tmp_path / "m"), version="one")
    assert anomaly.save_model(fitted, threshold, str(tmp_path / "m"), version="one") == target
    again, same = anomaly.load_model(spark, target)
    wanted = ("event_id", "cluster", "distance", "predicted_anomaly")
    before = anomaly.score_anomalies(labelled, fitted, threshold).select(*wanted)
    after = anomaly.score_anomalies(labelled, again, same).select(*wanted)
    assert same == threshold and before.exceptAll(after).count() == 0
    assert before.count() == labelled.where("message IS NOT NULL").count()
    sizes = {r.cluster: r.rows for r in anomaly.cluster_sizes(before).collect()}
    assert sum(sizes.values()) == before.count() and len(sizes) <= 5


def test_scoring_makes_features_once(spark, labelled, trained):
    """No filter of the assembler repeats the work on the message; distances are compiled."""
    fitted, threshold, _, _ = trained
    spark.catalog.clearCache()
    plan = anomaly.score_anomalies(labelled, fitted, threshold)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("message#" in line for line in filters)
    assert "lambdafunction" not in plan.split("distance#")[0] and "zip_with" not in plan


def test_features_that_are_there_are_kept(spark, labelled):
    from logstream.operators.features import feature_engineering

    made = feature_engineering(labelled).select("trace_id", "level", "is_anomaly", *fixed.CLASSIFIER_FEATURES)
    _, metrics = classify.train_level_classifier(made, estimator="gbt")
    assert metrics == classify.train_level_classifier(labelled, estimator="gbt")[1]


def test_a_stream_is_scored(spark, sf_dir, trained, tmp_path):
    fitted, threshold, _, _ = trained
    topic = str(tmp_path / "topic")
    fixture.envelope(spark, sf_dir).write.parquet(topic)
    logs = drop_incomplete(parse_logs(streams.read_log_stream(spark, "parquet", topic)))
    scored = anomaly.score_anomalies(logs, fitted, threshold)
    sink = sinks.Sink("parquet", str(tmp_path / "scored"))
    sinks.write_stream(scored, sink, str(tmp_path / "c"), trigger=sinks.ONCE).awaitTermination()
    batch = drop_incomplete(parse_logs(spark.read.parquet(topic)))
    expected = anomaly.score_anomalies(batch, fitted, threshold).select("trace_id", "cluster")
    found = spark.read.parquet(sink.location).select("trace_id", "cluster")
    assert found.exceptAll(expected).count() == 0 and found.count() == expected.count()


def test_unlabelled_records_train_too(spark, labelled):
    _, _, metrics = anomaly.train_anomaly_model(labelled.drop("is_anomaly"), k=3)
    assert "tp" not in metrics and metrics["training_records"] > 0


def test_runs_table(spark, trained):
    *_, metrics, folder = trained
    runs.record(spark, f"{folder}/runs", "other", {"a": 1}, {"b": 2})
    rows = {r.model_type: r for r in spark.read.parquet(f"{folder}/runs").collect()}
    assert rows["kmeans_anomaly"].metrics == metrics
    assert rows["kmeans_anomaly"].params["k"] == "5"
    assert rows["other"].metrics == {"b": 2.0}


@pytest.mark.parametrize(
    "options",
    [{}, {"one_hot": True}, {"grid": {"numTrees": [3], "maxDepth": [2, 3]}}, {"estimator": "gbt"}],
)
def test_classifiers(spark, labelled, tmp_path, options):
    path = str(tmp_path / "runs")
    fitted, metrics = classify.train_level_classifier(labelled, runs_path=path, **options)
    assert set(metrics) == {"accuracy", "precision", "recall", "f1_score"}
    assert all(0 <= value <= 1 for value in metrics.values())
    assert spark.read.parquet(path).count() == 1
    assert "level_numeric" not in fixed.CLASSIFIER_FEATURES
    assert fitted.stages


def test_unknown_estimator(labelled):
    with pytest.raises(ValueError):
        classify.train_level_classifier(labelled, estimator="forest")
