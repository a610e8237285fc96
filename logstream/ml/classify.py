"""Classifiers over the log features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream import model as fixed
from logstream.ml import runs
from logstream.operators.features import feature_engineering
from logstream.operators.split import hash_split

QUALITY = {
    "accuracy": "accuracy",
    "precision": "weightedPrecision",
    "recall": "weightedRecall",
    "f1_score": "f1",
}


def _evaluator(metric: str) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(
        labelCol="label", predictionCol="prediction", metricName=metric
    )


def _quality(predicted: DataFrame) -> dict[str, float]:
    kept = predicted.select("label", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {name: _evaluator(metric).evaluate(kept) for name, metric in QUALITY.items()}
    finally:
        kept.unpersist()


def _feature_stages(one_hot: bool) -> list:
    """Assembles the features; ``one_hot`` turns the service code into indicator columns."""
    if not one_hot:
        columns = list(fixed.CLASSIFIER_FEATURES)
        return [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")]
    columns = [c for c in fixed.CLASSIFIER_FEATURES if c != "service_encoded"]
    return [
        OneHotEncoder(
            inputCols=["service_encoded"], outputCols=["service_vector"], handleInvalid="keep"
        ),
        VectorAssembler(
            inputCols=[*columns, "service_vector"], outputCol="features", handleInvalid="skip"
        ),
    ]


def _fit(
    pipeline: Pipeline, train: DataFrame, classifier, grid: Mapping[str, Sequence] | None, seed: int
):
    """Plain fit, or the best of a grid by 3-fold cross validation."""
    if not grid:
        return pipeline.fit(train)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), list(values))
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=_evaluator("f1"),
        numFolds=3,
        seed=seed,
    )
    return search.fit(train).bestModel


def train_level_classifier(
    df: DataFrame,
    estimator: str = "rf",
    grid: Mapping[str, Sequence] | None = None,
    one_hot: bool = False,
    runs_path: str | None = None,
    seed: int = 42,
) -> tuple[PipelineModel, dict[str, float]]:
    """(model, metrics) that tells the level of a record from its other features.

    ``rf`` is a random forest over all levels. ``gbt`` knows two classes, and
    tells the ``is_anomaly`` label instead. ``grid`` names estimator parameters
    and the values to try. Records without a label are left out; a level outside
    the accepted five is none, which also bounds what the label index holds. A
    table that already holds all features keeps its own, for several trainings.
    """
    if estimator == "rf":
        target, label = "level", F.col("level")
        known = label.isin(*fixed.LEVEL_CODES)
        index = StringIndexer(
            inputCol="level", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"
        )
        label_stages = [index]
        classifier = RandomForestClassifier(labelCol="label", featuresCol="features", seed=seed)
    elif estimator == "gbt":
        target, label = "is_anomaly", F.col("is_anomaly").cast("double").alias("label")
        known = F.col("is_anomaly").isNotNull()
        label_stages = []
        classifier = GBTClassifier(labelCol="label", featuresCol="features", seed=seed, maxIter=10)
    else:
        raise ValueError(f"unknown estimator {estimator!r}: rf or gbt")
    rows = df.where(known)
    features = (
        (rows if set(fixed.CLASSIFIER_FEATURES) <= set(df.columns) else feature_engineering(rows))
        .select("trace_id", label, *fixed.CLASSIFIER_FEATURES)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        train, test = hash_split(features)
        pipeline = Pipeline(stages=[*label_stages, *_feature_stages(one_hot), classifier])
        model = _fit(pipeline, train, classifier, grid, seed)
        metrics = _quality(model.transform(test))
        if runs_path is not None:
            params = {"estimator": estimator, "one_hot": one_hot, "grid": grid, "seed": seed}
            runs.record(df.sparkSession, runs_path, f"{target}_{estimator}", params, metrics)
    finally:
        features.unpersist()
    return model, metrics
