"""Clustering model for anomalies: training, distance scoring, storage."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream import model as fixed
from logstream.functions.rows import computed_once
from logstream.ml import runs
from logstream.operators.evaluate import confusion_matrix
from logstream.operators.features import feature_engineering
from logstream.operators.split import hash_split

# Rank error of the quantile behind the threshold.
QUANTILE_ERROR = 0.0005


def scaling_stages() -> list:
    """Vector of the features, then zero mean and unit deviation.

    A record with a missing feature is skipped.
    """
    return [
        VectorAssembler(
            inputCols=list(fixed.ANOMALY_FEATURES), outputCol="raw_features", handleInvalid="skip"
        ),
        StandardScaler(
            inputCol="raw_features", outputCol="features", withMean=True, withStd=True
        ),
    ]


def cluster_pipeline(k: int = 10, seed: int = 42) -> Pipeline:
    clusters = KMeans(
        k=k, seed=seed, maxIter=100, tol=1e-4, featuresCol="features", predictionCol="cluster"
    )
    return Pipeline(stages=[*scaling_stages(), clusters])


def model_input(df: DataFrame) -> DataFrame:
    """Features and the few columns that identify or label a record.

    The message text stays behind, which makes the frame small enough to keep.
    """
    passed = [c for c in ("timestamp", "service", "trace_id", "is_anomaly") if c in df.columns]
    return feature_engineering(df).select(*passed, *fixed.ANOMALY_FEATURES)


def distance_to_centre(model: PipelineModel) -> Column:
    """Euclidean distance of ``features`` to the centre of the row's own cluster.

    The k centres are literals, so there is neither a join nor Python per row.
    """
    centres = model.stages[-1].clusterCenters()
    points, cluster = vector_to_array(F.col("features")), F.col("cluster")
    total = F.lit(0.0)
    # One term per dimension, which Spark compiles; functions over arrays are interpreted for each row.
    for place in range(len(centres[0])):
        own = F.get(F.array(*[F.lit(float(centre[place])) for centre in centres]), cluster)
        gap = F.get(points, F.lit(place)) - own
        total = total + gap * gap
    return F.sqrt(total)


def assign_clusters(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Model input with ``cluster`` and ``distance``."""
    return model.transform(df).withColumn("distance", distance_to_centre(model))


def score_anomalies(df: DataFrame, model: PipelineModel, threshold: float) -> DataFrame:
    """Log records, batch or stream, with cluster, distance and the model's flag."""
    features = feature_engineering(df)
    made = [c for c in features.columns if c not in df.columns]
    # The assembler leaves out records by a filter, which would make the features a second time.
    rows = features.select(*[c for c in features.columns if c in df.columns], computed_once(F.struct(*made)))
    return (
        assign_clusters(rows, model)
        .withColumn("predicted_anomaly", F.col("distance") > F.lit(threshold))
        .drop("raw_features", "features")
    )


def cluster_sizes(scored: DataFrame) -> DataFrame:
    return scored.groupBy("cluster").agg(F.count("*").alias("rows"))


def silhouette(assigned: DataFrame) -> float:
    """Mean silhouette by squared Euclidean distance."""
    evaluator = ClusteringEvaluator(
        featuresCol="features",
        predictionCol="cluster",
        metricName="silhouette",
        distanceMeasure="squaredEuclidean",
    )
    return evaluator.evaluate(assigned)


def train_anomaly_model(
    df: DataFrame,
    k: int = 10,
    quantile: float = 0.95,
    path: str | None = None,
    runs_path: str | None = None,
    seed: int = 42,
) -> tuple[PipelineModel, float, dict[str, float]]:
    """(model, distance threshold, metrics) from log records.

    A record is anomalous if it lies farther from its centre than ``quantile``
    of the training records. With ``path`` the model is saved below it, with
    ``runs_path`` the run is recorded. An ``is_anomaly`` label adds the
    confusion metrics.
    """
    features = model_input(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = hash_split(features)
        model = cluster_pipeline(k, seed).fit(train)
        clusters = model.stages[-1].summary
        # Merges its summaries as a tree, where an aggregate would merge those
        # of all tasks in one.
        (threshold,) = assign_clusters(train, model).approxQuantile(
            "distance", [quantile], QUANTILE_ERROR
        )
        used = sum(clusters.clusterSizes)
        assigned = assign_clusters(test, model)
        metrics = {
            "training_records": float(used),
            "skipped_records": float(train.count() - used),
            "training_cost": float(clusters.trainingCost),
            "threshold": float(threshold),
            "silhouette_score": float(silhouette(assigned)),
        }
        if "is_anomaly" in features.columns:
            flagged = assigned.withColumn("predicted_anomaly", F.col("distance") > threshold)
            quality = confusion_matrix(flagged, "is_anomaly", "predicted_anomaly").first()
            metrics.update({name: float(value) for name, value in quality.asDict().items()})
    finally:
        features.unpersist()
    if path is not None:
        save_model(model, threshold, path)
    if runs_path is not None:
        features_used = ",".join(fixed.ANOMALY_FEATURES)
        params = {"k": k, "quantile": quantile, "seed": seed, "features": features_used}
        runs.record(df.sparkSession, runs_path, "kmeans_anomaly", params, metrics)
    return model, float(threshold), metrics


def save_model(
    model: PipelineModel, threshold: float, path: str, version: str | None = None
) -> str:
    """Saves below ``path`` under a version, by default the time; returns where."""
    version = version or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    target = f"{path.rstrip('/')}/{version}"
    model.write().overwrite().save(f"{target}/pipeline")
    spark = SparkSession.getActiveSession()
    limit = spark.createDataFrame([(float(threshold),)], "threshold DOUBLE")
    limit.write.mode("overwrite").parquet(f"{target}/threshold")
    return target


def load_model(spark: SparkSession, target: str) -> tuple[PipelineModel, float]:
    """(model, threshold) from where :func:`save_model` put them."""
    threshold = spark.read.parquet(f"{target}/threshold").first()["threshold"]
    return PipelineModel.load(f"{target}/pipeline"), threshold
