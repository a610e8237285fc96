"""Queries that fit and use models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream import model as fixed
from logstream.ml import anomaly, classify
from logstream.operators.features import feature_engineering
from logstream.operators.split import hash_split
from logstream.plans import fixture as fx
from logstream.plans.records import ALL_FEATURES_SQL
from logstream.plans.registry import query
from logstream.session import folders, scratch, stored


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logs(spark, sf_dir).withColumn("is_anomaly", F.expr(fx.LABEL))


def _metrics(spark: SparkSession, metrics: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(metrics.items()), "metric STRING, value DOUBLE")


_MOMENTS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, round(avg({name}), 6) AS mean, "
    f"round(stddev_samp({name}), 6) AS std FROM f"
    for name in fixed.ANOMALY_FEATURES
)


@query(f"""SELECT * FROM (WITH f AS (SELECT * FROM ({ALL_FEATURES_SQL})
    WHERE message_length IS NOT NULL) {_MOMENTS_SQL})""")
def feature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scaler learns: mean and deviation of every feature of a complete record."""
    rows = anomaly.model_input(fx.logs(spark, sf_dir))
    scaler = Pipeline(stages=anomaly.scaling_stages()).fit(rows).stages[-1]
    moments = zip(fixed.ANOMALY_FEATURES, scaler.mean.tolist(), scaler.std.tolist())
    learned = spark.createDataFrame(list(moments), "feature STRING, mean DOUBLE, std DOUBLE")
    return learned.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query()
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.model_input(fx.logs(spark, sf_dir))
    fitted = anomaly.cluster_pipeline().fit(rows)
    return anomaly.cluster_sizes(anomaly.assign_clusters(rows, fitted))


@query()
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records scored by a model trained on most of them."""
    logs = _labelled(spark, sf_dir)
    fitted, threshold, _ = anomaly.train_anomaly_model(logs)
    scored = anomaly.score_anomalies(logs, fitted, threshold)
    return scored.select("event_id", "cluster", "distance", "predicted_anomaly")


@query()
def anomaly_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, metrics = anomaly.train_anomaly_model(_labelled(spark, sf_dir))
    return _metrics(spark, metrics)


@query()
def level_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = classify.train_level_classifier(_labelled(spark, sf_dir))
    return _metrics(spark, metrics)


@query()
def level_classifier_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = classify.train_level_classifier(_labelled(spark, sf_dir), one_hot=True)
    return _metrics(spark, metrics)


@query()
def level_classifier_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a small grid by cross validation."""
    grid = {"numTrees": [5, 10], "maxDepth": [4]}
    _, metrics = classify.train_level_classifier(_labelled(spark, sf_dir), grid=grid)
    return _metrics(spark, metrics)


@query()
def anomaly_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for the anomaly label."""
    _, metrics = classify.train_level_classifier(_labelled(spark, sf_dir), estimator="gbt")
    return _metrics(spark, metrics)


# --- what must hold of any fitted model ----------------------------------------

COMPLETE_SQL = f"(SELECT f.*, trace_id, label FROM ({ALL_FEATURES_SQL}) f JOIN scored USING (event_id))"
_IN_TRAIN = "substr(md5(trace_id), 1, 2) < 'cd'"


@query(f"""SELECT CAST(count_if({_IN_TRAIN}) AS BIGINT) AS training_records,
    CAST(count_if({_IN_TRAIN}) AS BIGINT) AS clustered_records,
    0 AS nearer_to_another_centre, CAST(0 AS DOUBLE) AS cost_gap, CAST(0 AS DOUBLE) AS silhouette_gap,
    true AS a_twentieth_is_flagged, CAST(count_if(NOT {_IN_TRAIN}) AS BIGINT) AS tested_records,
    CAST(count_if(NOT {_IN_TRAIN} AND label) AS BIGINT) AS tested_positives, 0 AS changed_by_saving
FROM {COMPLETE_SQL} WHERE message_length IS NOT NULL""")
def anomaly_model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on a trained model: sizes, distances, cost, silhouette, threshold, saved form."""
    logs, path = _labelled(spark, sf_dir), scratch(spark, "model")
    fitted, threshold, metrics = anomaly.train_anomaly_model(logs, path=path)
    (version,) = folders(spark, path)
    again, limit = anomaly.load_model(spark, f"{path}/{version}")
    train, test = hash_split(anomaly.model_input(logs))
    assigned = anomaly.assign_clusters(train, fitted)
    nearest = F.array_min(F.transform(_centres(fitted), lambda centre: _squares(_vector(), centre)))
    squared = F.col("distance") * F.col("distance")
    measured = assigned.agg(
        F.count("*").alias("rows"),
        F.count_if(squared > nearest + 1e-9).cast("int").alias("nearer"),
        F.sum(squared).alias("cost"),
        F.avg((F.col("distance") > threshold).cast("double")).alias("flagged"),
    )
    sizes = anomaly.cluster_sizes(assigned).agg(F.sum("rows")).scalar()
    tested = anomaly.assign_clusters(test, fitted)
    silhouette_gap = metrics["silhouette_score"] - _silhouette(tested)
    mine = tested.select("trace_id", "distance")
    theirs = anomaly.assign_clusters(test, again).select("trace_id", "distance")
    changed = mine.exceptAll(theirs).agg(F.count("*").cast("int") + int(limit != threshold)).scalar()
    counted = sum(metrics[name] for name in ("tp", "fp", "fn", "tn"))
    cost = metrics["training_cost"]
    return measured.select(
        F.col("rows").alias("training_records"),
        sizes.alias("clustered_records"),
        F.col("nearer").alias("nearer_to_another_centre"),
        (F.abs(F.round((F.col("cost") - cost) / cost, 6))).alias("cost_gap"),
        F.lit(abs(round(silhouette_gap, 6))).alias("silhouette_gap"),
        F.col("flagged").between(0.04, 0.06).alias("a_twentieth_is_flagged"),
        F.lit(int(counted)).cast("bigint").alias("tested_records"),
        F.lit(int(metrics["tp"] + metrics["fn"])).cast("bigint").alias("tested_positives"),
        changed.alias("changed_by_saving"),
    )


def _vector():
    return vector_to_array(F.col("features"))


def _centres(fitted):
    rows = fitted.stages[-1].clusterCenters()
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])


def _dot(a, b):
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _squares(a, b):
    return _dot(F.zip_with(a, b, lambda x, y: x - y), F.zip_with(a, b, lambda x, y: x - y))


def _silhouette(assigned: DataFrame) -> float:
    """Mean silhouette by squared distance, from one row of sums per cluster.

    The mean squared distance of x to a cluster is |x|^2 less twice x times its mean,
    plus its mean |y|^2.
    """
    width = len(fixed.ANOMALY_FEATURES)
    sums = (
        assigned.select("cluster", _vector().alias("x"))
        .groupBy("cluster")
        .agg(
            F.count("*").cast("double").alias("n"),
            F.avg(_dot(F.col("x"), F.col("x"))).alias("square"),
            F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"),
        )
    )
    # One row per cluster, k in all.
    clusters = F.array(
        *[
            F.struct(
                F.lit(r.cluster).alias("cluster"),
                F.lit(r.n).alias("n"),
                F.lit(r.square).alias("square"),
                F.array(*map(F.lit, r.mean)).alias("mean"),
            )
            for r in sums.collect()
        ]
    )
    x = _vector()

    def away(c):
        return _dot(x, x) - 2 * _dot(x, c["mean"]) + c["square"]

    own = F.filter(clusters, lambda c: c["cluster"] == F.col("cluster"))[0]
    inside = away(own) * own["n"] / (own["n"] - 1)
    outside = F.array_min(
        F.transform(F.filter(clusters, lambda c: c["cluster"] != F.col("cluster")), away)
    )
    score = F.when(own["n"] > 1, (outside - inside) / F.greatest(inside, outside)).otherwise(0.0)
    return assigned.agg(F.avg(score)).first()[0]


_LEVELS_SQL = f"""SELECT '{{model}}' AS model, {{label}} AS label, count(*) AS "rows",
    CAST(0 AS DOUBLE) AS accuracy_gap FROM (SELECT c.*, l.level FROM {COMPLETE_SQL} c JOIN logs l USING (event_id))
WHERE message_length IS NOT NULL AND NOT {_IN_TRAIN} AND {{known}} GROUP BY 1, 2"""
_OF_LEVEL = {"label": "level", "known": "level IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL')"}
_OF_FLAG = {"label": "CASE WHEN label THEN 'true' ELSE 'false' END", "known": "true"}


@query(
    " UNION ALL ".join(
        _LEVELS_SQL.format(model=name, **kind)
        for name, kind in (
            ("forest", _OF_LEVEL), ("one_hot", _OF_LEVEL), ("tuned", _OF_LEVEL), ("boosted", _OF_FLAG),
        )
    )
)
def classifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and true label: how many tested records got a prediction, and by how much the
    reported accuracy differs from that of the predictions."""
    kept = ("trace_id", "level", "is_anomaly", *fixed.CLASSIFIER_FEATURES)
    # The features are made once, for all models and for their predictions.
    logs = stored(feature_engineering(_labelled(spark, sf_dir)).select(*kept), "features")
    options = {
        "forest": {},
        "one_hot": {"one_hot": True},
        "tuned": {"grid": {"numTrees": [3, 5], "maxDepth": [4]}},
        "boosted": {"estimator": "gbt"},
    }
    found = []
    for name, chosen in options.items():
        fitted, metrics = classify.train_level_classifier(logs, **chosen)
        boosted = name == "boosted"
        known = F.lit(True) if boosted else F.col("level").isin(*fixed.LEVEL_CODES)
        rows = logs.where(known)
        _, test = hash_split(rows.withColumn("label", F.col("is_anomaly").cast("double")) if boosted else rows)
        predicted = fitted.transform(test)
        right = (F.col("prediction") == F.col("label")).cast("double")
        shown = F.col("is_anomaly").cast("string") if boosted else F.col("level")
        # A row per true label, of which there are five at most.
        labels = predicted.groupBy(shown.alias("label")).agg(
            F.count("*").alias("rows"), F.sum(right).alias("right"), F.count(right).alias("judged")
        )
        counted = labels.collect()
        accuracy = sum(r.right or 0 for r in counted) / sum(r.judged for r in counted)
        gap = abs(round(accuracy - metrics["accuracy"], 9))
        found += [(name, r.label, r.rows, gap) for r in counted]
    return spark.createDataFrame(found, "model STRING, label STRING, rows BIGINT, accuracy_gap DOUBLE")
