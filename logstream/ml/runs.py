"""Record of training runs, one row each."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import SparkSession

RUN = (
    "run_id STRING, model_type STRING, started TIMESTAMP, "
    "params MAP<STRING, STRING>, metrics MAP<STRING, DOUBLE>"
)


def record(
    spark: SparkSession,
    path: str,
    model_type: str,
    params: Mapping[str, object],
    metrics: Mapping[str, float],
) -> str:
    """Appends a run and returns its id."""
    run_id = uuid.uuid4().hex
    row = (
        run_id,
        model_type,
        datetime.now(timezone.utc),
        {name: str(value) for name, value in params.items()},
        {name: float(value) for name, value in metrics.items()},
    )
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(path)
    return run_id
