"""Rows at hand to a frame with a declared schema; for tests and small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from logstream import model


def from_rows(
    spark: SparkSession, rows: Sequence[tuple], schema: T.StructType = model.TRAINING
) -> DataFrame:
    return spark.createDataFrame(rows, schema)
