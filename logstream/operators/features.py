"""Numeric features of a log record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstream import model
from logstream.functions import clock, codes, text


def _measures(df: DataFrame) -> dict[str, Column]:
    """Message measures; a table that already holds them keeps its own."""
    message = F.col("message")
    measures = {"message_length": F.length(message), "word_count": text.space_pieces(message)}
    return {name: column for name, column in measures.items() if name not in df.columns}


# The lower-cased message, made once for all word tests of a row.
LOWERED = "lower_message"


def _word_flags(**words: tuple[str, ...]) -> dict[str, Column]:
    lowered = F.col(LOWERED)
    return {name: text.flag(text.holds(lowered, found)) for name, found in words.items()}


def lowered_stream_features(df: DataFrame) -> DataFrame:
    """The stream features together with the lower-cased message."""
    ts = F.col("timestamp")
    return df.withColumn(LOWERED, F.lower("message")).withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.dayofweek(ts),
            **_measures(df),
            "level_numeric": codes.level_code(F.col("level")),
            **_word_flags(
                has_exception=("exception",), has_timeout=("timeout",), has_failed=("failed",)
            ),
        }
    )


def add_stream_features(df: DataFrame) -> DataFrame:
    """What the rule detector needs."""
    return lowered_stream_features(df).drop(LOWERED)


def feature_engineering(df: DataFrame) -> DataFrame:
    """The whole feature set, ready for model training."""
    ts = F.col("timestamp")
    return (
        lowered_stream_features(df)
        .withColumns(
            {
                "minute": F.minute(ts),
                "is_weekend": clock.is_weekend(ts),
                "is_business_hours": clock.is_business_hours(ts),
                "is_night_time": clock.is_night_time(ts),
                **_word_flags(
                    has_error_keywords=model.ERROR_WORDS,
                    has_performance_keywords=model.PERFORMANCE_WORDS,
                ),
                "message_entropy": text.length_weighted_entropy(
                    F.col("word_count"), F.col("message_length")
                ),
                "service_encoded": codes.service_code(F.col("service")),
                "environment_encoded": codes.environment_code(F.col("environment")),
            }
        )
        .drop(LOWERED)
    )
