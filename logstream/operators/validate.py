"""Checks and defaults of an incoming record."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstream import model
from logstream.functions.clock import utc
from logstream.functions.ids import log_id


def _required(text: Column, most: int) -> Column:
    return F.coalesce(F.length(text).between(1, most), F.lit(False))


def _optional(text: Column, most: int) -> Column:
    return F.coalesce(F.length(text) <= most, F.lit(True))


def checks(field: Callable[[str], Column] = F.col, as_sent: bool = False) -> dict[str, Column]:
    """Name of each rule and the condition a good record meets; never NULL.

    ``field`` gives the column of a name, so that the same rules serve rows and
    elements of an array. ``as_sent`` says that there is a ``timestamp_text``: a time that was
    sent must be one.
    """
    sent = field("timestamp_text").isNull() | field("timestamp").isNotNull() if as_sent else None
    return {
        **({"timestamp": sent} if as_sent else {}),
        "level": F.coalesce(field("level").isin(*model.LEVEL_CODES), F.lit(False)),
        "message": _required(field("message"), model.MAX_MESSAGE),
        "service": _required(field("service"), model.MAX_NAME),
        "host": _optional(field("host"), model.MAX_NAME),
        "environment": _optional(field("environment"), model.MAX_ENVIRONMENT),
        "trace_id": _optional(field("trace_id"), model.MAX_NAME),
        "span_id": _optional(field("span_id"), model.MAX_NAME),
    }


def is_valid(field: Callable[[str], Column] = F.col, as_sent: bool = False) -> Column:
    return reduce(and_, checks(field, as_sent).values())


def failed_checks(as_sent: bool = False) -> Column:
    """Names of the rules a record breaks."""
    return F.filter(
        F.array(*[F.when(~good, F.lit(name)) for name, good in checks(F.col, as_sent).items()]),
        lambda name: name.isNotNull(),
    )


def _as_sent(df: DataFrame) -> bool:
    return "timestamp_text" in df.columns


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, quarantined records with ``reasons``).

    Records with their ``timestamp_text`` (see ``parse_submitted``) are also tested for a time
    that cannot be read.
    """
    good = is_valid(as_sent=_as_sent(df))
    return df.where(good), df.where(~good).withColumn("reasons", failed_checks(_as_sent(df)))


def apply_defaults(df: DataFrame, ingest_ts: Column | datetime | None = None) -> DataFrame:
    """Missing time and environment filled in, and a ``log_id`` for the answer.

    ``ingest_ts`` defaults to the time of the run or micro-batch. With ``environment_sent``
    (see ``parse_submitted``) an environment that was sent as null stays so.
    """
    if ingest_ts is None:
        now = F.current_timestamp()
    else:
        now = utc(ingest_ts)
    environment = F.coalesce("environment", F.lit(model.DEFAULT_ENVIRONMENT))
    if "environment_sent" in df.columns:
        environment = F.when(F.col("environment_sent"), F.col("environment")).otherwise(environment)
    filled = df.withColumns(
        {
            "timestamp": F.coalesce("timestamp", now.cast(df.schema["timestamp"].dataType)),
            "environment": environment,
        }
    )
    return filled.withColumn(
        "log_id",
        log_id(F.col("trace_id"), F.col("timestamp"), F.col("service"), F.col("message")),
    )
