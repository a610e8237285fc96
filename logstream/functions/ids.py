"""Identifiers that come out the same on every replay of the same input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logstream.functions.clock import stamp


def digest(*parts: Column) -> Column:
    """md5 over the parts, each with its length: other parts never make the same text.

    NULL is a part of its own, apart from empty text.
    """
    texts = [part.cast("string") for part in parts]
    told = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.md5(F.concat_ws("|", *[F.coalesce(t, F.lit("-")) for t in told]))


def alert_id(ts: Column, *parts: Column) -> Column:
    """``alert_<time of the log>_<digest>``."""
    return F.concat_ws("_", F.lit("alert"), stamp(ts), digest(*parts))


def log_id(trace_id: Column, ts: Column, service: Column, message: Column) -> Column:
    """The trace id, or ``log_<digest>`` where it is missing or empty."""
    own = F.concat(
        F.lit("log_"), digest(F.date_format(ts, "yyyyMMddHHmmssSSSSSS"), service, message)
    )
    return F.coalesce(F.nullif(trace_id, F.lit("")), own)
