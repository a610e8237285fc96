"""Messages that a producer has sent again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstream.functions.rows import free_name

# How long after its first arrival a message may come again: well beyond what retries take.
WITHIN = "10 minutes"
_PLACE = ("topic", "partition", "offset")


def value_key(df: DataFrame, value: str = "value") -> Column:
    """What tells messages of an envelope apart: a digest of key and value, 32 characters in the state.

    A resent message is equal byte for byte. A message without a value is known by its place.
    """
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _PLACE if c in df.columns]
    sent = F.concat_ws(
        "|", *[F.coalesce(F.md5(F.col(c)), F.lit("-")) for c in ("key", value) if c in df.columns]
    )
    return F.when(F.col(value).isNull(), F.concat_ws("-", F.lit("at"), *place)).otherwise(F.md5(sent))


def without_repeats(
    df: DataFrame,
    by: Column | None = None,
    arrived: str = "timestamp",
    within: str = WITHIN,
) -> DataFrame:
    """Each message once: the first that arrived.

    On a stream the keys of the last ``within`` of arrival time are kept as state and expire with it, so
    the state is bounded by the traffic of that time; it is part of the checkpoint and survives a restart.
    Arrival times grow with the topic, so that a record whose event time is old is not taken for late. On
    a table all repeats are found, however far apart. ``by`` is the key, else that of :func:`value_key`;
    a NULL key is a message of its own on a table, and one key on a stream.
    """
    key = free_name(df, "_sent_key")
    keyed = df.withColumn(key, value_key(df) if by is None else by)
    if df.isStreaming:
        return keyed.withWatermark(arrived, within).dropDuplicatesWithinWatermark([key]).drop(key)
    first = F.struct(arrived, *[c for c in _PLACE if c in df.columns and c != arrived])
    row = F.struct(*[F.col(c) for c in df.columns])
    once = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, first).alias("row"))
    return once.select("row.*").union(keyed.where(F.col(key).isNull()).drop(key))
