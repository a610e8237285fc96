"""Columns computed from an event time, in the session time zone (UTC)."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of the named parts of a day and week.
WEEKEND = (1, 7)  # 1 is Sunday
BUSINESS_HOURS = (9, 17)
NIGHT_FROM, NIGHT_TO = 22, 6


def utc(moment: Column | datetime | date) -> Column:
    """A given time as a column; a plain datetime means UTC, whatever the machine's zone."""
    if isinstance(moment, datetime) and moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment if isinstance(moment, Column) else F.lit(moment)


def utc_day(moment: datetime) -> date:
    """The day of a given time; a plain datetime means UTC."""
    return moment.date() if moment.tzinfo is None else moment.astimezone(timezone.utc).date()


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def is_weekend(ts: Column) -> Column:
    return _one_if(F.dayofweek(ts).isin(*WEEKEND))


def is_business_hours(ts: Column) -> Column:
    return _one_if(F.hour(ts).between(*BUSINESS_HOURS))


def is_night_time(ts: Column) -> Column:
    """22 to 6, both included. The detector's early hours are a narrower span."""
    hour = F.hour(ts)
    return _one_if((hour >= NIGHT_FROM) | (hour <= NIGHT_TO))


def stamp(ts: Column) -> Column:
    """The event time as yyyyMMddHHmmss."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def truncated(df: DataFrame, unit: str, name: str = "timestamp") -> Column:
    """Start of the unit of time, in the type of the time column."""
    return F.date_trunc(unit, name).cast(df.schema[name].dataType)
