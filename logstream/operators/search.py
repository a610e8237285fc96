"""Point queries: search, recent records, the live feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logstream import model
from logstream.functions import ids
from logstream.functions.clock import stamp, truncated, utc, utc_day
from logstream.functions.rows import free_name
from logstream.operators.alerts import description
from logstream.operators.stats import as_of_time, is_flagged
from logstream.session import stored
from logstream.sources.lake import lake_days, lake_schema, read_lake


def _newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.asc("trace_id")]


def check_limit(limit: int, most: int = model.MAX_SEARCH) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1..{most}, not {limit}")
    return limit


def matching(
    df: DataFrame,
    service: str | None = None,
    level: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Rows that pass every given filter; ``start`` is included, ``end`` is not.

    Plain comparisons only, so all of them reach the Parquet scan.
    """
    if service:
        df = df.where(F.col("service") == service)
    if level:
        df = df.where(F.col("level") == level)
    if start is not None:
        df = df.where(F.col("timestamp") >= utc(start).cast(df.schema["timestamp"].dataType))
    if end is not None:
        df = df.where(F.col("timestamp") < utc(end).cast(df.schema["timestamp"].dataType))
    return df


def _reached(counts: DataFrame, unit: str, limit: int, otherwise: Column | None = None) -> Column:
    """The latest ``unit`` from which on there are ``limit`` rows, else ``otherwise`` or NULL.

    A plain scalar subquery, so that a comparison with it reaches the scan.

    ``counts`` has a row per unit and merges map-side; they are added up as one sorted list.
    """
    newest_first = F.sort_array(F.collect_list(F.struct(unit, "n")), asc=False)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(counts.schema[unit].dataType).alias("at"))

    def step(state: Column, one: Column) -> Column:
        seen = state["seen"] + one["n"]
        crossed = state["at"].isNull() & (seen >= limit)
        return F.struct(seen.alias("seen"), F.when(crossed, one[unit]).otherwise(state["at"]).alias("at"))

    at = F.aggregate(newest_first, start, step)["at"]
    return counts.agg((at if otherwise is None else F.coalesce(at, otherwise)).alias("at")).scalar()


def newest(df: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` newest rows, newest first; ``ties`` order rows after the trace id.

    Rows are counted per hour, and only those from the hour on that completes the limit are read whole
    and sorted: a plain top-k would send ``limit`` rows of every task of the scan to one task. Rows
    without a time come last, where the limit is not reached. See :func:`search_lake` for the lake.
    """
    beginning = F.lit("0001-01-01 00:00:00").cast(df.schema["timestamp"].dataType)
    hours = df.groupBy(truncated(df, "hour").alias("unit")).agg(F.count("*").alias("n"))
    bound = _reached(hours.where("unit IS NOT NULL"), "unit", limit, beginning)
    from_then = df.where(F.col("timestamp") >= bound)
    timeless = df.where(F.col("timestamp").isNull() & (bound == beginning))
    return from_then.union(timeless).orderBy(*_newest_first(), *ties).limit(limit)


def search_logs(df: DataFrame, limit: int = 100, **filters) -> DataFrame:
    """The newest ``limit`` matches."""
    return newest(matching(df, **filters), check_limit(limit))


def search_lake(spark: SparkSession, root: str, limit: int = 100, **filters) -> DataFrame:
    """The newest ``limit`` matches of the lake at ``root``.

    Days are taken from the folder names, newest first, one, then two, then four more, until they hold
    the limit: older files are never opened.
    """
    check_limit(limit)
    start, end = (filters.get(name) for name in ("start", "end"))
    days = [
        day
        for day in reversed(lake_days(spark, root))
        if (start is None or day >= utc_day(start)) and (end is None or day <= utc_day(end))
    ]
    schema = lake_schema(spark, root, days[0]) if days else None
    found, taken, step = 0, 0, 1
    while found < limit and taken < len(days):
        more = days[taken : taken + step]
        part = matching(read_lake(spark, root, more[-1], more[0], schema), **filters)
        found += part.limit(limit).count()
        taken, step = taken + len(more), step * 2
    if found >= limit:
        rows = read_lake(spark, root, days[taken - 1], days[0], schema)
    else:
        # Too few: rows that lie in no day, having no time, may count.
        rows = spark.read.parquet(root)
    return newest(matching(rows, **filters), limit)


def search_summary(df: DataFrame, **filters) -> DataFrame:
    """One row: how many records match, and the filters that were applied."""
    applied = {
        name: F.lit(None if filters.get(name) is None else str(filters[name])).cast("string")
        for name in ("service", "level", "start", "end")
    }
    return matching(df, **filters).agg(F.count("*").alias("total_count")).select(
        "total_count", F.struct(*[c.alias(n) for n, c in applied.items()]).alias("filters_applied")
    )


def anomaly_groups(df: DataFrame) -> DataFrame:
    """Anomalies per service, severity and hour.

    The description is that of the newest anomaly in the group. Hosts are
    counted exactly in a table and approximately in a stream, where Spark has no
    distinct counts.
    """
    if df.isStreaming:
        hosts = F.approx_count_distinct("host")
    else:
        hosts = F.countDistinct("host")
    latest = F.max(F.struct("timestamp", "trace_id", description().alias("description")))
    grouped = (
        df.where("is_anomaly")
        .groupBy("service", "severity", truncated(df, "hour").alias("hour"))
        .agg(
            latest.alias("latest"),
            F.max("anomaly_score").alias("score"),
            hosts.alias("affected_hosts"),
        )
    )
    return anomaly_rows(grouped)


def anomaly_rows(grouped: DataFrame) -> DataFrame:
    """Groups of service, severity and hour as rows with an id, in the shape of an anomaly."""
    anomaly_id = ids.digest(F.col("service"), F.col("severity"), stamp(F.col("hour")))
    return grouped.select(
        F.concat(F.lit("anom_"), anomaly_id).alias("id"),
        F.col("latest.timestamp").alias("timestamp"),
        "service",
        "severity",
        "score",
        F.col("latest.description").alias("description"),
        "affected_hosts",
    )


def recent_anomalies(df: DataFrame, limit: int = 50) -> DataFrame:
    """The groups of anomalies with the latest records.

    The groups are found on fixed-width columns; only the anomalies of those are then
    read with their texts and hosts.
    """
    check_limit(limit)
    key = ("service", "severity", "hour")
    flagged = df.where("is_anomaly").withColumn("hour", truncated(df, "hour"))
    latest = (
        flagged.groupBy(*key)
        .agg(F.max("timestamp").alias("last"))
        .orderBy(F.desc("last"), "service", "severity")
        .limit(limit)
    )
    # At most ``limit`` rows, which check_limit bounds.
    wanted = F.broadcast(latest.select(*[F.col(c).alias(f"wanted_{c}") for c in key]))
    on = F.expr(" AND ".join(f"{c} <=> wanted_{c}" for c in key))
    found = anomaly_groups(flagged.join(wanted, on, "left_semi").drop("hour"))
    return found.orderBy(F.desc("timestamp"), "service", "severity")


def live_feed(
    processed: DataFrame,
    alerts: DataFrame,
    level: str | None = None,
    service: str | None = None,
    limit: int | None = 1000,
) -> DataFrame:
    """Records and alerts as one feed, newest first.

    Either shape may lack columns of the other. Without a ``limit`` the whole
    feed is returned, in no order.
    """
    both = processed.unionByName(alerts, allowMissingColumns=True)
    times = [c for c in ("timestamp", "log_timestamp", "detection_timestamp") if c in both.columns]
    texts = [c for c in ("message", "description") if c in both.columns]
    feed = both.select(
        F.coalesce(*times).alias("timestamp"),
        "level",
        "service",
        F.coalesce(*texts).alias("text"),
        "severity",
        "anomaly_score",
        "host",
        "trace_id",
        is_flagged(both).alias("flagged"),
        F.coalesce(F.col("alert_id"), F.lit("")).alias("alert_id"),
    )
    feed = matching(feed, service=service, level=level)
    if limit is None:
        return feed
    return newest(feed, limit, "alert_id")


# Parts of a group that are cut to their first rows apart from each other.
GROUP_PARTS = 32


def newest_per_group(df: DataFrame, group: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each group, with their ``position``.

    Each group is cut in GROUP_PARTS parts, by the rows' own hash, before its parts meet, so
    that a group which holds a third of the table does not meet in one task.
    """
    if n < 1:
        raise ValueError(f"n must be 1 or more, not {n}")
    name, place = free_name(df, "_part"), free_name(df, "_place")
    part = F.pmod(F.xxhash64("timestamp", "trace_id", "message"), F.lit(GROUP_PARTS))
    in_part = W.partitionBy(*group, name).orderBy(*_newest_first())
    in_group = W.partitionBy(*group).orderBy(*_newest_first())
    return (
        df.withColumn(name, part)
        .withColumn(place, F.row_number().over(in_part))
        .where(F.col(place) <= n)
        .withColumn(place, F.row_number().over(in_group))
        .where(F.col(place) <= n)
        .select(*[c for c in df.columns if c != "position"], F.col(place).alias("position"))
    )


def top_anomalies(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest anomalies of each service."""
    return newest_per_group(df.where("is_anomaly"), ["service"], n)


def numbered_per_group(df: DataFrame, group: list[str]) -> DataFrame:
    """All rows with their ``position`` in their group, newest first.

    Rows are numbered in the parts of a stored range sort, and a group's position goes on from
    part to part, so that a busy group is spread over many tasks.
    """
    order = [*map(F.asc, group), *_newest_first()]
    part, row, n, first, before = (free_name(df, f"_{c}") for c in ("part", "row", "n", "first", "before"))
    rows = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(row, F.monotonically_increasing_id()),
        "positions",
    )
    ahead = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = (
        rows.groupBy(*group, part)
        .agg(F.count("*").alias(n), F.min(row).alias(first))
        .withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0)))
        .alias("parts")
    )
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"parts.{c}")) for c in (*group, part)]
    position = F.col(row) - F.col(first) + F.col(before) + 1
    kept = [F.col(f"rows.{c}") for c in df.columns if c != "position"]
    return rows.alias("rows").join(parts, same).select(*kept, position.alias("position"))


def recent_by_service_minute(
    df: DataFrame,
    as_of: Column | datetime | None = None,
    ttl: str = "1 hour",
    positions: bool = False,
) -> DataFrame:
    """Records younger than ``ttl``, listed per service and minute, newest first; no list is cut.

    The list order is a range sort that ends in the trace id, so one busy service and minute is spread
    over many tasks. With ``positions`` each record carries its place in its list.
    """
    now = as_of_time(df, as_of)
    ts = F.col("timestamp")
    recent = df.where((ts > now - F.expr(f"INTERVAL {ttl}")) & (ts <= now)).withColumn(
        "minute_start", truncated(df, "minute")
    )
    if positions:
        return numbered_per_group(recent, ["service", "minute_start"]).orderBy(
            "service", "minute_start", "position"
        )
    return recent.orderBy("service", "minute_start", *_newest_first())
