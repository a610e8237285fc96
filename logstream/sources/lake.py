"""The date-partitioned Parquet lake."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logstream.session import folders

DAY_PARTS = ("year", "month", "day")


def with_day_parts(df: DataFrame) -> DataFrame:
    """Adds ``year``, and ``month`` and ``day`` with two digits, from the event time."""
    ts = F.col("timestamp")
    return df.withColumns(
        {
            "year": F.date_format(ts, "yyyy"),
            "month": F.date_format(ts, "MM"),
            "day": F.date_format(ts, "dd"),
        }
    )


def write_lake(df: DataFrame, root: str, mode: str = "append") -> None:
    """Writes ``year=/month=/day=`` folders.

    The rebalance brings a day together so that it becomes a few large files,
    and splits a day that is too large for one task.
    """
    parted = with_day_parts(df).hint("rebalance", *DAY_PARTS)
    parted.write.mode(mode).partitionBy(*DAY_PARTS).parquet(root)


def write_lake_stream(
    df: DataFrame,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    name: str | None = None,
    files: int | None = None,
) -> StreamingQuery:
    """The same layout from a stream, each row written once.

    ``files`` bounds the files a micro-batch makes per day; without it there is
    one per task.
    """
    parted = with_day_parts(df)
    parted = parted.repartition(files) if files else parted
    writer = parted.writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", root).option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(*DAY_PARTS).trigger(**(trigger or {"processingTime": "10 seconds"}))
    return (writer.queryName(name) if name else writer).start()


def read_lake(
    spark: SparkSession,
    root: str,
    start_day: date,
    end_day: date,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The days from ``start_day`` to ``end_day``, both included.

    One read of the root: the filter is on partition columns alone, so other
    days are never opened, and a day without a folder is simply empty.
    """
    reader = spark.read
    if schema is not None:
        parts = [T.StructField(p, T.IntegerType()) for p in DAY_PARTS if p not in schema.names]
        reader = reader.schema(T.StructType(schema.fields + parts))
    day = F.make_date(*[F.col(p).cast("int") for p in DAY_PARTS])
    return reader.parquet(root).where(day.between(F.lit(start_day), F.lit(end_day)))


def lake_days(spark: SparkSession, root: str) -> list[date]:
    """The days that have a folder, oldest first; no file is opened."""
    found = [("", [])]
    for part in DAY_PARTS:
        found = [
            (f"{path}/{name}", [*values, name.partition("=")[2]])
            for path, values in found
            for name in folders(spark, f"{root.rstrip('/')}{path}")
            if name.startswith(f"{part}=")
        ]
    return sorted(date(*map(int, values)) for _, values in found if all(map(str.isdigit, values)))


def lake_schema(spark: SparkSession, root: str, day: date) -> T.StructType:
    """The columns of one day's files; other days are not opened for it."""
    return spark.read.parquet(f"{root.rstrip('/')}/{day:year=%Y/month=%m/day=%d}").schema


def read_last_days(
    spark: SparkSession,
    root: str,
    days_back: int = 7,
    today: date | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Today, as UTC has it, and the ``days_back`` days before it."""
    today = today or datetime.now(timezone.utc).date()
    return read_lake(spark, root, today - timedelta(days=days_back), today, schema)
