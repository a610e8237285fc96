"""A lake whose searches open few files: sorted days, Bloom filters, and an index of files and traces.

``days/`` holds the records by day, each day sorted by service and time, so that a file covers few services
and a short time; its row groups carry Bloom filters on the trace id. ``files/`` has a row per file with its
services and times. ``traces/`` leads from a hash of the trace id to the files that hold it, in buckets sorted
by hash. A search reads the index first and then only the files that it names.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.functions.clock import utc
from logstream.operators.search import check_limit, matching, newest

# Folders of the trace index; a search by trace id opens one.
TRACE_BUCKETS = 64
# Rows that a file of a day is meant to hold.
FILE_ROWS = 2_000_000
# Rows below which a task is not worth its own: small files are written many to a task.
TASK_ROWS = 100_000
# Distinct traces that a Bloom filter of a row group is made for.
FILTER_TRACES = 200_000


def _trace_hash(trace: Column) -> Column:
    return F.xxhash64(trace)


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(TRACE_BUCKETS)).cast("int")


def write_indexed(df: DataFrame, root: str, file_rows: int = FILE_ROWS) -> None:
    """Appends records and the index entries of the files they went to.

    Written under a name of its own: files count once the index names them, so that an attempt that broke
    off leaves nothing that a search would find. ``day``, if the records have it, is replaced.
    """
    spark = df.sparkSession
    rows = df.withColumn("day", F.to_date("timestamp"))
    order = ["day", "service", "timestamp"]
    # Tasks follow the rows, not the files: each reports to the driver, and has its bounds from a sample there.
    parts = max(1, -(-rows.count() // max(file_rows, TASK_ROWS)))
    part = f"{root.rstrip('/')}/days/part={uuid.uuid4().hex}"
    (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .write.option("maxRecordsPerFile", file_rows)
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .option("parquet.bloom.filter.expected.ndv#trace_id", str(min(FILTER_TRACES, file_rows)))
        .partitionBy("day")
        .parquet(part)
    )
    _index(spark, root, part)


def _index(spark: SparkSession, root: str, part: str) -> None:
    written = spark.read.parquet(part).withColumn("file", F.col("_metadata.file_path"))
    hashed = _trace_hash(F.col("trace_id"))
    traces = written.where("trace_id IS NOT NULL").select(hashed.alias("hash"), "file").distinct()
    bucketed = traces.withColumn("bucket", _bucket(F.col("hash")))
    # A bucket's rows in few files, each sorted, so that row groups are skipped by their bounds.
    (
        bucketed.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "hash")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(f"{root.rstrip('/')}/traces")
    )
    # The files last: what they do not name is not there.
    files = written.groupBy("file").agg(
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
        F.collect_set("service").alias("services"),
        F.count("*").alias("rows"),
    )
    files.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/files")


def files_for(
    spark: SparkSession,
    root: str,
    service: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    trace_id: str | None = None,
) -> list[tuple[str, datetime | None, int]]:
    """The files that may hold matching records, with their newest time and number of rows.

    One row per file of the lake comes to the driver at most, as Spark's own file listing has it.
    """
    files = spark.read.parquet(f"{root.rstrip('/')}/files")
    kind = files.schema["first"].dataType
    if service is not None:
        files = files.where(F.array_contains("services", service))
    if start is not None:
        files = files.where(F.col("last") >= utc(start).cast(kind))
    if end is not None:
        files = files.where(F.col("first") < utc(end).cast(kind))
    if trace_id is not None:
        traces = spark.read.schema("hash BIGINT, file STRING, bucket INT").parquet(
            f"{root.rstrip('/')}/traces"
        )
        hashed = _trace_hash(F.lit(trace_id))
        # Both as literals, which the scan takes: one folder, and the row groups of one hash.
        value, bucket = spark.range(1).select(hashed, _bucket(hashed)).first()
        named = traces.where((F.col("bucket") == bucket) & (F.col("hash") == value)).select("file")
        files = files.join(named.distinct(), "file", "left_semi")
    return [(r["file"], r["last"], r["rows"]) for r in files.collect()]


def read_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The records of named files; without any, of none."""
    folder = f"{root.rstrip('/')}/days"
    if names:
        schema = spark.read.parquet(names[0]).schema
        return spark.read.schema(schema).parquet(*names)
    return spark.read.parquet(folder).drop("part", "day").limit(0)


def search_indexed(
    spark: SparkSession,
    root: str,
    limit: int = 100,
    trace_id: str | None = None,
    level: str | None = None,
    **filters,
) -> DataFrame:
    """The newest ``limit`` records that match, from the files the index names.

    ``filters`` are service, start and end. Without a trace id the files are taken by their newest time, as
    many as can hold the limit, before any is opened; a level may make it necessary to open more.
    """
    check_limit(limit)
    named = sorted(
        files_for(spark, root, trace_id=trace_id, **filters),
        key=lambda file: (file[1] is not None, file[1]),
        reverse=True,
    )

    def matches(files: list[tuple]) -> DataFrame:
        rows = read_files(spark, root, [file for file, _, _ in files])
        found = matching(rows, level=level, **filters)
        return found if trace_id is None else found.where(F.col("trace_id") == trace_id)

    taken, step = len(named), 1
    if trace_id is None:
        taken = 0
        while taken < len(named):
            taken, step = min(taken + step, len(named)), step * 2
            found = matches(named[:taken])
            # What is not opened yet is older than ``oldest``.
            oldest = named[taken][1] if taken < len(named) else None
            if oldest is not None and found.where(F.col("timestamp") > oldest).limit(limit).count() >= limit:
                break
    return newest(matches(named[:taken]), limit)
