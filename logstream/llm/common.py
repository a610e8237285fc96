"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.session import scratch, use_utc

# Rows and bytes per Arrow batch: long texts must not pile up in a Python worker, nor in the JVM's buffers, which
# double as they grow. Any worker of an executor comes to run any step, so the largest step counts for all.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
# Largest table that is broadcast, in rows; beyond it the plain join is used.
BROADCAST_ROWS = 100_000

# The two kinds of words, as translations of bytes; ``split()`` does the rest.
# White space: [\x20\x09-\x0D]. Other words: anything but 0-9, a-z and non-ASCII.
LOWER = bytes(range(256)).lower()
ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application.

    The archive is a file of the driver, which serves it to them.
    """
    context = spark.sparkContext
    if getattr(context, "_logstream_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for path in sorted(package.rglob("*.py")):
            packed.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._logstream_sent = True


def prepared(spark: SparkSession) -> SparkSession:
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return use_utc(spark)


def give_back() -> None:
    """Hands freed memory to the system; Arrow's allocator and the C library's keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(
    frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``mapInArrow`` that leaves its workers small.

    Spark keeps idle workers and gives any of them any later step, beside those that then run: what
    steps leave in them would add up.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return frame.mapInArrow(each, schema)


def map_batches(
    frame: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``run`` on each Arrow batch that has rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield run(batch)

    return map_arrow(frame, each, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def white_words(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode().split()


def lower_white_words(text: str) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.encode().translate(LOWER).split()


def lower_words(text: str) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, with A-Z in lower case."""
    return text.encode().translate(ALNUM).split()


# Spark removes a query's shuffle files as it ends, not once the driver happens to collect its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and so do its shuffle files."""
    spark = frame.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A shared folder that Python tasks can open by URI."""
    path = scratch(spark, name)
    return path if "://" in path else f"file://{path}"


def join_sized(
    large: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join that broadcasts ``small`` if its counted rows allow it, and shuffles otherwise."""
    fits = small.limit(rows + 1).count() <= rows
    return large.join(F.broadcast(small) if fits else small, on, how)


def attempt_name(prefix: str) -> str:
    """A name that nothing else has: no other attempt of a task, no column of a table."""
    return f"{prefix}-{uuid.uuid4().hex}"
