"""Stream sinks: topics, tables that keep the latest result, console."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logstream.operators.parse import as_values
from logstream.session import folders, remove, stored

# Producer settings.
PRODUCER_OPTIONS = {"kafka.acks": "all", "kafka.retries": "3"}

ONCE = {"availableNow": True}


def every(seconds: int) -> dict[str, str]:
    return {"processingTime": f"{seconds} seconds"}


@dataclass(frozen=True)
class Sink:
    """Where rows go.

    * ``kafka``: ``location`` is the server list, ``topic`` the topic;
    * ``values``: a folder of text files, one JSON value per line;
    * ``parquet``: a folder of Parquet files;
    * ``console``.

    ``files`` is the number of files a micro-batch makes in a folder; without it
    there is one per task.
    """

    kind: str
    location: str = ""
    topic: str = ""
    options: Mapping[str, str] = field(default_factory=dict)
    files: int | None = None

    def kafka_options(self) -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": self.location,
            "topic": self.topic,
            **PRODUCER_OPTIONS,
            **self.options,
        }

    def write_options(self) -> dict[str, str]:
        if self.kind == "kafka":
            return self.kafka_options()
        if self.kind == "console":
            return {"truncate": "false", **self.options}
        return {"path": self.location, **self.options}

    @property
    def format(self) -> str:
        return "text" if self.kind == "values" else self.kind

    def shape(self, df: DataFrame) -> DataFrame:
        """Topics and value files hold JSON; the other kinds hold columns."""
        rows = as_values(df) if self.kind in ("kafka", "values") else df
        return rows.repartition(self.files) if self.files else rows


def write_stream(
    df: DataFrame,
    sink: Sink,
    checkpoint: str | None,
    mode: str = "append",
    trigger: Mapping | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Starts a query. Only the console may go without a checkpoint.

    The checkpoint path is the query's identity: restarted with the same path it
    goes on where it stopped.
    """
    if checkpoint is None and sink.kind != "console":
        raise ValueError("a checkpoint path is needed to resume without loss")
    writer = sink.shape(df).writeStream.outputMode(mode).format(sink.format)
    writer = writer.options(**sink.write_options())
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return (writer.queryName(name) if name else writer).start()


def write_batch(df: DataFrame, sink: Sink, batch_id: int) -> None:
    """One micro-batch to a sink.

    Files go to a folder of the batch, which a replay overwrites. A topic gets
    replayed rows twice; readers leave them out with ``repeats``.
    """
    rows = sink.shape(df)
    if sink.kind == "console":
        rows.show(int(sink.options.get("numRows", 20)), truncate=False)
    elif sink.kind == "kafka":
        rows.write.format("kafka").options(**sink.kafka_options()).save()
    else:
        target = f"{sink.location.rstrip('/')}/batch_id={batch_id}"
        rows.write.mode("overwrite").format(sink.format).options(**sink.options).save(target)


def fan_out(
    df: DataFrame,
    routes: Mapping[str, tuple[Callable[[DataFrame], DataFrame], Sink]],
    checkpoint: str,
    trigger: Mapping | None = None,
    name: str | None = None,
    done: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """One read of the input for several sinks.

    Each route is a function from the micro-batch to the rows of its sink. The
    batch is kept while its routes run, so its input is parsed once. ``done`` is
    called with the batch when all its routes have been written.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for rows, sink in routes.values():
                write_batch(rows(kept), sink, batch_id)
            if done is not None:
                done(kept, batch_id)
        finally:
            kept.unpersist()

    writer = df.writeStream.outputMode("append").foreachBatch(send)
    writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return (writer.queryName(name) if name else writer).start()


# --- results that change until their window closes ---------------------------

STATS_KEY = ("window_start", "window_end", "service", "level")


def write_latest(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Mapping | None = None,
    name: str | None = None,
    files: int = 8,
    key: tuple[str, ...] = STATS_KEY,
) -> StreamingQuery:
    """Window results in update mode, each micro-batch in folders of its own.

    The folders are ``window_day=/batch_id=``; a replayed batch replaces exactly
    what it wrote before. Read with :func:`read_latest`. However many tasks keep
    the state, a batch makes at most ``files`` files per day.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(batch, path, batch_id, files, key)

    writer = df.writeStream.outputMode("update").foreachBatch(upsert)
    writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return (writer.queryName(name) if name else writer).start()


def upsert_latest(
    batch: DataFrame, path: str, batch_id: int, files: int = 8, key: tuple[str, ...] = STATS_KEY
) -> None:
    """One micro-batch of window results to the table of :func:`write_latest`."""
    (
        batch.repartition(files, *key)
        .withColumns({"window_day": F.to_date("window_start"), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_day", "batch_id")
        .parquet(path)
    )


def read_latest(
    spark: SparkSession, path: str, key: tuple[str, ...] = STATS_KEY, since: str | None = None
) -> DataFrame:
    """The newest result of every key; ``since`` is a first window day.

    The greatest batch of each key is found on the keys alone, merged map-side.
    """
    history = spark.read.parquet(path)
    if since is not None:
        history = history.where(F.col("window_day") >= F.lit(since).cast("date"))
    return _latest(history, key).drop("window_day", "batch_id")


def _latest(history: DataFrame, key: tuple[str, ...]) -> DataFrame:
    last = history.groupBy(*key).agg(F.max("batch_id").alias("batch_id"))
    same = " AND ".join(f"rows.{c} <=> last.{c}" for c in (*key, "batch_id"))
    return history.alias("rows").join(last.alias("last"), F.expr(same), "left_semi")


# Where compaction puts what it has merged; every micro-batch comes after it.
MERGED = -1


def compact_latest(
    spark: SparkSession, path: str, before: str, key: tuple[str, ...] = STATS_KEY
) -> None:
    """Leaves one folder per window day before ``before``, a day whose windows are all closed.

    The merged rows are written first, and count for less than any micro-batch, so that a
    reader sees the same result at any time, also after a break.
    """
    closed = spark.read.parquet(path).where(F.col("window_day") < F.lit(before).cast("date"))
    merged = stored(_latest(closed, key), "compacted").withColumn("batch_id", F.lit(MERGED))
    (
        merged.repartition("window_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_day", "batch_id")
        .parquet(path)
    )
    for day in _folders(spark, path, "window_day"):
        if day < before:
            _keep_batches(spark, f"{path}/window_day={day}", lambda batch: batch == MERGED)


def prune_batches(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Leaves the newest ``keep`` micro-batches of a table whose last batch is its result."""
    batches = sorted(map(int, _folders(spark, path, "batch_id")))
    newest = batches[-keep:]
    _keep_batches(spark, path, lambda batch: batch in newest)


def _folders(spark: SparkSession, path: str, part: str) -> list[str]:
    """The values of a partition column, from the names of its folders."""
    names = folders(spark, path)
    return [name.partition("=")[2] for name in names if name.startswith(f"{part}=")]


def _keep_batches(spark: SparkSession, path: str, wanted: Callable[[int], bool]) -> None:
    for batch in _folders(spark, path, "batch_id"):
        if not wanted(int(batch)):
            remove(spark, f"{path}/batch_id={batch}")
