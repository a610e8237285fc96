"""How far a running query has come in its topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstream.session import folders
from logstream.streaming.sinks import prune_batches

COMMITS = "topic STRING, partition INT, committed LONG"


def commit(spark: SparkSession, path: str, batch: DataFrame, batch_id: int) -> None:
    """Notes the next offset of each topic and partition, once a micro-batch has been written.

    Each micro-batch has a folder with all partitions seen so far, which a replay replaces; the two newest
    stay. A partition is a row, however many records it has.
    """
    seen = batch.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("committed"))
    earlier = _newest(spark, path, batch_id)
    if earlier is not None:
        seen = earlier.unionByName(seen).groupBy("topic", "partition").agg(F.max("committed").alias("committed"))
    seen.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    prune_batches(spark, path)


def _newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The commits of the last micro-batch, or of the last one before a given one."""
    try:
        names = folders(spark, path)
    except Exception as error:  # the JVM's FileNotFoundException: nothing is committed yet
        if "FileNotFoundException" in str(error):
            return None
        raise
    batches = [int(name.partition("=")[2]) for name in names if name.startswith("batch_id=")]
    batches = [batch for batch in batches if before is None or batch < before]
    if not batches:
        return None
    return spark.read.schema(COMMITS).parquet(f"{path}/batch_id={max(batches)}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The next offset a query reads, by topic and partition; no rows before its first micro-batch."""
    found = _newest(spark, path)
    return spark.createDataFrame([], COMMITS) if found is None else found
