"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the partition sizing and splits hot partitions of
# joins and of REBALANCE writes.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}
# On a cluster shuffles start wide and are merged at run time: what is evenly too large is
# no skew, and would not be split.
WIDE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
WIDE_PARTITIONS = 8192


def build_session(app: str = "logstream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not is_local(spark) and WIDE not in conf:
        spark.conf.set(WIDE, WIDE_PARTITIONS)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether everything runs in this process (``local-cluster`` does not)."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def use_utc(spark: SparkSession) -> SparkSession:
    """Hours, days and windows are those of UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@lru_cache(maxsize=None)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="logstream-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/logstream/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


# Scratch paths of this process that were not cleared yet.
_made: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Removes what :func:`scratch` has given out; call it when no result is read any more."""
    while _made:
        remove(spark, _made.pop())


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to a scratch table and read again: lineage ends here."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(root)]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with all that is in it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
