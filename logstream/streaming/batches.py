"""Batches whose entries arrive over several triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream import model
from logstream.functions.rows import free_name
from logstream.operators.validate import is_valid

# A batch is over when no entry of it has come for GAP; entries may come out of order by LATE. A batch
# that takes longer than LONGEST is refused, which bounds how long its entries wait.
GAP, LATE, LONGEST = "1 minute", "1 minute", "1 hour"


def accept_streamed_batches(
    entries: DataFrame,
    arrived: str = "kafka_timestamp",
    gap: str = GAP,
    late: str = LATE,
    longest: str = LONGEST,
    most: int = model.MAX_BATCH,
) -> DataFrame:
    """Entries of the batches with 1..``most`` entries that are all valid, as soon as a batch is over.

    ``batch_id`` names the batch; an entry without one is a batch of its own and goes on at once. Entries
    wait in the state of a stream-stream join until the verdict on their batch, a session window over its
    id, meets them. The join's range on arrival time lets both sides expire: at most the entries of
    ``longest`` wait. A batch id that is used again after ``gap`` names another batch. Append mode.
    """
    # A column of the verdicts that no entry has.
    session, of, begun, over = (free_name(entries, f"_{c}") for c in ("session", "of", "begun", "over"))
    timed = entries.withWatermark(arrived, late)
    named = timed.where(F.col("batch_id").isNotNull())
    sessions = named.groupBy(F.session_window(arrived, gap).alias(session), "batch_id").agg(
        F.count("*").alias("entries"), F.count_if(is_valid()).alias("valid")
    )
    verdicts = sessions.where((F.col("entries") <= most) & (F.col("valid") == F.col("entries"))).select(
        F.col("batch_id").alias(of),
        F.col(session)["start"].alias(begun),
        F.window_time(session).alias(over),
    )
    in_time = f"{arrived} >= {begun} AND {arrived} <= {over} AND {arrived} >= {over} - INTERVAL {longest}"
    whole = f"{begun} >= {over} - INTERVAL {longest}"
    joined = named.join(verdicts, F.expr(f"batch_id = {of} AND {in_time} AND {whole}"))
    alone = timed.where(F.col("batch_id").isNull() & is_valid())
    return joined.select(*entries.columns).union(alone)
