"""Progress and failures of streaming queries."""

from __future__ import annotations

from collections import Counter
from threading import Lock
from time import monotonic

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = (
    "query STRING, run_id STRING, event STRING, batch_id BIGINT, input_rows BIGINT, "
    "late_rows_dropped BIGINT, rows_per_second DOUBLE, watermark STRING, error STRING"
)


class ProgressLog(StreamingQueryListener):
    """Records the events of all queries, one small row per trigger; none is dropped.

    With ``path`` the rows are appended to a table there, ``chunk`` at a time, when the oldest has waited
    for ``seconds``, and whenever a query ends; the rest waits in memory. ``late`` adds up the late rows by
    query.
    """

    def __init__(
        self,
        spark: SparkSession | None = None,
        path: str | None = None,
        chunk: int = 100,
        seconds: float = 60,
    ):
        self._spark, self._path, self._chunk, self._seconds = spark, path, chunk, seconds
        self._oldest: float | None = None
        self._rows: list[tuple] = []
        self._late: Counter[str] = Counter()
        self._lock = Lock()

    def _add(self, *row, last: bool = False) -> None:
        with self._lock:
            self._rows.append(row)
            now = monotonic()
            self._oldest = now if self._oldest is None else self._oldest
            waited = now - self._oldest >= self._seconds
            full = last or waited or len(self._rows) >= self._chunk
        if full and self._path is not None:
            self.flush(self._spark, self._path)

    def late_rows(self, query: str) -> int:
        """Window entries the named query dropped because they came after the watermark."""
        with self._lock:
            return self._late[query]

    def onQueryStarted(self, event) -> None:
        self._add(event.name, str(event.runId), "started", None, None, None, None, None, None)

    def onQueryIdle(self, event) -> None:
        """A query without input: what has waited long enough is written all the same."""
        with self._lock:
            waited = self._oldest is not None and monotonic() - self._oldest >= self._seconds
        if waited and self._path is not None:
            self.flush(self._spark, self._path)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        with self._lock:
            self._late[p.name] += late
        self._add(
            p.name,
            str(p.runId),
            "progress",
            p.batchId,
            p.numInputRows,
            late,
            float(p.processedRowsPerSecond),
            dict(p.eventTime or {}).get("watermark"),
            None,
        )

    def onQueryTerminated(self, event) -> None:
        end = "failed" if event.exception else "stopped"
        row = (None, str(event.runId), end, None, None, None, None, None, event.exception)
        self._add(*row, last=True)

    def rows(self) -> list[tuple]:
        with self._lock:
            return list(self._rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), PROGRESS)

    def flush(self, spark: SparkSession, path: str) -> None:
        """Appends what waits to a table. It waits on if that fails."""
        with self._lock:
            rows, self._rows, self._oldest = self._rows, [], None
        if not rows:
            return
        try:
            spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)
        except Exception:
            with self._lock:
                self._rows = rows + self._rows
            raise
