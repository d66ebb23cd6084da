"""Run metrics of streams: what Spark reports of each batch, kept as rows."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = (
    "query_id string, run_id string, name string, batch_id long, started string, input_rows long, duration_ms long, "
    "rows_per_second double, state_rows long, sources string"
)
#: Seconds to wait for the last events of a run, which arrive after the query has ended.
PATIENCE = 60


class ProgressLog(StreamingQueryListener):
    """One row for each batch of the queries that start while it listens. A triggered run has few batches, so rows are
    few; those of a run are written when it ends."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.open: set[str] = set()
        self.failed: dict[str, str] = {}
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (
            str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.batchDuration, float(p.processedRowsPerSecond),
            sum(s.numRowsTotal for s in p.stateOperators), ", ".join(s.description for s in p.sources),
        )
        with self.changed:
            self.rows.append(row)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.open.discard(str(event.runId))
            if event.exception:
                self.failed[str(event.runId)] = event.exception
            self.changed.notify_all()

    def ended(self, patience: float = PATIENCE) -> bool:
        with self.changed:
            return self.changed.wait_for(lambda: not self.open, patience)


@contextmanager
def recorded(spark: SparkSession, table: str) -> Iterator[ProgressLog]:
    """Within it, the progress of every stream that runs to its end is appended to ``table``; also if one fails."""
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        log.ended()
        spark.streams.removeListener(log)
        spark.createDataFrame(log.rows, PROGRESS).coalesce(1).write.mode("append").parquet(table)


def run_report(progress: DataFrame) -> DataFrame:
    """(query_id, run_id, batches, input_rows, duration_ms, slowest_batch_ms, state_rows) of each run."""
    return progress.groupBy("query_id", "run_id").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max("duration_ms").alias("slowest_batch_ms"),
        F.max("state_rows").alias("state_rows"),
    )


def batch_gaps(progress: DataFrame, stored: DataFrame) -> DataFrame:
    """(batch_id, input_rows, stored_rows): batches whose input is not what the table holds of them."""
    seen = progress.groupBy("batch_id").agg(F.sum("input_rows").alias("input_rows"))
    held = stored.groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("stored_rows"))
    both = seen.filter("input_rows > 0").join(held, "batch_id", "full")
    return both.fillna(0).filter("input_rows <> stored_rows")
