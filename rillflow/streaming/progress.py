"""What running streams report of their batches, kept as a table: Spark itself keeps the last hundred reports only."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

REPORTS = "batch long, at string, input_rows long, rows_dropped_late long, metrics string"


class Reports(StreamingQueryListener):
    """Writes a row a batch of the streams with one name: rows read, rows that came too late, and observed metrics as JSON.

    Rows are written `every` batches and when the stream ends. A batch that is done again after a failure has a row for
    each time; reports() takes the last. numRowsDroppedByWatermark counts rows as they come to the state: where they are
    summed up before, a row for each group of a task.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, every: int = 50):
        self.spark, self.name, self.path, self.every = spark, name, path, every
        self.rows, self.runs, self.ended, self.failure = [], set(), threading.Event(), None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name != self.name:
            return
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        metrics = {k: v.asDict(recursive=True) for k, v in p.observedMetrics.items()}
        self.rows.append((p.batchId, p.timestamp, p.numInputRows, late, json.dumps(metrics, default=str)))
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) in self.runs:
            self.flush()
            self.ended.set()

    def flush(self) -> None:
        if not self.rows:
            return
        try:
            self.spark.createDataFrame(self.rows, REPORTS).coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []
        except Exception as error:  # a listener's errors are lost; this one is raised where the stream is waited for
            self.failure = error


def reports(spark: SparkSession, path: str) -> DataFrame:
    """A row per batch: batch, at, input_rows, rows_dropped_late, metrics."""
    rows = spark.read.schema(REPORTS).parquet(path)
    last = rows.groupBy("batch").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "batch")), "at").alias("r"))
    return last.select("batch", "r.*")


def followed(spark: SparkSession, start: Callable[[str], object], path: str, wait: float = 120.0) -> DataFrame:
    """Runs a stream up to the end of its input and gives the reports of all its batches.

    start(name) starts the stream under that name. The reports are a table in path; a stream that is started again over the
    same path adds to it.
    """
    listener = Reports(spark, f"followed-{uuid.uuid4().hex}", path)
    spark.createDataFrame([], REPORTS).write.mode("append").parquet(path)
    spark.streams.addListener(listener)
    try:
        start(listener.name).awaitTermination()
        if not listener.ended.wait(wait):
            raise TimeoutError("the stream's last report didn't come")
        if listener.failure:
            raise listener.failure
    finally:
        spark.streams.removeListener(listener)
    return reports(spark, path)


def metrics_of(rows: DataFrame, name: str, kinds: dict[str, str]) -> DataFrame:
    """batch and the measures observed under a name, with the types given; batches that observed nothing are left out."""
    schema = f"`{name}` struct<{', '.join(f'`{n}`: {t}' for n, t in kinds.items())}>"
    found = rows.select("batch", F.from_json("metrics", schema)[name].alias("m")).where("m is not null")
    return found.select("batch", *(F.col("m")[n].alias(n) for n in kinds))


def kinds_of(stream: DataFrame, measures: dict[str, Column]) -> dict[str, str]:
    """The types of measures over a stream's rows."""
    return dict(stream.agg(*(c.alias(n) for n, c in measures.items())).dtypes)
