"""Runs as they arrive: the row of metrics of each run whose job file comes, kept up to date in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import metrics
from ..sources import runs
from ..sources.paths import literal

#: Job files of a run that is done again have names of their own: a stream takes a file's name once.
JOB_FILES = "job-details*.json"


def _rows(spark: SparkSession, folders: list[str], job_files: str, scheduler_files: str) -> DataFrame:
    """The rows of metrics of the runs in these folders, from all that lies there; of a run's jobs the latest counts."""
    jobs = runs.read_jobs(spark, folders, job_files)
    latest = jobs.groupBy("run").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in jobs.columns if c != "run")), F.struct("start-time", "jid")).alias("j")).select("run", "j.*")
    lines = [runs.read_lines(spark, folders, name) for name in (runs.SOURCE_FILE, runs.PROCESSING_FILE, runs.TOTAL_FILE, runs.PLACEMENT_FILE, scheduler_files)]
    return metrics.metrics_row(latest, *lines)


def follow(spark: SparkSession, root: str, table: str, state: str, files_per_trigger: int = 200, job_files: str = JOB_FILES, scheduler_files: str = runs.SCHEDULER_FILE) -> DataFrame:
    """Takes all job files that have come to root since the last time, and gives the table of metrics, a row per workload and strategy.

    root: <root>/<workload>/<strategy>/<file>. A run's row is made of all that lies in its folder, and replaces the row that
    was there; rows of other runs stay. So a batch that is done again after a failure changes nothing, and any number of
    triggers gives what one reading of all files gives. A batch's folders, as many as files are taken at once, come to the driver.
    """
    stream = runs.stream_job_files(spark, root, job_files, files_per_trigger)

    def write(batch: DataFrame, number: int) -> None:
        folders = [literal(r.folder) for r in batch.select("folder").distinct().collect()]
        if folders:
            rows = _rows(batch.sparkSession, folders, job_files, scheduler_files)
            rows.repartition("workload", "strategy").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workload", "strategy").parquet(table)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return read(spark, table)


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table of metrics; without any run, it has no rows."""
    texts = {*metrics.TEXTS, "run"}
    kinds = {c: "string" if c in texts else "double" if c in metrics.DOUBLES else "long" for c in ("run", *metrics.FULL)}
    schema = StructType([StructField(c, StringType()) for c in kinds])
    empty = spark.createDataFrame([], schema).select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
    empty.limit(0).write.mode("append").partitionBy("workload", "strategy").parquet(table)
    return spark.read.schema(empty.schema).parquet(table).select(empty.columns)
