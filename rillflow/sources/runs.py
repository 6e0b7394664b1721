"""Files that benchmark runs leave, as tables: <root>/<workload>/<strategy>/<file>, a folder a run.

Every reader gives run ("workload/strategy"), workload and strategy from the path; folders may also be named by Spark's own
writers (workload=.../strategy=...). A file's name may be a pattern. Folders without the file give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.artifacts import JOB
from .paths import plain

# fixed values: names of a run's files
JOB_FILE, METRICS_FILE, SUMMARY_FILE = "job-details.json", "metrics.csv", "SUMMARY.txt"
SOURCE_FILE, PROCESSING_FILE, TOTAL_FILE, SINK_FILE = "source-stats.txt", "latency-processing.txt", "latency-total.txt", "sink-stats.txt"
PLACEMENT_FILE, SCHEDULER_FILE = "taskmanager-placement.txt", "scheduler-logs.txt"


def _files(spark: SparkSession, name: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)


def _of_run(rows: DataFrame, *columns) -> DataFrame:
    parts = F.split(plain("_metadata.file_path"), "/")
    workload, strategy = (F.regexp_replace(F.element_at(parts, i), f"^{name}=", "") for i, name in ((-3, "workload"), (-2, "strategy")))
    return rows.select(F.concat_ws("/", workload, strategy).alias("run"), workload.alias("workload"), strategy.alias("strategy"), *columns)


def read_jobs(spark: SparkSession, root: str | list[str], name: str = JOB_FILE) -> DataFrame:
    """A row per job file, which holds one JSON object."""
    return _of_run(_files(spark, name).schema(JOB).option("multiLine", True).json(root), "*").drop("_metadata")


def read_lines(spark: SparkSession, root: str | list[str], name: str) -> DataFrame:
    """run, workload, strategy, line: large logs are split by lines over tasks."""
    return _of_run(_files(spark, name).text(root), F.col("value").alias("line"))


def read_ordered_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """run, workload, strategy, at, line: at keeps the order of a run's lines (file, where the split begins, line in it), however the
    files are split over tasks."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    return _of_run(_files(spark, name).text(root), at.alias("at"), F.col("value").alias("line"))


def stream_job_files(spark: SparkSession, root: str, name: str = JOB_FILE, files_per_trigger: int = 200) -> DataFrame:
    """folder, a row per job file that comes: job files as a stream."""
    reader = spark.readStream.schema(JOB).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    found = reader.option("maxFilesPerTrigger", files_per_trigger).json(root)
    return found.select(F.regexp_replace(plain("_metadata.file_path"), "/[^/]*$", "").alias("folder"))


def read_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """run, workload, strategy, text: a row per file, for the small ones whose records take several lines.

    A file is one value here; logs of any size go through read_ordered_lines().
    """
    return _of_run(_files(spark, name).text(root, wholetext=True), F.col("value").alias("text"))
