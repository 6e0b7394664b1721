"""The bid pipeline as Structured Streaming jobs that run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators.pipeline import aggregate, amounts, filters, window
from ..scratch import scratch
from ..sources.bids import bid_stream


def windowed_stream(bids: DataFrame, config: PipelineConfig) -> DataFrame:
    rows = amounts(filters(bids, config), config).withWatermark("ts", config.lateness)
    found = rows.groupBy("auction_id", window(config).alias("w")).agg(aggregate(config.aggregate))
    return found.select("auction_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value")


def to_files(stream: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Runs an append stream over all input there is into Parquet files, exactly once, and reads them."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True)
    writer = writer.queryName(name) if name else writer
    query = writer.start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def windows_of_files(spark: SparkSession, path: str, config: PipelineConfig) -> DataFrame:
    """Windows that the watermark has closed: append mode holds back those ending after the latest time less the lateness."""
    return to_files(windowed_stream(bid_stream(spark, path), config), scratch(spark), config.run_name())


def run(spark: SparkSession, path: str, config: PipelineConfig, folder: str) -> dict[str, object]:
    """The configured job, from bids to the sinks that the settings name, up to the end of its input.

    file_sink writes windows to output_path, as many files a batch as the sinks' parallelism; console_sink prints them and
    measures them: the sink's figures are a table. Without a sink, the windows are computed and dropped. As many files are read a
    batch as the sources' parallelism, and windows are dealt over `parallelism` tasks. folder keeps checkpoints and figures.
    cpu_load only names the run. Gives the sinks' results by name: windows, figures.
    """
    from . import stats

    if config.file_sink and not config.output_path:
        raise ValueError("a file sink needs an output_path")
    conf, setting = spark.conf, "spark.sql.shuffle.partitions"
    before = conf.get(setting)
    stream = lambda: windowed_stream(bid_stream(spark, path, config.source_parallelism), config)
    conf.set(setting, config.parallelism)  # counts when a stream is started
    try:
        found: dict[str, object] = {}
        if config.file_sink:
            found["windows"] = to_files(stream().coalesce(config.sink_parallelism), config.output_path, config.run_name())
        if config.console_sink:
            stats.to_console(stream())
            found["figures"] = stats.to_statistics(stream(), F.col("value").cast("long"), f"{folder}/figures")
        if not found:
            stream().writeStream.format("noop").option("checkpointLocation", f"{folder}/state").queryName(config.run_name()).trigger(availableNow=True).start().awaitTermination()
        return found
    finally:
        conf.set(setting, before)


def running_totals(spark: SparkSession, path: str, config: PipelineConfig) -> DataFrame:
    """Totals by auction in update mode: each batch's new totals are written with its number; the last of a key counts."""
    rows = amounts(filters(bid_stream(spark, path), config), config)
    sums = rows.groupBy("auction_id").agg(F.sum(F.col("amount").cast("decimal(20,5)")).cast("double").alias("total"))
    out = scratch(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = sums.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("auction_id").agg(F.max_by("total", "batch").alias("total"))
