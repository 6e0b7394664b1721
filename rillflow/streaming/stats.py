"""Figures of streams while they run: counted by foreachBatch or observed on the way, and rows that come too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import sketches
from ..operators.pipeline import amounts, filters, window
from ..scratch import scratch
from ..sources.bids import EVENTS, as_bids, bid_stream
from . import progress


def to_console(stream: DataFrame, mode: str = "append", rows: int = 20):
    """The stream's batches on the console, up to the end of its input."""
    query = stream.writeStream.format("console").option("numRows", rows).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_snapshots(stream: DataFrame, latency_ms: Column, path: str, mode: str = "append", group: str | None = None, k: int = sketches.K) -> DataFrame:
    """A sink that measures and keeps no row: group, batch, n_rows, sum_ms, min_ms, max_ms, p50, p95, p99 of all measured up to a batch.

    Each batch leaves a sketch a group; they are merged along the batches when they are read. A batch that is done again replaces its
    sketches.
    """
    label = (F.col(group).cast("string") if group else F.lit("all")).alias("group")

    def measure(batch: DataFrame, number: int) -> None:
        sketches.sketched(batch.select(label, latency_ms.alias("_ms")), ["group"], "_ms", k).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(measure).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema("group string, sketch binary, n_rows long, sum_ms long, min_ms long, max_ms long, batch int").parquet(f"{path}/rows")
    return sketches.along(rows, "group", "batch").select("group", "batch", *sketches.FIGURES, *sketches.percentiles("sketch"))


def to_statistics(stream: DataFrame, latency_ms: Column, path: str, mode: str = "append", group: str | None = None) -> DataFrame:
    """A sink that measures and keeps no row: batch, group, n_rows, n_measured, min_ms, max_ms, sum_ms, a row per batch and group.

    latency_ms is measured in the batch; negative and null ones aren't. A batch that is done again replaces its row.
    """
    kept = F.when(F.col("_ms") >= 0, F.col("_ms"))
    label = (F.col(group).cast("string") if group else F.lit("all")).alias("group")

    def measure(batch: DataFrame, number: int) -> None:
        found = batch.withColumn("_ms", latency_ms).groupBy(label).agg(
            F.count("*").alias("n_rows"), F.count(kept).alias("n_measured"), F.min(kept).alias("min_ms"), F.max(kept).alias("max_ms"), F.sum(kept).alias("sum_ms")
        )
        found.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(measure).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = "group string, n_rows long, n_measured long, min_ms long, max_ms long, sum_ms long, batch int"
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/rows")


def _files(stream: DataFrame, path: str):
    """Starts a stream into Parquet files, under the name it is given."""
    return lambda name: stream.writeStream.queryName(name).format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")


def observed_batches(stream: DataFrame, name: str, measures: dict[str, Column], path: str) -> DataFrame:
    """batch and measures: runs the stream into Parquet files, and gives what its operators saw pass in each batch with rows."""
    watched = stream.observe(name, *(c.alias(n) for n, c in measures.items()))
    rows = progress.followed(stream.sparkSession, _files(watched, path), f"{path}/reports")
    return progress.metrics_of(rows.where("input_rows > 0"), name, progress.kinds_of(stream, measures))


def observed(stream: DataFrame, name: str, measures: dict[str, Column], path: str) -> list[dict]:
    """observed_batches() as a list in order, a dict a batch."""
    return [{n: r[n] for n in measures} for r in observed_batches(stream, name, measures, path).orderBy("batch").collect()]


def counted(bids: DataFrame, config: PipelineConfig, path: str) -> DataFrame:
    """batch, generated, emitted, late_groups: what a running pipeline's source gave, what its filters let through, and the sums of a
    window and key that came too late. bids is a stream; its windows go to Parquet files.
    """
    n = {"n": F.count("*")}
    source = bids.observe("generated", n["n"].alias("n"))
    rows = amounts(filters(source, config), config).observe("emitted", n["n"].alias("n")).withWatermark("ts", config.lateness)
    windows = rows.groupBy("auction_id", window(config).alias("w")).agg(F.count("*").alias("n"))
    found = progress.followed(bids.sparkSession, _files(windows, path), f"{path}/reports").where("input_rows > 0")
    sides = [progress.metrics_of(found, name, {"n": "long"}).withColumnRenamed("n", name) for name in ("generated", "emitted")]
    return found.select("batch", F.col("rows_dropped_late").alias("late_groups")).join(sides[0], "batch").join(sides[1], "batch").select("batch", "generated", "emitted", "late_groups")


def late_counts(spark: SparkSession, parts: list[DataFrame], config: PipelineConfig) -> DataFrame:
    """auction_id, window_start, window_end, arrived, late: rows of each window that came, and that the watermark kept out.

    parts are events in order of arrival, each a batch of one stream. A row is late if its window ended at or before the
    latest time of the batches before, less the lateness. Counts are taken in update mode: the last one of a window holds
    all rows that were let in.
    """
    path = scratch(spark, "late")
    spark.createDataFrame([], EVENTS).write.parquet(f"{path}/in")
    stream = amounts(filters(bid_stream(spark, f"{path}/in", None), config), config).withWatermark("ts", config.lateness)
    counts = stream.groupBy("auction_id", window(config).alias("w")).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    let_in = spark.read.schema("auction_id long, w struct<start:timestamp,end:timestamp>, n long, batch int").parquet(f"{path}/rows").groupBy("auction_id", "w").agg(F.max("n").alias("n"))
    came = spark.read.schema(EVENTS).parquet(f"{path}/in")
    bids = as_bids(came).withColumn("ts", F.col("ts").cast("timestamp"))
    arrived = amounts(filters(bids, config), config).groupBy("auction_id", window(config).alias("w")).agg(F.count("*").alias("arrived"))
    met = arrived.join(let_in, ["auction_id", "w"], "left").withColumn("late", F.col("arrived") - F.coalesce("n", F.lit(0)))
    return met.select("auction_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "arrived", "late")
