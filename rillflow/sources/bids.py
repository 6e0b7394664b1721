"""Bids as a table or a stream, replayed template pools and arrival profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from .paths import literal

SENT = 100_000
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def as_bids(events: DataFrame) -> DataFrame:
    bids = events.select(
        F.col("user_id").alias("auction_id"), (F.col("event_id") % 10000).alias("bidder_id"), F.col("value").alias("price"), "ts", "event_id", "event_type"
    )
    return bids.where("auction_id is not null and price is not null and ts is not null")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as bids; rows without key, price or time are left out."""
    return as_bids(spark.read.parquet(f"{sf_dir}/events.parquet"))


def bid_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """The same as a stream of files. Event time needs an instant, so ts is read in the session's zone."""
    # as a pattern, the path may be a file or a folder of files; a plain path must be a folder
    last, path = path.rstrip("/")[-1], literal(path)
    path = path if path.endswith(f"\\{last}") else f"{path[:-1]}[{last}]"
    reader = spark.readStream.schema(EVENTS)
    events = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
    return as_bids(events).withColumn("ts", F.col("ts").cast("timestamp"))


def pool_replay(rows: DataFrame, pool: int = 10_000) -> DataFrame:
    """The bid of each row (id): pool[id % pool]. The pool is `pool` rows of arithmetic; up to SENT of them are broadcast."""
    k = F.col("k")
    made = rows.sparkSession.range(pool).toDF("k").select(
        "k", (k * 7919 % 1000).alias("auction_id"), (k * 104729 % 10000).alias("bidder_id"), ((k * 15485863 % 99000 + 1000) / 100).alias("price")
    )
    made = F.broadcast(made) if pool <= SENT else made
    return rows.select("id").withColumn("k", F.pmod("id", F.lit(pool))).join(made, "k").select("id", "auction_id", "bidder_id", "price")


def rate(config: PipelineConfig, t: Column) -> Column:
    """Events a second at second t. Step and sine are at least 1; fractions are cut."""
    base, duration = config.rate, config.duration
    if config.profile == "constant":
        return F.lit(base)
    if config.profile == "step":
        middle = (t >= int(duration * config.step_from)) & (t < int(duration * config.step_to))
        value = F.when(middle, F.lit(int(base * config.step_high))).otherwise(F.lit(int(base * config.step_low)))
    else:
        value = (base * (1 + config.sine_amplitude * F.sin(2 * math.pi * t / float(config.sine_period)))).cast("int")
    return F.greatest(F.lit(1), value)


def rate_profile(spark: SparkSession, config: PipelineConfig) -> DataFrame:
    return spark.range(config.duration).select(F.col("id").cast("int").alias("t"), rate(config, F.col("id")).alias("target_rate"))


def peak_rate(config: PipelineConfig) -> int:
    """The most that a profile asks for in a second."""
    return int(config.rate * {"constant": 1.0, "step": config.step_high, "sine": 1 + config.sine_amplitude}[config.profile])


def rate_plan(rates: DataFrame, config: PipelineConfig, instances: int) -> DataFrame:
    """Each instance's rate and batch size by second, and its queue, which holds two seconds of the profile's peak."""
    each = F.greatest(F.lit(1), F.floor(F.col("target_rate") / instances).cast("int"))
    capacity = 2 * max(1, peak_rate(config) // instances)
    planned = rates.withColumn("instance_rate", each).withColumn("batch_size", F.greatest(F.lit(1), F.floor(each / 50).cast("int")))
    return planned.withColumn("capacity", F.lit(capacity))
