"""Filters, conversion and keyed windows of the bid pipeline, for static and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PipelineConfig
from . import windows
from .ordered import running


def high_value(bids: DataFrame, price: float = 100.0) -> DataFrame:
    """Spark puts NaN above all numbers; a bid of NaN isn't high."""
    return bids.where((F.col("price") > price) & ~F.isnan("price"))


def filters(bids: DataFrame, config: PipelineConfig) -> DataFrame:
    if config.high_value:
        bids = high_value(bids, config.min_price)
    if config.auction_range:
        bids = bids.where(F.col("auction_id") < config.max_auction)
    if config.bidder_range:
        bids = bids.where(F.col("bidder_id") < config.max_bidder)
    return bids


def amounts(bids: DataFrame, config: PipelineConfig) -> DataFrame:
    """auction_id, amount, ts, and event_id where there is one."""
    amount = F.col("price") * config.eur_per_usd if config.to_eur else F.col("price")
    return bids.select("auction_id", amount.alias("amount"), "ts", *(c for c in ("event_id",) if c in bids.columns))


def aggregate(name: str, amount: str = "amount") -> Column:
    """Sums are exact to 5 decimals, so that they don't depend on the order of rows."""
    total = F.sum(F.col(amount).cast("decimal(20,5)")).cast("double")
    known = {"sum": total, "avg": total / F.count(amount), "count": F.count("*").cast("double"), "max": F.max(amount), "min": F.min(amount)}
    if name not in known:
        raise ValueError(f"unknown aggregate {name!r}")
    return known[name].alias("value")


def window(config: PipelineConfig, ts: str = "ts") -> Column:
    if config.window == "session":
        return F.session_window(ts, config.gap)
    return F.window(ts, config.size, config.slide if config.window == "sliding" else None)


def windowed(rows: DataFrame, config: PipelineConfig) -> DataFrame:
    """auction_id, window_start, window_end, value: one shuffle, with partial sums before it.

    Static rows make sliding windows by panes, and sessions, if keys may hold most of the rows, by parts.
    """
    if not rows.isStreaming and (config.window == "sliding" or config.window == "session" and config.hot_keys):
        found = windows.sliding(rows, config.size, config.slide) if config.window == "sliding" else windows.sessions(rows, config.gap)
        return found.select("auction_id", "window_start", "window_end", windows.value(config.aggregate))
    found = rows.groupBy("auction_id", window(config).alias("w")).agg(aggregate(config.aggregate))
    return found.select("auction_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value")


def pipeline(bids: DataFrame, config: PipelineConfig) -> DataFrame:
    return windowed(amounts(filters(bids, config), config), config)


def running_sum(rows: DataFrame) -> DataFrame:
    """The total of a key so far, after each of its rows, by ts and event_id. A key may hold most of the rows."""
    own = rows.select("auction_id", "event_id", F.struct("ts", "event_id").alias("_at"), F.col("amount").cast("decimal(20,5)").alias("_amount"))
    before = running(own, ["auction_id"], "_at", {"_sum": F.col("_amount")})
    return before.select("auction_id", "event_id", (F.col("_sum") + F.coalesce("_amount", F.lit(0))).cast("double").alias("total"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("auction_id").agg(F.sum(F.col("amount").cast("decimal(20,5)")).cast("double").alias("total"))


def stale_split(rows: DataFrame, most_ms: int) -> DataFrame:
    """Rows offered, kept and dropped by age, and the part dropped of those offered."""
    fresh = F.col("age_ms") <= most_ms
    return rows.agg(
        F.count("*").alias("offered"), F.count_if(fresh).alias("kept"), F.count_if(~fresh).alias("stale_dropped"),
        F.round(100.0 * F.count_if(~fresh) / F.count("*"), 2).alias("stale_pct"),
    )
