"""The registered queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import bids as source

QUERIES: dict = {}
SQL: dict[str, str] = {}

BIDS = """bids AS (
  SELECT user_id AS auction_id, event_id % 10000 AS bidder_id, value AS price, ts, event_id, event_type
  FROM events
  WHERE user_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL)"""


def query(name: str, sql: str | None = None, bids: str = BIDS):
    """Registers a function of (spark, sf_dir); sql, if any, follows the tables named in bids."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {bids} {sql}" if bids else sql
        return f

    return register


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.bids(spark, sf_dir)
