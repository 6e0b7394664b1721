"""Figures of streams: late rows, what a sink measures, what an operator sees pass, the console."""

import datetime as dt

from pyspark.sql import functions as F

from rillflow.config import PipelineConfig
from rillflow.sources.bids import EVENTS, bid_stream
from rillflow.streaming import jobs, stats

T0 = dt.datetime(2024, 1, 1)


def events(spark, seconds, first=0):
    return spark.createDataFrame([(first + i, T0 + dt.timedelta(seconds=s), 1, "e", 200.0, "") for i, s in enumerate(seconds)], EVENTS)


def test_late_rows_are_counted(spark):
    parts = [events(spark, [1, 5, 12, 27]), events(spark, [60], 10), events(spark, [3, 61, 54, 59, 64], 20)]
    got = {(r.window_start - T0).seconds: (r.arrived, r.late) for r in stats.late_counts(spark, parts, PipelineConfig()).collect()}
    # after 60, windows that end at 55 or before are closed
    assert got == {0: (3, 1), 10: (1, 0), 20: (1, 0), 50: (2, 0), 60: (3, 0)}


def test_sink_and_operator_figures(spark, tmp_path):
    events(spark, [1, 5, 12, 27, 90]).coalesce(1).write.parquet(str(tmp_path / "in"))
    events(spark, [91], 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: bid_stream(spark, str(tmp_path / "in"))
    ms = F.when(F.col("event_id") == 2, -1).otherwise(F.col("event_id") * 10)
    rows = stats.to_statistics(stream(), ms, str(tmp_path / "a")).orderBy("batch").collect()
    assert [tuple(r) for r in rows] == [("all", 5, 4, 0, 40, 80, 0), ("all", 1, 1, 100, 100, 100, 1)]
    seen = stats.observed(stream(), "passed", {"n": F.count("*"), "most": F.max("event_id")}, str(tmp_path / "b"))
    assert seen == [{"n": 5, "most": 4}, {"n": 1, "most": 10}]
    assert spark.read.parquet(str(tmp_path / "b" / "rows")).count() == 6
    assert stats.to_console(stream()).exception() is None
    config = PipelineConfig(aggregate="count")
    windows = stats.to_statistics(jobs.windowed_stream(stream(), config), F.col("value").cast("long"), str(tmp_path / "c"), group="auction_id").collect()
    assert sum(r.n_rows for r in windows) == 3 and sum(r.sum_ms for r in windows) == 4
