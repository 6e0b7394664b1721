"""Streams over many files: reports of all batches, state by key over batches and restarts, snapshots that merge."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillflow.config import PipelineConfig
from rillflow.operators import artifacts, decisions, latency, pipeline
from rillflow.sources.bids import EVENTS, as_bids, bid_stream
from rillflow.streaming import progress, state, stats

T0 = dt.datetime(2024, 1, 1)


def write(spark, rows, path):
    """A file for each list of events, one after the other."""
    for part in rows:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def test_no_batch_is_lost_beyond_what_spark_keeps(spark, tmp_path):
    spark.range(1000).select(
        F.col("id").alias("event_id"), F.lit(T0).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("e").alias("event_type"), F.lit(200.0).alias("value"), F.lit("").alias("props")
    ).repartition(103, "event_id").write.option("maxRecordsPerFile", 9).parquet(str(tmp_path / "in"))
    stream = bid_stream(spark, f"{tmp_path}/in/")  # a slash at the end
    seen = stats.observed(stream, "passed", {"n": F.count("*"), "most": F.max("event_id"), "mean": F.avg("price")}, str(tmp_path / "out"))
    assert len(seen) > 100 and sum(r["n"] for r in seen) == 1000 and max(r["most"] for r in seen) == 999 and {r["mean"] for r in seen} == {200.0}
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 1000


def test_counters_of_a_running_source(spark, tmp_path):
    event = lambda i, s, p=200.0: (i, T0 + dt.timedelta(seconds=s), 1, "e", p, "")
    write(spark, [[event(0, 1), event(1, 60), event(2, 60, 50.0)], [event(3, 61)], [event(4, 3), event(5, 4), event(6, 62), event(7, 5, 50.0)]], tmp_path / "in")
    got = stats.counted(bid_stream(spark, str(tmp_path / "in")), PipelineConfig(), str(tmp_path / "out")).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 3, 2, 0), (1, 1, 1, 0), (2, 4, 3, 1)]


def test_paths_that_look_like_patterns(spark, tmp_path):
    for name in ("a[1]", "b{x}", "plain"):
        write(spark, [[(1, T0, 1, "e", 1.0, "")]], tmp_path / name)
        rows = stats.observed(bid_stream(spark, str(tmp_path / name)), "o", {"n": F.count("*")}, str(tmp_path / f"out-{len(name)}-{name[0]}"))
        assert rows == [{"n": 1}], name


def test_reports_raise_what_fails(spark, tmp_path):
    write(spark, [[(1, T0, 1, "e", 1.0, "")]], tmp_path / "in")
    bad = bid_stream(spark, str(tmp_path / "in")).withColumn("bad", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        progress.followed(spark, lambda name: bad.writeStream.queryName(name).format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")), str(tmp_path / "r"))


def test_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    draw = random.Random(8)
    events = [(i, T0 + dt.timedelta(seconds=i // 3), draw.choice([1, 1, 1, 2, 3]), draw.choice(["a", "b", "n"]), float(draw.randrange(1, 400)) + 0.1, "") for i in range(600)]
    parts = [events[k : k + 120] for k in range(0, 600, 120)]
    for part in parts:
        draw.shuffle(part)
    config, folder = PipelineConfig(high_value=False), str(tmp_path / "in")

    def ticks(bids):
        return bids.select(F.nullif("event_type", F.lit("n")).alias("run"), F.col("event_id").alias("seq"), "ts", F.least(F.lit(100.0), "price").alias("cpu"))

    for some in (parts[:3], parts[3:], []):  # the stream is started three times, the last time with nothing new
        write(spark, some, folder)
        sums = state.to_files(state.running_rows(pipeline.amounts(bid_stream(spark, folder), config)), str(tmp_path / "sums"))
        changes = state.to_files(state.cooldown_changes(ticks(bid_stream(spark, folder)), 20), str(tmp_path / "changes"))
    table = as_bids(spark.createDataFrame(events, EVENTS))
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(sums) == order(pipeline.running_sum(pipeline.amounts(table, config))) and sums.count() == 600
    want = order(decisions.regime_cooldown(ticks(table), 20))
    assert order(changes) == want and len(want) > 15 and any(r[0] is None for r in want)


def test_snapshots_of_a_stream(spark, tmp_path):
    draw = random.Random(3)
    parts = [[(1000 * k + i, T0, 1, "e", float(draw.randrange(1, 10_000)), "") for i in range(700)] for k in range(3)]
    write(spark, parts, tmp_path / "in")
    got = stats.to_snapshots(bid_stream(spark, str(tmp_path / "in")), F.col("price").cast("long"), str(tmp_path / "out")).orderBy("batch").collect()
    for k, r in enumerate(got):
        known = sorted(int(e[4]) for part in parts[: k + 1] for e in part)
        assert (r.n_rows, r.sum_ms, r.min_ms, r.max_ms) == (len(known), sum(known), known[0], known[-1])
        assert abs(sum(v <= r.p95 for v in known) / len(known) - 0.95) < 0.012
    assert len(got) == 3


def test_means_of_logs_round_halves_to_even(spark):
    # fixed value: the format of a tracker's last line
    line = lambda v, n: f"[Latency-0] FINAL count={n} min=1ms p50={v}ms p95={v}ms p99={v}ms max=9ms avg={v}ms"
    rows = spark.createDataFrame([("a", line("7.0", 1)), ("a", line("7.5", 1)), ("b", line("7.0", 3)), ("b", line("7.2", 1))], "run string, line string")
    assert [(r.run, r.p50, r.avg, r.weighted_avg) for r in artifacts.latency_log(rows).orderBy("run").collect()] == [("a", 7, 7.2, 7.2), ("b", 7, 7.1, 7.0)]
    assert latency.reservoir(rows, "run", "line", 1).count() == 2
