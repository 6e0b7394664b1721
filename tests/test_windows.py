"""Windows by panes, sessions by parts, percentiles by selection and sketches, against Spark's own windows and plain sorting."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillflow.config import AGGREGATES, PipelineConfig
from rillflow.operators import latency, pipeline, sketches, windows
from rillflow.operators.ordered import dealt

T0 = dt.datetime(2024, 1, 1)


def amounts(spark, keys, n=3000, span=20_000, seed=2):
    draw = random.Random(seed)
    rows = [(draw.choice(keys), draw.choice([None, draw.random() * 900, float(draw.randrange(5))]), T0 + dt.timedelta(seconds=draw.randrange(span) // 7 * 7), i) for i in range(n)]
    return spark.createDataFrame(rows, "auction_id long, amount double, ts timestamp_ntz, event_id long").repartition(3)


@pytest.fixture(autouse=True)
def spread(spark):
    """Small partitions stay apart, so that keys span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def built_in(rows, config):
    found = rows.groupBy("auction_id", pipeline.window(config).alias("w")).agg(pipeline.aggregate(config.aggregate))
    return {(r.auction_id, r.w.start, r.w.end): r.value for r in found.collect()}


def by_us(rows, config):
    found = pipeline.windowed(rows, config).collect()
    out = {(r.auction_id, r.window_start, r.window_end): r.value for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("keys", [[7], [7, 7, 7, 7, 1, 2, None]])
def test_sessions_by_parts_equal_spark_sessions(spark, keys):
    rows = amounts(spark, keys)
    for gap, aggregate in zip(("14 seconds", "21 seconds", "1 second", "2 hours", "49 seconds"), AGGREGATES, strict=True):
        config = PipelineConfig(window="session", aggregate=aggregate, gap=gap, hot_keys=True)
        assert by_us(rows, config) == built_in(rows, config), gap
    spanned = dealt(rows, ["auction_id"], "ts").where("auction_id = 7").select("_part").distinct().count()
    assert spanned == 4 if len(keys) == 1 else spanned > 1  # a key with all rows is in all tasks
    assert by_us(rows.limit(0), config) == {}


def test_panes_equal_spark_windows(spark):
    rows = amounts(spark, [1, 1, 1, 2, None], span=4000)
    for (size, slide), aggregate in zip((("60 seconds", "1 second"), ("10 seconds", "4 seconds"), ("10 seconds", "10 seconds"), ("3 seconds", "7 seconds"), ("1 minute 30 seconds", "20 seconds")), AGGREGATES, strict=True):
        config = PipelineConfig(window="sliding", aggregate=aggregate, size=size, slide=slide)
        if windows.micros(slide) <= windows.micros(size):
            assert by_us(rows, config) == built_in(rows, config), size
        else:  # gaps between windows: rows in them are in none
            at = lambda r: (r.ts - dt.datetime(1970, 1, 1)).total_seconds()
            assert {k[0::1][:2] for k in by_us(rows, config)} == {(r.auction_id, r.ts - dt.timedelta(seconds=at(r) % 7)) for r in rows.collect() if at(r) % 7 < 3}
    assert by_us(rows.limit(0), config) == {}
    # rows that are dealt out are the panes of a key, not rows times windows
    panes = windows.sliding(rows, "60 seconds", "1 second")._jdf.queryExecution().executedPlan().toString()
    assert panes.index("Generate explode") < panes.index("REPARTITION_BY_COL") and panes.count("Exchange hashpartitioning") == 2
    for bad in ("5", "1 month", "seconds", "5 seconds ago"):
        with pytest.raises(ValueError):
            windows.micros(bad)


def test_percentiles_of_one_group_of_distinct_values(spark):
    draw = random.Random(4)
    values = {"all": [draw.random() * 1e6 for _ in range(4000)], None: [3.0, 3.0, -1.0], "few": [2.0, 1.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("all", None), ("none", -2.0)], "g string, ms double").repartition(5)
    got = {r.g: r for r in latency.percentiles(rows, "g", "ms").collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        known = sorted(v for v in vs if v >= 0)
        assert (got[g].n_rows, got[g].min_ms, got[g].max_ms) == (len(known), known[0], known[-1])
        assert [got[g].p50, got[g].p95, got[g].p99] == [known[min(len(known) - 1, int(len(known) * p))] for p in (0.5, 0.95, 0.99)]
    assert latency.percentiles(rows.limit(0), "g", "ms").count() == 0


def test_snapshots_of_many_values_are_exact(spark, tmp_path):
    """More distinct values than a sketch of 4,096 holds, days without rows of a group, values below 0, rows without a type."""
    draw = random.Random(6)
    rows = [(i, T0 + dt.timedelta(days=draw.choice((0, 1, 2, 4))), 1, draw.choice(("a", "a", "a", "b")), draw.randrange(-1000, 40_000) / 100) for i in range(9000)]
    rows += [(9000, T0, 1, None, 1.0), (9001, T0 + dt.timedelta(days=3), 1, "few", 5.0), (9002, T0 + dt.timedelta(days=9), 1, "few", 3.0)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    df = spark.createDataFrame(rows, schema).repartition(5)
    df.withColumn("props", F.lit("")).write.parquet(str(tmp_path / "events.parquet"))
    queries = pytest.importorskip("rillflow.plans.catalogue").QUERIES
    got = queries["latency_snapshots_p"](spark, str(tmp_path)).collect()
    assert len(got) == 10
    for r in got:
        known = sorted(round(v * 100) for _, ts, _, g, v in rows if g == r.event_type and ts < r.snapshot_at)
        assert (r.n_rows, r.min_ms, r.max_ms, r.sum_ms, r.avg_ms) == (len(known), known[0], known[-1], sum(known), sum(known) / len(known))
        assert [r.p50, r.p95, r.p99] == [known[min(len(known) - 1, int(len(known) * p))] for p in (0.5, 0.95, 0.99)]
    unnamed = latency.snapshot_percentiles(df.select("event_type", "ts", F.col("event_id").alias("ms")), "1 day", "event_type", "ms")
    assert unnamed.where("event_type is null").select("n_rows", "p50").collect() == [(1, 9000)]
    assert latency.snapshot_percentiles(df.limit(0).withColumn("ms", F.lit(1)), "1 day", "event_type", "ms").count() == 0


def test_snapshots_are_within_their_rank_error(spark):
    draw = random.Random(5)
    rows = [(g, T0 + dt.timedelta(seconds=draw.randrange(60)), int(draw.lognormvariate(6, 2))) for g in ("a", "b") for _ in range(40_000)]
    rows += [("a", T0, -5), ("a", T0, None), ("few", T0, 1), ("few", T0 + dt.timedelta(seconds=59), 9)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, ms long").repartition(6)
    found = sketches.snapshots(df, "10 seconds", "g", "ms").collect()
    assert len(found) == 14
    for r in found:
        known = sorted(ms for g, ts, ms in rows if g == r.g and ts < r.snapshot_at and ms is not None and ms >= 0)
        assert (r.n_rows, r.sum_ms, r.min_ms, r.max_ms, r.avg_ms) == (len(known), sum(known), known[0], known[-1], sum(known) / len(known))
        for p in (0.5, 0.95, 0.99):
            value, n = r[f"p{round(p * 100)}"], len(known)
            low, high = sum(v < value for v in known) / n, sum(v <= value for v in known) / n
            assert low - 2 * sketches.ERROR <= p <= high + 2 * sketches.ERROR, (r, p)
            if n < 3:
                assert value == known[min(n - 1, int(n * p))]
    # sketches of parts and of all tell the same within the error
    parts = sketches.sketched(df, ["g", F.col("ms") % 3], "ms").drop("(ms % 3)")
    whole = {r.g: r for r in sketches.merged(parts, ["g"]).select("g", "n_rows", *sketches.percentiles("sketch", shares=(0.25,))).collect()}
    known = sorted(ms for g, _, ms in rows if g == "b")
    assert whole["b"].n_rows == 40_000 and abs(sum(v <= whole["b"].p25 for v in known) / 40_000 - 0.25) < 2 * sketches.ERROR + 0.001
    assert sketches.snapshots(df.limit(0), "10 seconds", "g", "ms").count() == 0
