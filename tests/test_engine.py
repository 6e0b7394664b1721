"""Edge rows of the bid pipeline, the record parsers and the streaming jobs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rillflow.config import PipelineConfig
from rillflow.functions import quantities, scores
from rillflow.operators import artifacts, decisions, latency, pipeline
from rillflow.sources.bids import peak_rate, pool_replay, rate_plan, rate_profile
from rillflow.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def bids(spark, rows):
    made = [(a, b, float(p), T0 + dt.timedelta(seconds=s), i) for i, (a, b, p, s) in enumerate(rows)]
    return spark.createDataFrame(made, "auction_id long, bidder_id long, price double, ts timestamp_ntz, event_id long")


def test_filters_are_strict_and_leave_nan_out(spark):
    rows = bids(spark, [(1, 1, 100.0, 0), (1, 1, 100.01, 0), (1, 1, math.nan, 0), (499, 4999, 200, 0), (500, 4999, 200, 0), (499, 5000, 200, 0)])
    assert pipeline.filters(rows, PipelineConfig()).count() == 4
    assert pipeline.filters(rows, PipelineConfig(auction_range=True, bidder_range=True)).count() == 2
    with pytest.raises(ValueError):
        PipelineConfig(window="hopping")
    with pytest.raises(ValueError):
        pipeline.aggregate("median")


def test_sessions_merge_at_the_gap_and_windows_hold_their_start(spark):
    rows = bids(spark, [(1, 1, 200, 0), (1, 1, 200, 30), (1, 1, 200, 61), (1, 1, 200, 10)])
    config = PipelineConfig(window="session", aggregate="count", to_eur=False)
    assert sorted(r.value for r in pipeline.pipeline(rows, config).collect()) == [1.0, 3.0]
    tumbling = pipeline.pipeline(rows, PipelineConfig(aggregate="sum", to_eur=False)).collect()
    assert {(r.window_start - T0).seconds for r in tumbling} == {0, 10, 30, 60}
    assert pipeline.pipeline(rows, PipelineConfig(window="sliding", aggregate="count")).count() == 8
    assert pipeline.pipeline(rows.limit(0), config).count() == 0


def test_percentile_rule(spark):
    rows = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").alias("ms")).unionAll(spark.createDataFrame([("g", -5)], "g string, ms long"))
    r = latency.percentiles(rows, "g", "ms").first()
    assert (r.n_rows, r.min_ms, r.p50, r.p95, r.p99, r.max_ms, r.sum_ms, r.avg_ms) == (100, 1, 51, 96, 100, 100, 5050, 50.5)


def test_profiles(spark):
    rates = {p: {r.t: r.target_rate for r in rate_profile(spark, PipelineConfig(profile=p)).collect()} for p in ("constant", "step", "sine")}
    assert set(rates["constant"].values()) == {50_000}
    assert [rates["step"][t] for t in (98, 99, 197, 198)] == [12_500, 75_000, 75_000, 12_500]
    assert (rates["sine"][0], rates["sine"][15]) == (50_000, 85_000)
    assert pool_replay(spark.range(25), 10).count() == 25 and pool_replay(spark.range(25), 10).select("price").distinct().count() == 10
    assert [peak_rate(PipelineConfig(profile=p)) for p in ("constant", "step", "sine")] == [50_000, 75_000, 85_000]
    planned = rate_plan(rate_profile(spark, PipelineConfig(profile="step")), PipelineConfig(profile="step"), 4).where("t = 0").first()
    assert (planned.instance_rate, planned.batch_size, planned.capacity) == (3125, 62, 37500)


def test_quantities_rewards_and_regimes(spark):
    texts = spark.createDataFrame([("2387m",), ("2",), ("250000000n",), ("",), ("x",), (None,)], "q string")
    assert [r[0] for r in texts.select(quantities.millicores(F.col("q"))).collect()] == [2387.0, 2000.0, 250.0, 0.0, 0.0, 0.0]
    sizes = spark.createDataFrame([("1943Mi",), ("12",), ("",), ("xKi",)], "q string")
    assert [r[0] for r in sizes.select(quantities.memory_bytes(F.col("q"))).collect()] == [2037383168, 12, 0, 0]
    cpu = spark.createDataFrame([(0.0,), (30.0,), (70.0,), (80.0,), (90.0,), (90.01,), (60.0,)], "c double")
    got = cpu.select(scores.reward(F.col("c")).alias("r"), scores.regime(F.col("c")).alias("g")).collect()
    assert [round(r.r, 6) for r in got] == [0.5, 1.0, 1.0, 0.75, 0.5, 0.2, 1.0]
    assert got[1].g == "FCFS" and got[6].g == "LEAST_LOADED"


def test_cooldown(spark):
    rows = [("a", i, T0 + dt.timedelta(seconds=10 * i), c) for i, c in enumerate([10.0, 90.0, 10.0, 10.0, 10.0, 50.0])]
    got = decisions.regime_cooldown(spark.createDataFrame(rows, "run string, seq long, ts timestamp_ntz, cpu double"), 30).orderBy("seq").collect()
    assert [(r.seq, r.from_regime, r.to_regime) for r in got] == [(1, "FCFS", "BANDIT"), (4, "BANDIT", "FCFS")]


def test_broken_csv_and_logs(spark):
    head = ",".join(f"c{i}" for i in range(27))
    values = [str(100 + i) for i in range(25)]
    text = head + "\ns,w," + ",".join(values[:17]) + "\n" + ",".join([values[16], *values[17:]]) + "\n"
    r = artifacts.repair_csv(spark.createDataFrame([("r", text)], "run string, text string")).first()
    assert len(r["names"]) == 27 and r["values"] == ["s", "w", *values]
    # fixed value: the format of a source's last line
    line = "[Source-7] FINALIZADO en 12.5s: generated=1,234,567, emitted=1,200,000, dropped=34,567 (2.8%)"
    assert artifacts.source_log(spark.createDataFrame([("r", line)], "run string, line string")).first()[1:] == (1234567, 1200000, 34567, 2.79)
    # fixed values: the formats of the schedulers' lines, here with figures of our own
    td = "[SARSA] [UPDATE] s=MED_LOW a=3 r=0.75 s'=LOW_LOW a'=0  Q: 0.2500 -> 0.3125"
    assert artifacts.td_log(spark.createDataFrame([("r", td)], "run string, line string")).first()[1:] == ("MED_LOW", 3, 0.75, 0.25, 0.3125)
    block = "cut off\n[SCHEDULING] Pod: p1\n  Strategy: FCFS\n  Result: ✓ SCHEDULED to n2\n  Node CPU: 12.5% (real)\n[SCHEDULING] Pod: p2\n  Strategy: FCFS\n"
    got = artifacts.decisions(spark.createDataFrame([("r", block)], "run string, text string")).collect()
    assert [(r.pod, r.node, r.cpu) for r in got] == [("p1", "n2", 12.5), ("p2", None, None)]
    # fixed value: the format of run names
    name = "Nexmark-Config[rate=70k,par=6,win=TUM-30s,cpu=300,dist=STEP]"
    assert spark.createDataFrame([(name,)], "n string").select(artifacts.job_name(F.col("n"))["dist"]).first()[0] == "STEP"


def test_stream_drops_late_rows_and_equals_batch_before_the_watermark(spark, tmp_path):
    for k, seconds in enumerate(([1, 5, 12, 27], [60], [3, 61])):
        made = [(100 * k + i, T0 + dt.timedelta(seconds=s), 1, "e", 200.0, "") for i, s in enumerate(seconds)]
        spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = jobs.windows_of_files(spark, str(tmp_path / "in"), PipelineConfig(aggregate="count")).collect()
    assert {(r.window_start - T0).seconds: r.value for r in got} == {0: 2.0, 10: 1.0, 20: 1.0}
    totals = jobs.running_totals(spark, str(tmp_path / "in"), PipelineConfig(to_eur=False)).collect()
    assert [(r.auction_id, r.total) for r in totals] == [(1, 1400.0)]
