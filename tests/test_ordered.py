"""Running sums and previous values against plain loops, with a group that spans partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import cooldown, decisions, latency, ordered

T0 = dt.datetime(2024, 1, 1)


def steps():
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.7 else draw.choice(["a", "b", None]), i, draw.randrange(3), draw.random() * 100) for i in range(800)]
    draw.shuffle(rows)
    return rows


@pytest.fixture(autouse=True)
def spread(spark):
    """Small partitions stay apart, so that groups span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_and_previous(spark):
    rows = steps()
    df = spark.createDataFrame(rows, "run string, seq long, node int, cpu double")
    got = {r.seq: r for r in ordered.running(df, ["run"], "seq", {"n": F.lit(1), "s": F.col("node")}).collect()}
    was = {r.seq: r.p for r in ordered.previous(df, ["run"], "seq", "node", "p").collect()}
    assert ordered.dealt(df, ["run"], "seq").where("run = 'hot'").select("_part").distinct().count() > 1
    assert len(got) == len(was) == len(rows)
    seen, last = {}, {}
    for run, seq, node, _ in sorted(rows, key=lambda r: r[1]):
        n, s = seen.get(run, (0, 0))
        assert (got[seq].n, got[seq].s, was[seq]) == (n, s, last.get(run))
        seen[run], last[run] = (n + 1, s + node), node
    assert ordered.running(df.limit(0), ["run"], "seq", {"n": F.lit(1)}).count() == ordered.previous(df.limit(0), ["run"], "seq", "node", "p").count() == 0


def test_every_arm_is_scored_at_every_step(spark):
    rows = [(r, s, n, 0.5) for r, s, n, _ in steps() if r]
    got = {(r.run, r.seq, r.node): r for r in decisions.ucb_scores(spark.createDataFrame(rows, "run string, seq long, node int, reward double")).collect()}
    assert len(got) == 3 * len(rows)
    tried = {}
    for run, seq, node, _ in sorted(rows, key=lambda r: r[1]):
        counts = [tried.get((run, k), 0) for k in range(3)]
        for k in range(3):
            r = got[run, seq, k]
            assert (r.tried, r.chosen, r.phase) == (counts[k], k == node, "EXPLORATION" if min(counts) < 2 else "EXPLOITATION")
            assert (r.bound > 1e300) == (counts[k] == 0)
        tried[run, node] = tried.get((run, node), 0) + 1


def test_rows_of_one_step_share_its_phase(spark):
    """Three rows a step: the first steps choose arm 0, the next arm 1; the phase is that of the selections before the step."""
    rows = [(run, seq, node, 0.5) for run in ("a", None) for seq, node in enumerate((0, 1, 0, 1)) for _ in range(3)]
    got = decisions.ucb_scores(spark.createDataFrame(rows, "run string, seq long, node int, reward double").repartition(5)).collect()
    assert {(r.run, r.seq): r.phase for r in got} == {(run, seq): "EXPLORATION" if seq < 2 else "EXPLOITATION" for run in ("a", None) for seq in range(4)}
    assert len({(r.run, r.seq, r.phase) for r in got}) == 8
    assert sorted(r.tried for r in got if r.run == "a" and r.node == 0 and r.chosen) == [0, 1, 2, 3, 4, 5]


def test_cooldown_against_a_loop(spark):
    rows = [(run, s, T0 + dt.timedelta(seconds=random.Random(s).randrange(3000)), cpu) for run, s, _, cpu in steps() if run]
    got = {(r.run, r.seq): (r.from_regime, r.to_regime) for r in decisions.regime_cooldown(spark.createDataFrame(rows, "run string, seq long, ts timestamp_ntz, cpu double"), 300).collect()}
    want, state = {}, {}
    for run, seq, ts, cpu in sorted(rows, key=lambda r: r[1]):
        now = "BANDIT" if cpu > 60 else "LEAST_LOADED" if cpu > 30 else "FCFS"
        current, changed = state.get(run, (now, None))
        if now != current and (changed is None or (ts - changed).total_seconds() >= 300):
            want[run, seq], changed, current = (current, now), ts, now
        state[run] = current, changed
    assert got == want and len(want) > 10
    assert decisions.choose("FCFS", spark.createDataFrame([(1, "n", 0, 1.0)], "tick int, node string, ord int, cpu_pct double")).first().node == "n"


def by_loop(rows, wait):
    """Accepted changes of (run, seq, ts, cpu) by a plain loop over each run."""
    want, state = {}, {}
    for run, seq, ts, cpu in sorted(rows, key=lambda r: r[1]):
        now = "BANDIT" if cpu > 60 else "LEAST_LOADED" if cpu > 30 else "FCFS"
        current, changed = state.get(run, (now, None))
        if now != current and (changed is None or (ts - changed).total_seconds() >= wait):
            want[run, seq], changed, current = (current, now), ts, now
        state[run] = current, changed
    return want


@pytest.mark.parametrize("wait,kind", [(0, "string"), (5000, "date")])
def test_cooldown_of_runs_that_span_all_parts(spark, wait, kind):
    """One run holds all rows or most, times go forth and back, and long stretches are of one regime."""
    draw = random.Random(wait)
    key = {"string": lambda k: f"r{k}", "int": lambda k: k, "date": lambda k: dt.date(2024, 1, 1 + k)}[kind]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for runs in (1, 4):
            rows, cpu = [], 10.0
            for i in range(1200):
                cpu = draw.random() * 100 if draw.random() < (0.5 if wait < 1000 else 0.004) else cpu
                run = None if runs > 1 and i % 7 == 3 else key(0 if draw.random() < 0.8 else draw.randrange(runs))
                rows.append((run, i, T0 + dt.timedelta(seconds=3 * i + draw.randrange(-50, 50)), cpu))
            df = spark.createDataFrame(rows, f"run {kind}, seq int, ts timestamp_ntz, cpu double").repartition(3)
            found = decisions.regime_cooldown(df, wait)
            got = {(r.run, r.seq): (r.from_regime, r.to_regime) for r in found.collect()}
            assert got == by_loop(rows, wait) and got
        parts = cooldown._linked(df.select("run", F.col("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit("k").alias("kind")), 0)
        assert parts.select("part").distinct().count() >= 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    none = spark.createDataFrame([("a", None, T0, 1.0), ("a", 1, None, 99.0), ("a", 2, T0, None), ("b", 1, T0, 1.0)], "run string, seq int, ts timestamp_ntz, cpu double")
    assert decisions.regime_cooldown(none, wait).count() == 0 == decisions.regime_cooldown(df.limit(0), wait).count()


def test_null_runs_are_scored(spark):
    rows = [(None, 1, 0, 0.5), ("a", 1, 0, 0.5), (None, 2, 1, 1.0), (None, 3, None, None), (None, 4, 0, 0.25)]
    got = decisions.ucb_scores(spark.createDataFrame(rows, "run string, seq long, node int, reward double"))
    assert {(r.run, r.seq, r.node): (r.chosen, r.tried) for r in got.collect()} == {
        ("a", 1, 0): (True, 0), (None, 1, 0): (True, 0), (None, 1, 1): (False, 0), (None, 2, 0): (False, 1), (None, 2, 1): (True, 0), (None, 3, 0): (False, 1), (None, 3, 1): (False, 1),
        (None, 4, 0): (True, 1), (None, 4, 1): (False, 1),
    }
    assert decisions.ucb_scores(got.select("run", "seq", "node", F.lit(1.0).alias("reward")).limit(0)).count() == 0


def test_source_counters(spark):
    rows = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in (0, 1, 2, 11, 12, 13, 14)], "ts timestamp_ntz")
    got = [tuple(r)[1:] for r in latency.counters(rows, "10 seconds", 10, 3).orderBy("interval_start").collect()]
    assert got == [(3, 3, 0, 0.3, 0.3, 0.0, 0.0), (7, 6, 1, 0.4, 0.3, 0.1, 14.285714)]
