"""Logs split anywhere, runs that arrive and come again, placement by all strategies, and jobs whose settings choose their sinks."""

import datetime as dt
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F
from test_runs import job

from rillflow.config import PipelineConfig
from rillflow.operators import artifacts, decisions, metrics
from rillflow.sources import runs
from rillflow.sources.bids import EVENTS
from rillflow.streaming import arrivals, jobs

T0 = dt.datetime(2024, 1, 1)


def test_blocks_of_logs_that_are_split_anywhere(spark, tmp_path):
    draw, folder = random.Random(2), tmp_path / "logs"
    for run, n in (("a", 900), ("b", 3)):
        text = "  Strategy: LOST\n  To: LOST\n"
        for i in range(n):
            # fixed values: the formats of the scheduler's lines
            text += f"[SCHEDULING] Pod: p{i}\n  Strategy: {draw.choice(['FCFS', 'BANDIT'])}\n" + "  noise\n" * draw.randrange(4)
            text += (f"  Result: ✓ SCHEDULED to n{i % 3}\n" if i % 4 else "") + (f"  Node CPU: {i % 90}.5% (real)\n" if i % 5 else "")
            text += f"[STRATEGY SWITCH]\n  From: FCFS\n  To: S{i}\n  Reason: Cluster CPU = {i % 70}.25%\n  Time: 2025-01-02 03:04:05\n" if i % 3 == 0 else ""
        (folder / "w" / run).mkdir(parents=True)
        (folder / "w" / run / runs.SCHEDULER_FILE).write_text(text)
    texts = runs.read_texts(spark, str(folder), runs.SCHEDULER_FILE)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = runs.read_ordered_lines(spark, str(folder), runs.SCHEDULER_FILE)
        assert lines.rdd.getNumPartitions() > 20
        rows = lambda df: sorted(map(tuple, df.collect()))
        for ours, whole in ((artifacts.decision_lines, artifacts.decisions), (artifacts.switch_lines, artifacts.switches)):
            got, want = ours(lines), whole(texts)
            assert got.columns == want.columns and [str(r) for r in rows(got)] == [str(r) for r in rows(want)]
        assert artifacts.decision_lines(lines).where("strategy = 'LOST'").count() == 0 and artifacts.decision_lines(lines).count() == 903
        assert artifacts.decision_lines(lines.where("line = ''")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def put(root, workload, strategy, number, done, decided):
    """A run's files, its job's under a name of its own."""
    folder = root / workload / strategy
    folder.mkdir(parents=True, exist_ok=True)
    text = json.loads(job(PipelineConfig(rate=30_000, cpu_load=7).run_name(), 1000, [("Source: Bid Generator", None, done)]))
    (folder / f"job-details-{number}.json").write_text(json.dumps({**text, "start-time": number}))
    (folder / runs.SCHEDULER_FILE).write_text("[SCHEDULING] Pod: a\n" * decided)


def test_runs_are_kept_up_to_date(spark, tmp_path):
    root, table, state = tmp_path / "runs", str(tmp_path / "table"), str(tmp_path / "state")
    root.mkdir()
    follow = lambda: arrivals.follow(spark, str(root), table, state, files_per_trigger=2)
    figures = lambda df: {(r.workload, r.strategy): (r.processed_events, r.scheduling_decisions, r.rate) for r in df.collect()}
    assert figures(follow()) == {}
    for k, s in enumerate("ABCDE"):
        put(root, "calm w+[x] %2", s, 1, 100 + k, k)
    first = figures(follow())
    assert first == {("calm w+[x] %2", s): (100 + k, k, 30_000) for k, s in enumerate("ABCDE")}
    put(root, "calm w+[x] %2", "B", 2, 900, 9)
    put(root, "step", "A", 1, 5, 0)
    second = {**first, ("calm w+[x] %2", "B"): (900, 9, 30_000), ("step", "A"): (5, 0, 30_000)}
    assert figures(follow()) == second
    # a batch that was written but not marked as done is written again
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        path.unlink(missing_ok=True)
    assert figures(follow()) == second and figures(follow()) == second
    whole = runs.read_jobs(spark, str(root), arrivals.JOB_FILES).where("not (run = 'calm w+[x] %2/B' and `start-time` = 1)")
    logs = runs.read_lines(spark, str(root), runs.SCHEDULER_FILE)
    none = logs.limit(0)
    assert figures(metrics.metrics_row(whole, none, none, none, none, logs)) == second
    shutil.rmtree(table)
    assert figures(arrivals.follow(spark, str(root), table, str(tmp_path / "anew"))) == second


def test_strategies_of_the_registry(spark):
    load = spark.createDataFrame([(1, "b", 1, 5.0), (1, "a", 0, 9.0), (1, "c", 2, 7.0), (2, "a", 0, 1.0)], "tick int, node string, ord int, cpu_pct double")
    requests = spark.createDataFrame([("r", i, 1, p) for i, p in enumerate(["9", None, "x", "5", "4"])] + [(None, 10, 1, "5"), (None, 11, 2, "1"), ("r", 20, 3, "1")], "run string, seq long, tick int, priority string")
    got = {name: {r.seq: r.node for r in decisions.place(name, load, requests).collect()} for name in decisions.STRATEGIES}
    assert got["FCFS"] == {**dict.fromkeys(range(5), "a"), 10: "a", 11: "a"}
    assert got["LEAST_LOADED"] == {**dict.fromkeys(range(5), "b"), 10: "b", 11: "a"}
    assert got["BALANCED"] == {0: "a", 1: "b", 2: "c", 3: "a", 4: "b", 10: "a", 11: "a"}
    assert got["PRIORITY"] == {0: "b", 1: "a", 2: "a", 3: "b", 4: "a", 10: "b", 11: "a"}
    with pytest.raises(ValueError):
        decisions.place("LUCK", load, requests)


def test_settings_choose_sinks(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=i), 1, "e", 200.0, "") for i in range(60)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda name, **settings: jobs.run(spark, str(tmp_path / "in"), PipelineConfig(aggregate="count", **settings), str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = run("a", file_sink=True, output_path=str(tmp_path / "out"))
    assert found["windows"].count() == found["figures"].agg(F.sum("n_rows")).first()[0] == 5 and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert len(list((tmp_path / "out" / "rows").glob("part-*"))) <= 2 and set(run("b", file_sink=False)) == {"figures"} and run("c", console_sink=False) == {}
    with pytest.raises(ValueError):
        run("d", file_sink=True)
