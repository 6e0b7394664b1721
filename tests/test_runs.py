"""Files of runs, from a folder tree to rows of metrics and comparison tables; and the settings that name runs."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.config import PipelineConfig
from rillflow.operators import artifacts, compare, latency, metrics, nodes
from rillflow.sources import runs


def job(name, duration, vertices, state="FINISHED"):
    keys = ("read-records", "write-records", "accumulated-backpressured-time", "accumulated-idle-time")
    parts = [{"name": n, "parallelism": 2, "metrics": {k: v for k, v in zip(keys, m, strict=False) if v is not None}} for n, *m in vertices]
    return json.dumps({"jid": "j", "name": name, "state": state, "start-time": 5, "end-time": 9, "duration": duration, "vertices": parts})


@pytest.fixture
def root(tmp_path):
    name = PipelineConfig(rate=70_000, parallelism=6, cpu_load=300, profile="step").run_name()
    files = {
        # a fused vertex belongs to the class that comes first, of two of a class the later one counts, a count may be missing
        ("calm", "A"): {
            runs.JOB_FILE: job(name, 10_019, [("Source: Bid Generator", None, 900), ("Filter: High Value -> CPU Load Simulator -> Latency Tracker", 900, 500), ("Filter: B", 1, 2), ("Sink: Out", 77)]),
            runs.SOURCE_FILE: "noise\n[Source-1] FINALIZADO en 9.0s: generated=1,000, emitted=900, dropped=100 (10.0%)\n[Source-2] FINALIZADO en 9.0s: generated=2,000, emitted=2,000, dropped=0 (0.0%)\n",
            runs.PROCESSING_FILE: "[Latency-PROC-0] count=1 min=1ms p50=99ms p95=1ms p99=1ms max=1ms avg=1.0ms\n[Latency-PROC-0] FINAL count=1 min=1ms p50=1ms p95=4ms p99=5ms max=1ms avg=2.0ms\n[Latency-PROC-1] FINAL count=3 min=1ms p50=2ms p95=5ms p99=5ms max=1ms avg=4.0ms\n",
            runs.PLACEMENT_FILE: "NAME READY STATUS RESTARTS AGE IP NODE NOMINATED\npod-1 1/1 Running 0 1m 10.0.0.1 n1 <none>\npod-2 1/1 Running 0 1m 10.0.0.2 n2 <none>\n\n",
            runs.SCHEDULER_FILE: "[SCHEDULING] Pod: a\n  Strategy: FCFS\n[SCHEDULING] Pod: b\n[STRATEGY SWITCH]\n",
            runs.SUMMARY_FILE: "- Duración: 180 segundos\n- Estado final: FINISHED\n- Duración: 10019 ms\nStrategy switches:    0\n0\n",
        },
        ("calm", "B"): {runs.JOB_FILE: job("other", 0, [], "FAILED")},
    }
    for (workload, strategy), own in files.items():
        folder = tmp_path / "results" / workload / strategy
        folder.mkdir(parents=True)
        for file, text in own.items():
            (folder / file).write_text(text)
    return str(tmp_path / "results")


def test_metrics_rows_of_a_folder_tree(spark, root, tmp_path):
    lines = lambda name: runs.read_lines(spark, root, name)
    rows = metrics.metrics_row(runs.read_jobs(spark, root), *map(lines, (runs.SOURCE_FILE, runs.PROCESSING_FILE, runs.TOTAL_FILE, runs.PLACEMENT_FILE, runs.SCHEDULER_FILE)))
    assert rows.columns == ["run", *metrics.FULL]
    a, b = rows.orderBy("run").collect()
    want = {
        "run": "calm/A", "strategy": "A", "workload": "calm", "distribution": "STEP", "rate": 70_000, "duration_sec": 10.01, "cpu_load": 300, "parallelism": 6,
        "state": "FINISHED", "throughput_processed": 49, "throughput_generated": 299, "throughput_emitted": 289, "processed_events": 500, "total_generated": 3000,
        "total_dropped": 100, "drop_pct": 3.33, "nodes_used": 2, "total_tms": 2, "scheduling_decisions": 2, "strategy_switches": 1, "lat_proc_p50": 2, "lat_proc_p95": 4,
        "lat_proc_p99": 5, "lat_proc_avg": 3.0, "lat_total_p50": None, "lat_total_p95": None, "lat_total_p99": None, "lat_total_avg": None,
    }
    assert a.asDict() == want
    assert (b.state, b.duration_sec, b.throughput_processed, b.processed_events, b.drop_pct, b.rate, b.distribution) == ("FAILED", None, None, 0, None, None, "CONSTANT")
    metrics.write_metrics(rows.drop("run"), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out"))
    assert {(r.workload, r.strategy, r.throughput_processed) for r in back.collect()} == {("calm", "A", 49), ("calm", "B", None)}
    s = metrics.summary(runs.read_texts(spark, root, runs.SUMMARY_FILE)).collect()
    assert [(r.run, r.state, r.duration_ms, r.decisions, r.switches, r.distribution) for r in s] == [("calm/A", "FINISHED", 10019, None, 0, None)]
    sinks = artifacts.by_class(artifacts.vertices(runs.read_jobs(spark, root)))
    assert [(r.sink_in, r.cpu_out, r.filter_out) for r in sinks.collect()] == [(77, 500, 2)]


def test_records_of_every_layout_and_break(spark):
    full, first = ["s", "w", "STEP", *map(str, range(24))], ["s", "j", "FINISHED", *map(str, range(14))]
    broken = lambda v, *at: "".join(x + ("\n0," if i in at else "" if i == len(v) - 1 else ",") for i, x in enumerate(v))
    full[17] = full[18] = first[15] = first[16] = "0"
    cases = [broken(full, 17).replace(",0\n0,", ",0\n0,"), ",".join(full), ",".join(full[:18]) + ",0\n0," + ",".join(full[19:]), ",".join(first) + "\n0", ",".join(first[:16]) + "\n0,0\n0", ",".join([*full, "9", "1", ".5"])]
    text = ",".join(metrics.FULL) + "\n" + "\r\n".join(cases[1:]) + "\nnot,a,record\n\n"
    got = metrics.csv_records(spark.createDataFrame([("r", text), ("none", None), ("empty", "")], "run string, text string")).orderBy("record").collect()
    assert [r.layout for r in got] == ["full", "full", "first", "first", "aged", "unknown"]
    assert all(r.fields == dict(zip(metrics.LAYOUTS[r.layout], [*full, "9", "1", ".5"] if r.layout == "aged" else full if r.layout == "full" else first, strict=True)) for r in got[:5])
    typed = metrics.consolidate_files(spark.createDataFrame([("r", text)], "run string, text string")).where("layout = 'aged'").first()
    assert (typed.stale_pct, typed.job_id, typed.rate) == (0.5, None, 0)


def test_high_load_table_and_its_text(spark, root):
    pods = spark.createDataFrame([("A", "n2", 3), ("A", "n1", 2)], "strategy string, node string, pods long")
    found = compare.high_load(runs.read_jobs(spark, root), pods, ["A", "B", "C"]).orderBy("strategy")
    assert [tuple(r) for r in found.collect()] == [("A", "FINISHED", 89, 10.0, "2 n1 3 n2", "partial"), ("B", "FAILED", None, 0.0, None, None), ("C", "No ejecutado", None, None, None, None)]
    text = compare.markdown(found).split("\n")
    assert len(text) == 5 and text[4] == "| C | No ejecutado | - | - | - | - |"
    with pytest.raises(ValueError):
        compare.markdown(found, 2)


def test_settings_and_names():
    config = PipelineConfig.from_args(["200000", "90", "8", "20", "100", "SINE"])
    assert (config.rate, config.duration, config.parallelism, config.size, config.cpu_load, config.profile) == (200_000, 90, 8, "20 seconds", 100, "sine")
    assert (config.source_parallelism, config.sink_parallelism, PipelineConfig(parallelism=1).source_parallelism) == (4, 2, 1)
    assert PipelineConfig.from_args([]) == PipelineConfig()
    assert config.run_name().endswith("[rate=200k,par=8,win=TUM-20s,cpu=100,dist=SINE]")


def test_approximate_percentiles_stay_within_their_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") * 7919 % 100_003).alias("ms"))
    exact = {r.g: r for r in latency.percentiles(rows, "g", "ms").collect()}
    for r in latency.approximate_percentiles(rows, "g", "ms").collect():
        for p in ("p50", "p95", "p99"):
            assert abs(r[p] - exact[r.g][p]) <= 100_003 / 10_000 * 2  # the values are even, so a rank's error is one of value


def test_node_shares_and_defaults(spark):
    usage = spark.createDataFrame([(1, "a", 500.0), (1, "b", 500.0), (2, "a", 9e9)], "tick int, node string, used double")
    cpu = nodes.node_cpu(usage, spark.createDataFrame([("a", 1000.0)], "node string, millicores double"))
    assert {(r.tick, r.node): r.pct for r in cpu.collect()} == {(1, "a"): 50.0, (1, "b"): 50.0, (2, "a"): 100.0}
    pods = spark.createDataFrame([(1, "a", 2), (1, "c", 2), (1, "d", 50)], "tick int, node string, pods int")
    assert {r.node: r.pct for r in nodes.with_estimates(pods, cpu).collect()} == {"a": 50.0, "c": 31.0, "d": 90.0}
    mean = nodes.cluster_average(spark.createDataFrame([(1,), (2,), (3,)], "tick int"), cpu)
    assert {r.tick: r.pct for r in mean.collect()} == {1: 50.0, 2: 100.0, 3: 50.0}
    memory = nodes.node_memory(spark.createDataFrame([(1, "a", 100), (1, "z", 0)], "tick int, node string, bytes long"), spark.createDataFrame([(1, "a", 25), (1, "z", 5)], "tick int, node string, used long"))
    assert {r.node: r.pct for r in memory.collect()} == {"a": 25.0, "z": 50.0}
