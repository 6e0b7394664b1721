"""Queries on whole runs and on streams' figures. A run is a user: its files' texts are written from events by Spark and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import artifacts, compare, metrics
from ..operators import pipeline as core
from ..scratch import stored
from ..sources import runs as files
from ..streaming import arrivals, jobs, state, stats
from .queries import AMOUNTS, COOLDOWN_SQL, HOURLY, NAMELESS, NAME_HEAD, USERS, WINDOW_SQL, _jobs, _users
from .registry import query



def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _run() -> Column:
    return _text("w", F.col("user_id") % 3, "/s", F.col("user_id"))


def _lines(users: DataFrame, *lines: Column) -> DataFrame:
    return users.select(_run().alias("run"), F.explode(F.array_compact(F.array(*lines))).alias("line"))


METRICS_SQL = f"""
WITH {USERS},
r AS (
  SELECT *, n * 1000 AS g, hi * 1000 AS e, (n - hi) * 1000 AS d, user_id % 4 <> 0 AS logged, user_id % 5 <> 0 AS timed,
         CASE WHEN hi > 0 THEN hi ELSE n END AS done FROM u)
SELECT 'w' || (user_id % 3) || '/s' || user_id AS run, 's' || user_id AS strategy, 'w' || (user_id % 3) AS workload,
       CASE WHEN user_id % 2 = 0 THEN 'STEP' ELSE 'CONSTANT' END AS distribution, n * 1000 AS rate, (dur // 10) / 100.0e0 AS duration_sec,
       CASE WHEN user_id % 2 = 0 THEN 500::BIGINT END AS cpu_load, hi AS parallelism, 'FINISHED' AS state, done * 1000 // dur AS throughput_processed,
       CASE WHEN logged AND g > 0 THEN g * 1000 // dur END AS throughput_generated, CASE WHEN logged AND g > 0 THEN e * 1000 // dur END AS throughput_emitted,
       done AS processed_events, CASE WHEN logged THEN g ELSE 0 END AS total_generated, CASE WHEN logged THEN d ELSE 0 END AS total_dropped,
       CASE WHEN logged AND g > 0 THEN (d * 10000 // g) / 100.0e0 END AS drop_pct,
       len(list_distinct(['n' || (n % 3), 'n' || (hi % 3), 'n0'])) AS nodes_used, 3::BIGINT AS total_tms, 2::BIGINT AS scheduling_decisions, hi % 2 AS strategy_switches,
       CAST(round_even((n + n + 1) / 2.0e0, 0) AS BIGINT) AS lat_proc_p50, CAST(round_even((n + hi) / 2.0e0, 0) AS BIGINT) AS lat_proc_p95, n AS lat_proc_p99,
       round_even(n + 0.25e0, 1) AS lat_proc_avg, CASE WHEN timed THEN n END AS lat_total_p50, CASE WHEN timed THEN n + 5 END AS lat_total_p95,
       CASE WHEN timed THEN n + 9 END AS lat_total_p99, CASE WHEN timed THEN n + 0.0e0 END AS lat_total_avg
FROM r"""


@query("metrics_row", METRICS_SQL, "")
def metrics_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = stored(_users(spark, sf_dir))
    name = _text(f"{NAME_HEAD}[rate=", F.col("n"), "k,par=", F.col("hi"), ",win=TUM-10s", F.when(F.col("user_id") % 2 == 0, ",cpu=500,dist=STEP").otherwise(""), "]")
    made = _jobs(spark, sf_dir, users, name).withColumn("user_id", F.col("jid").cast("long"))
    own = made.withColumns({"run": _run(), "workload": _text("w", F.col("user_id") % 3), "strategy": _text("s", F.col("user_id"))})
    thousands = lambda c: F.format_number(c * 1000, 0)
    source = _lines(
        users.where("user_id % 4 <> 0"), _text("[Source-1] t=10s target=1k/s gen=", thousands(F.col("n"))),
        _text("[Source-1] FINALIZADO en 90.1s: generated=", thousands(F.col("n")), ", emitted=", thousands(F.col("hi")), ", dropped=", thousands(F.col("n") - F.col("hi")), " (0.0%)"),
    )
    last = lambda p50, p95, p99, avg, part="0": _text("[Latency-0] FINAL count=1 min=1ms p50=", p50, "ms p95=", p95, "ms p99=", p99, "ms max=9ms avg=", avg, f".{part}ms")
    processing = _lines(users, last(F.col("n"), F.col("n"), F.col("n"), F.col("n")), last(F.col("n") + 1, F.col("hi"), F.col("n"), F.col("n"), "5"), F.lit("[Latency-0] count=1 p50=7ms p95=7ms p99=7ms avg=7.0ms"))
    total = _lines(users.where("user_id % 5 <> 0"), last(F.col("n"), F.col("n") + 5, F.col("n") + 9, F.col("n")))
    pod = lambda k, node: _text(f"pod-{k}  1/1  Running  0  5m  10.0.0.1  n", node, "  <none>")
    placed = _lines(users, F.lit("NAME READY STATUS RESTARTS AGE IP NODE NOMINATED"), pod(1, F.col("n") % 3), pod(2, F.col("hi") % 3), pod(3, F.lit(0)))
    log = _lines(users, F.lit("[SCHEDULING] Pod: a"), F.lit("  Strategy: FCFS"), F.lit("[SCHEDULING] Pod: b"), F.when(F.col("hi") % 2 == 1, "[STRATEGY SWITCH]"))
    return metrics.metrics_row(own, source, processing, total, placed, log)


GROUPS = f"{USERS}, k AS (SELECT 'w' || (user_id % 3) AS workload, 's' || (user_id % 5) AS strategy, * FROM u)"
SCAN_LOGS_SQL = f"""
WITH {GROUPS},
g AS (
  SELECT workload || '/' || strategy AS run, CAST(sum(n * 1000) AS BIGINT) AS generated, CAST(sum(hi * 1000) AS BIGINT) AS emitted,
         CAST(sum((n - hi) * 1000) AS BIGINT) AS dropped
  FROM k GROUP BY 1)
SELECT *, (dropped * 10000 // generated) / 100.0e0 AS drop_pct FROM g"""


def _in_folders(users: DataFrame) -> DataFrame:
    return users.select(_text("w", F.col("user_id") % 3).alias("workload"), _text("s", F.col("user_id") % 5).alias("strategy"), "*")


@query("scan_source_logs", SCAN_LOGS_SQL, "")
def scan_source_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to text files in a folder for each run, and scanned."""
    root, thousands = jobs.scratch(spark, "logs"), lambda c: F.format_number(c * 1000, 0)
    n, hi = F.col("n"), F.col("hi")
    last = _text("[Source-1] FINALIZADO en 9.0s: generated=", thousands(n), ", emitted=", thousands(hi), ", dropped=", thousands(n - hi), " (0.0%)")
    lines = _in_folders(_users(spark, sf_dir)).select("workload", "strategy", F.explode(F.array(F.lit("[Source-1] t=10s gen=1"), last)).alias("value"))
    lines.write.partitionBy("workload", "strategy").text(root)
    return artifacts.source_log(files.read_lines(spark, root, "*.txt"))


BLOCKS_SQL = f"""
WITH {GROUPS}, r AS (SELECT workload || '/' || strategy AS run, * FROM k)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY user_id) AS seq, 'p#' || user_id AS pod, 'FCFS' AS strategy, CASE WHEN n % 2 = 0 THEN 'n1' END AS node, hi + 0.5e0 AS cpu
FROM r"""
SWITCH_BLOCKS_SQL = f"""
WITH {GROUPS}, r AS (SELECT workload || '/' || strategy AS run, * FROM k)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY user_id) AS seq, 'FCFS' AS from_strategy, 'B' || user_id AS to_strategy, hi + 0.5e0 AS cpu,
       TIMESTAMP '2025-11-27 22:38:18' AS at
FROM r"""


def _scheduler_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log a run, with a decision and a switch for each user, behind the end of a block that was cut off; written as text, read as lines."""
    root, user = jobs.scratch(spark, "scheduler"), F.col("user_id")
    users = _in_folders(_users(spark, sf_dir))
    block = _text(
        "[SCHEDULING] Pod: p#", user, "\n  Strategy: FCFS\n", F.when(F.col("n") % 2 == 0, "  Result: SCHEDULED to n1\n").otherwise(""), "  Node CPU: ", F.col("hi"), ".5% (real)\n",
        "[STRATEGY SWITCH]\n  From: FCFS\n  To: B", user, "\n  Reason: Cluster CPU = ", F.col("hi"), ".5%\n  Time: 2025-11-27 22:38:18",
    )
    heads = users.select("workload", "strategy").distinct().select("workload", "strategy", F.lit(None).cast("long").alias("user_id"), F.lit("  Strategy: LOST\n  To: LOST").alias("value"))
    rows = heads.unionByName(users.select("workload", "strategy", "user_id", block.alias("value")))
    rows.repartition("workload", "strategy").sortWithinPartitions("workload", "strategy", "user_id").drop("user_id").write.partitionBy("workload", "strategy").text(root)
    return files.read_ordered_lines(spark, root, "*.txt")


query("scan_decisions", BLOCKS_SQL, "")(lambda s, d: artifacts.decision_lines(_scheduler_logs(s, d)))
query("scan_switches", SWITCH_BLOCKS_SQL, "")(lambda s, d: artifacts.switch_lines(_scheduler_logs(s, d)))
ARRIVING_SQL = f"""
WITH {GROUPS}, g AS (SELECT workload, strategy, CAST(sum(n) AS BIGINT) AS n, max(dur) AS dur, max(ms) AS ms, CAST(sum(hi) AS BIGINT) AS hi FROM k GROUP BY ALL)
SELECT workload || '/' || strategy AS run, workload, strategy, 'FINISHED' AS state, n AS processed_events, n * 1000 // dur AS throughput_processed, hi AS scheduling_decisions FROM g"""


@query("follow_runs", ARRIVING_SQL, "")
def follow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs arrive twice: first without records, then each again with its own, which replaces its row."""
    root, table, kept = (jobs.scratch(spark, name) for name in ("arriving", "metrics", "kept"))
    users = stored(_in_folders(_users(spark, sf_dir)))
    for again in (False, True):
        vertex = F.struct(F.lit("Source: Bid Generator").alias("name"), F.struct((F.sum("n") if again else F.lit(0).cast("long")).alias("write-records")).alias("metrics"))
        made = users.groupBy("workload", "strategy").agg(F.max("dur").alias("duration"), F.array(vertex).alias("vertices")).withColumn("state", F.lit("FINISHED" if again else "RUNNING"))
        if again:
            lines = users.select("workload", "strategy", F.explode(F.array_repeat(F.lit("[SCHEDULING] Pod: a"), F.col("hi").cast("int"))).alias("value"))
            lines.repartition("workload", "strategy").write.partitionBy("workload", "strategy").mode("append").text(root)
        made.withColumn("start-time", F.lit(int(again)).cast("long")).repartition("workload", "strategy").write.partitionBy("workload", "strategy").mode("append").json(root)
        found = arrivals.follow(spark, root, table, kept, job_files="*.json", scheduler_files="*.txt")
    return found.select("run", "workload", "strategy", "state", "processed_events", "throughput_processed", "scheduling_decisions")


SCAN_JOBS_SQL = f"""
WITH {GROUPS}, g AS (SELECT workload, strategy, CAST(sum(n) AS BIGINT) AS n, max(dur) AS dur FROM k GROUP BY ALL)
SELECT workload || '/' || strategy AS run, workload, strategy, 'FINISHED' AS state, n AS processed, n * 1000 // dur AS throughput FROM g"""


@query("scan_job_files", SCAN_JOBS_SQL, "")
def scan_job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file in a folder for each run, scanned, classified and rated."""
    root = jobs.scratch(spark, "jobs")
    vertex = F.struct(F.lit("Source: Bid Generator").alias("name"), F.struct(F.sum("n").alias("write-records")).alias("metrics"))
    made = _in_folders(_users(spark, sf_dir)).groupBy("workload", "strategy").agg(F.max("dur").alias("duration"), F.array(vertex).alias("vertices"))
    made.withColumn("state", F.lit("FINISHED")).repartition("workload", "strategy").write.partitionBy("workload", "strategy").json(root)
    found = files.read_jobs(spark, root, "*.json")
    done = artifacts.processed(artifacts.by_class(artifacts.vertices(found.withColumn("jid", F.col("run")))))
    return found.select("run", "workload", "strategy", "state").join(done.select(F.col("jid").alias("run"), "processed", "throughput"), "run")


#: Three records of a run's file, one of each layout, under one heading; counters of 0 broke their lines.
FILES_SQL = f"""
WITH {USERS}, r AS (SELECT 'w' || (user_id % 3) || '/s' || user_id AS run, * FROM u)
SELECT run, 0 AS record, 'full' AS layout, 's' AS strategy, NULL AS job_id, NULL::BIGINT AS throughput, hi AS throughput_processed, 0::BIGINT AS strategy_switches,
       5::BIGINT AS scheduling_decisions, hi AS lat_proc_p50, n + 0.5e0 AS lat_total_avg, NULL::DOUBLE AS stale_pct FROM r
UNION ALL
SELECT run, 1, 'first', 's', 'j' || user_id, n, NULL, 0, 0, NULL, NULL, NULL FROM r
UNION ALL
SELECT run, 2, 'aged', 's', NULL, NULL, NULL, 0, 5, hi, n + 0.5e0, 0.97e0 FROM r
UNION ALL
SELECT run, 3, 'unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r"""


@query("metrics_csv_records", FILES_SQL, "")
def metrics_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = lambda processed: _text("s,w,STEP,1,2.5,3,4,FINISHED,", processed, ",1,2,3,4,5,18.07,1,5,5,0\n0,", F.col("hi"), ",2,3,4.5,6,7,8,", F.col("n"), ".5")
    first = _text("s,j", F.col("user_id"), ",FINISHED,304214,304.21,1,", F.col("n"), ",3,4,90.9,5,6,7,5,1,0\n0,0\n0")
    text = _text(",".join(metrics.FULL), "\n", full(F.col("hi")), "\n", first, "\n", full(F.lit("N/A")), ",15000,0,.97\r\n", "s,cut,off\n")
    found = metrics.consolidate_files(_users(spark, sf_dir).select(_run().alias("run"), text.alias("text")))
    columns = "run record layout strategy job_id throughput throughput_processed strategy_switches scheduling_decisions lat_proc_p50 lat_total_avg stale_pct"
    return found.select(*columns.split())


SUMMARY_SQL = f"""
WITH {USERS}
SELECT 'w' || (user_id % 3) || '/s' || user_id AS run, CASE WHEN hi > 0 THEN 'FINISHED' END AS state, ms AS duration_ms, n AS decisions, hi AS switches,
       '5 n' || (n % 3) AS distribution
FROM u"""


@query("parse_summary", SUMMARY_SQL, "")
def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text(
        "EXPERIMENTO: FCFS - Alta Carga\n\nConfiguración:\n- Eventos/seg: 200,000\n- Duración: 180 segundos\n\nResultados:\n", F.when(F.col("hi") > 0, "- Estado final: FINISHED\n").otherwise(""),
        "- Duración: ", F.col("ms"), " ms\n\nDistribución de TaskManagers:\n      5 n", F.col("n") % 3, "\n\nScheduling decisions:\n", F.col("n"), "\n\nStrategy switches:    ", F.col("hi"), "\n0\n\nSwitches detectados:\n",
    )
    return metrics.summary(_users(spark, sf_dir).select(_run().alias("run"), text.alias("text")))


HIGH_SQL = f"""
WITH {USERS}, s AS (SELECT 's' || (user_id % 5) AS strategy, CAST(sum(n) AS BIGINT) AS n, max(ms) AS ms FROM u GROUP BY 1),
p AS (SELECT 's' || (user_id % 5) AS strategy, 'n' || (user_id % 5 % (1 + n % 3)) AS node, count(*) AS pods FROM u GROUP BY 1, 2),
d AS (SELECT strategy, string_agg(pods || ' ' || node, ' ' ORDER BY node) AS distribution, count(*) AS used FROM p GROUP BY 1)
SELECT w.strategy, CASE WHEN s.strategy IS NULL THEN 'No ejecutado' ELSE 'FINISHED' END AS state, s.n * 1000 // s.ms AS throughput, (s.ms // 100) / 10.0e0 AS duration_sec,
       distribution, CASE used WHEN 1 THEN 'unbalanced' WHEN 3 THEN 'balanced' ELSE CASE WHEN used IS NOT NULL THEN 'partial' END END AS balance
FROM (SELECT unnest(['s0', 's1', 's2', 's9']) AS strategy) w LEFT JOIN s USING (strategy) LEFT JOIN d USING (strategy)"""


@query("compare_highload", HIGH_SQL, "")
def compare_highload(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir).withColumn("strategy", _text("s", F.col("user_id") % 5))
    vertex = F.struct(F.lit("Source: Bid Generator").alias("name"), F.struct(F.col("n").alias("write-records")).alias("metrics"))
    found = users.groupBy("strategy").agg(F.sum("n").alias("n"), F.max("ms").alias("duration")).select("strategy", F.lit("FINISHED").alias("state"), "duration", F.array(vertex).alias("vertices"))
    pods = users.groupBy("strategy", _text("n", F.col("user_id") % 5 % (1 + F.col("n") % 3)).alias("node")).agg(F.count("*").alias("pods"))
    return compare.high_load(found, pods, ["s0", "s1", "s2", "s9"])


# --- figures of streams
LATE_SQL = """
, a AS (SELECT *, ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL '2 days' ELSE INTERVAL '0 days' END AS came FROM bids),
q AS (SELECT *, CAST(least(3, (epoch_us(came) - min(epoch_us(came)) OVER ()) * 4 // (max(epoch_us(came)) OVER () - min(epoch_us(came)) OVER ())) AS INT) AS part FROM a),
f AS (SELECT auction_id, ts, part, time_bucket(INTERVAL '1 hour', ts) AS w FROM q WHERE price > 100),
m AS (SELECT part, max(ts) AS most FROM f GROUP BY 1),
k AS (SELECT p.part, (SELECT max(most) FROM m WHERE m.part < p.part) - INTERVAL '5 seconds' AS mark FROM m p)
SELECT auction_id, w AS window_start, w + INTERVAL '1 hour' AS window_end, count(*) AS arrived,
       count(*) FILTER (mark IS NOT NULL AND w + INTERVAL '1 hour' <= time_bucket(INTERVAL '1 millisecond', mark)) AS late
FROM f JOIN k USING (part) GROUP BY ALL"""


@query("late_rows", LATE_SQL)
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in four batches by time; every seventh comes two days later."""
    found = stats.late_counts(spark, _arrived(spark, sf_dir), PipelineConfig(**HOURLY))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _arrived(spark: SparkSession, sf_dir: str, days: int = 2) -> list[DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and value is not null and ts is not null")
    came = F.unix_micros((F.col("ts") + F.when(F.col("event_id") % 7 == 0, F.expr(f"interval {days} days")).otherwise(F.expr("interval 0 days"))).cast("timestamp"))
    lo, hi = events.agg(F.min(came), F.max(came)).first()
    part = F.least(F.lit(3), F.floor((came - F.lit(lo)) * 4 / F.lit(max(1, (hi or 0) - (lo or 0)))).cast("int"))
    return [events.where(part == k) for k in range(4)]


CLOSED = "(SELECT * FROM (" + WINDOW_SQL["tumbling"].format(agg="count(*)") + ") WHERE window_end <= (SELECT max(ts) - INTERVAL '5 seconds' FROM amounts))"


@query("stream_sink_stats", f"SELECT 'all' AS \"group\", count(*) AS n_rows, count(*) AS n_measured, min(value) AS min_ms, max(value) AS max_ms, CAST(sum(value) AS BIGINT) AS sum_ms FROM {CLOSED}", AMOUNTS)
def stream_sink_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink measures of windows, here their counts; summed over its batches."""
    stream = jobs.windowed_stream(jobs.bid_stream(spark, f"{sf_dir}/events.parquet"), PipelineConfig(aggregate="count", **HOURLY))
    rows = stats.to_statistics(stream, F.col("value").cast("bigint"), jobs.scratch(spark))
    return rows.groupBy("group").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_measured").alias("n_measured"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.sum("sum_ms").alias("sum_ms")
    )


@query("stream_observed", "SELECT count(*) AS n, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS sum_ms FROM bids")
def stream_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the rows that pass an operator of a running stream, a line a batch, summed up."""
    measures = {"n": F.count("*"), "sum_ms": F.sum(F.round(F.col("price") * 100).cast("bigint"))}
    seen = stats.observed_batches(jobs.bid_stream(spark, f"{sf_dir}/events.parquet"), "passed", measures, jobs.scratch(spark))
    return seen.agg(F.sum("n").alias("n"), F.sum("sum_ms").alias("sum_ms"))


#: Within one stream, a batch's rows are late by the mark that the batch before was run with.
COUNTED_SQL = LATE_SQL[: LATE_SQL.rindex("SELECT auction_id, w AS")].replace("'2 days'", "'12 days'").replace("m.part < p.part", "m.part < p.part - 1") + """
SELECT CAST(q.part AS BIGINT) AS batch, count(*) AS generated, count(*) FILTER (price > 100) AS emitted,
       count(DISTINCT struct_pack(a := q.auction_id, w := time_bucket(INTERVAL '1 hour', q.ts))) FILTER (price > 100 AND mark IS NOT NULL
         AND time_bucket(INTERVAL '1 hour', q.ts) + INTERVAL '1 hour' <= time_bucket(INTERVAL '1 millisecond', mark)) AS late_groups
FROM q JOIN k USING (part) GROUP BY ALL"""


@query("stream_counters", COUNTED_SQL)
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in four files by time, every seventh twelve days later; what the running source counted of each."""
    folder = jobs.scratch(spark, "arrived")
    for part in _arrived(spark, sf_dir, 12):
        part.coalesce(1).write.mode("append").parquet(folder)
    return stats.counted(jobs.bid_stream(spark, folder), PipelineConfig(**HOURLY), jobs.scratch(spark))


def _in_turns(spark: SparkSession, sf_dir: str, by: str, parts: int = 5) -> str:
    """A folder of events in files that come one after the other, by ranges of a column."""
    folder = jobs.scratch(spark, "turns")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col(by).cast("timestamp")) if by == "ts" else F.col(by)
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    part = F.least(F.lit(parts - 1), F.floor((at - F.lit(lo or 0)) * parts / F.lit(max(1, (hi or 0) - (lo or 0)))))
    for k in range(parts):
        events.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query(
    "stream_running_rows",
    """
        SELECT auction_id, event_id,
          CAST(sum(CAST(amount AS DECIMAL(20,5))) OVER (PARTITION BY auction_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total
        FROM amounts""",
    AMOUNTS,
)
def stream_running_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An updated sum for every bid of a stream of five files."""
    bids = jobs.bid_stream(spark, _in_turns(spark, sf_dir, "ts"))
    config = PipelineConfig()
    return state.to_files(state.running_rows(core.amounts(core.filters(bids, config), config)), jobs.scratch(spark))


@query("stream_cooldown", COOLDOWN_SQL, "RECURSIVE " + NAMELESS)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted changes of regime in a stream of five files."""
    bids = jobs.bid_stream(spark, _in_turns(spark, sf_dir, "event_id"))
    ticks = bids.select(F.nullif("event_type", F.lit("error")).alias("run"), F.col("event_id").alias("seq"), "ts", F.least(F.lit(100.0), "price").alias("cpu"))
    return state.to_files(state.cooldown_changes(ticks, 3600), jobs.scratch(spark))
