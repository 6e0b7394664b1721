"""The registered queries on the driver's tables, and the same in SQL.

bids are the events table. Windows are scaled to its density: an hour, sliding by half an hour, sessions of six hours.
Records of runs are built from events by Spark and parsed back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AGGREGATES, PROFILES, WINDOWS, PipelineConfig
from ..functions import quantities, scores
from ..operators import artifacts, compare, decisions, latency, nodes
from ..operators import pipeline as core
from ..sources import bids as source
from ..streaming import jobs
from .registry import BIDS, query
from .registry import bids as _bids

# fixed value: the head of the benchmark's run names
NAME_HEAD = "Nexmark-Config"
HOURLY = dict(size="1 hour", slide="30 minutes", gap="6 hours")
AMOUNTS = BIDS + ", amounts AS (SELECT auction_id, CAST(price * 0.908e0 AS DOUBLE) AS amount, ts, event_id FROM bids WHERE price > 100)"
AGG_SQL = {
    "sum": "CAST(sum(CAST(amount AS DECIMAL(20,5))) AS DOUBLE)", "avg": "CAST(sum(CAST(amount AS DECIMAL(20,5))) AS DOUBLE) / count(*)",
    "count": "CAST(count(*) AS DOUBLE)", "max": "max(amount)", "min": "min(amount)",
}
WINDOW_SQL = {
    "tumbling": """
        SELECT auction_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
          {agg} AS value
        FROM amounts
        GROUP BY ALL""",
    "sliding": """
        SELECT auction_id, time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start,
          time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' + INTERVAL '1 hour' AS window_end, {agg} AS value
        FROM amounts, range(2) r(k)
        GROUP BY ALL""",
    "session": """
        SELECT auction_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, {agg} AS value
        FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY auction_id ORDER BY ts, event_id) AS s
          FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY auction_id ORDER BY ts, event_id) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh
            FROM amounts))
        GROUP BY auction_id, s""",
}


# --- sources
query("bids_scan", "SELECT auction_id, bidder_id, price, ts FROM bids")(lambda s, d: _bids(s, d).select("auction_id", "bidder_id", "price", "ts"))


@query(
    "pool_replay",
    """
        SELECT e.event_id AS id, (k * 7919) % 1000 AS auction_id, (k * 104729) % 10000 AS bidder_id, ((k * 15485863) % 99000 + 1000) / 100.0e0 AS price
        FROM (SELECT event_id, event_id % 500 AS k
        FROM events) e""",
    "",
)
def pool_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replayed bid for each event."""
    return source.pool_replay(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id")), 500)


RATE_SQL = {
    "constant": "50000",
    "step": "CASE WHEN t >= 99 AND t < 198 THEN 75000 ELSE 12500 END",
    "sine": "greatest(1, CAST(trunc(50000 * (1 + 0.7e0 * sin(2 * pi() * t / 60.0e0))) AS INT))",
}
#: An arrival profile gives each event a second (of 300) and that second's target.
SECONDS = "s AS (SELECT event_id, CAST(event_id % 300 AS INT) AS t FROM events)"
for _p in PROFILES:

    def _rate(spark: SparkSession, sf_dir: str, p: str = _p) -> DataFrame:
        seconds = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("event_id") % 300).cast("int").alias("t")).agg(F.count("*").alias("arrived"))
        return seconds.select("t", "arrived", source.rate(PipelineConfig(profile=p), F.col("t")).cast("int").alias("target_rate"))

    query(f"rate_{_p}", f"WITH {SECONDS} SELECT t, count(*) AS arrived, {RATE_SQL[_p]} AS target_rate FROM s GROUP BY t", "")(_rate)


RATE_PLAN_SQL = f"""
WITH {SECONDS}, r AS (SELECT t, {RATE_SQL['step']} AS target_rate FROM s GROUP BY t)
SELECT t, target_rate, greatest(1, target_rate // 4) AS instance_rate, greatest(1, greatest(1, target_rate // 4) // 50) AS batch_size,
       greatest(1, 75000 // 4) * 2 AS capacity
FROM r"""


@query("rate_plan", RATE_PLAN_SQL, "")
def rate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.rate_plan(_rate(spark, sf_dir, "step").drop("arrived"), PipelineConfig(profile="step"), 4)


# --- filters and projections
def _filtered(**which):
    config = PipelineConfig(**({"high_value": False, "auction_range": False, "bidder_range": False} | which), max_auction=75)
    return lambda s, d: core.filters(_bids(s, d), config).select("auction_id", "bidder_id", "price", "ts")


ROW = "SELECT auction_id, bidder_id, price, ts FROM bids WHERE "
query("filter_high_value", ROW + "price > 100")(_filtered(high_value=True))
query("filter_auction_range", ROW + "auction_id < 75")(_filtered(auction_range=True))
query("filter_bidder_range", ROW + "bidder_id < 5000")(_filtered(bidder_range=True))
query("filter_chain", ROW + "price > 100 AND auction_id < 75 AND bidder_id < 5000")(_filtered(high_value=True, auction_range=True, bidder_range=True))
query(
    "currency_eur",
    "SELECT auction_id, CAST(price * 0.908e0 AS DOUBLE) AS amount FROM bids",
)(lambda s, d: core.amounts(_bids(s, d), PipelineConfig()).select("auction_id", "amount"))
query(
    "extract_price",
    "SELECT auction_id, price AS amount FROM bids",
)(lambda s, d: core.amounts(_bids(s, d), PipelineConfig(to_eur=False)).select("auction_id", "amount"))


@query(
    "stale_filter",
    """
        SELECT count(*) AS offered, count(*) FILTER (price * 100 <= 15000) AS kept, count(*) FILTER (price * 100 > 15000) AS stale_dropped,
          round(100.0e0 * count(*) FILTER (price * 100 > 15000) / count(*), 2) AS stale_pct
        FROM bids""",
)
def stale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.stale_split(_bids(spark, sf_dir).select((F.col("price") * 100).alias("age_ms")), 15_000)


# --- keyed windows
for _w in WINDOWS:
    for _a in AGGREGATES:
        _config = PipelineConfig(window=_w, aggregate=_a, **HOURLY)
        query(f"{_w}_{_a}", WINDOW_SQL[_w].format(agg=AGG_SQL[_a]), AMOUNTS)(lambda s, d, c=_config: core.pipeline(_bids(s, d), c))
for _a in AGGREGATES:
    _config = PipelineConfig(window="session", aggregate=_a, hot_keys=True, **HOURLY)
    query(f"session_{_a}_by_parts", WINDOW_SQL["session"].format(agg=AGG_SQL[_a]), AMOUNTS)(lambda s, d, c=_config: core.pipeline(_bids(s, d), c))
query(
    "sliding_many",
    """
        SELECT auction_id, time_bucket(INTERVAL '12 minutes', ts) - k * INTERVAL '12 minutes' AS window_start,
          time_bucket(INTERVAL '12 minutes', ts) - k * INTERVAL '12 minutes' + INTERVAL '12 hours' AS window_end, """ + AGG_SQL["avg"] + """ AS value
        FROM amounts, range(60) r(k)
        GROUP BY ALL""",
    AMOUNTS,
)(lambda s, d: core.pipeline(_bids(s, d), PipelineConfig(window="sliding", aggregate="avg", size="12 hours", slide="12 minutes")))
query("flagship", WINDOW_SQL["tumbling"].format(agg=AGG_SQL["sum"]), AMOUNTS)(lambda s, d: core.pipeline(_bids(s, d), PipelineConfig(**HOURLY)))


def _amounts(s: SparkSession, d: str) -> DataFrame:
    return core.amounts(core.high_value(_bids(s, d)), PipelineConfig())


query(
    "running_sum",
    """
        SELECT auction_id, event_id,
          CAST(sum(CAST(amount AS DECIMAL(20,5))) OVER (PARTITION BY auction_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total
        FROM amounts""",
    AMOUNTS,
)(lambda s, d: core.running_sum(_amounts(s, d)))
query("total_by_auction", f"SELECT auction_id, {AGG_SQL['sum']} AS total FROM amounts GROUP BY 1", AMOUNTS)(lambda s, d: core.totals(_amounts(s, d)))


@query(
    "stream_tumbling_sum",
    "SELECT * FROM (" + WINDOW_SQL["tumbling"].format(agg=AGG_SQL["sum"]) + ") WHERE window_end <= (SELECT max(ts) - INTERVAL '5 seconds' FROM amounts)",
    AMOUNTS,
)
def stream_tumbling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.windows_of_files(spark, f"{sf_dir}/events.parquet", PipelineConfig(**HOURLY))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


query(
    "stream_running_sum",
    f"SELECT auction_id, {AGG_SQL['sum']} AS total FROM amounts GROUP BY 1",
    AMOUNTS,
)(lambda s, d: jobs.running_totals(s, f"{d}/events.parquet", PipelineConfig()))

# --- latency and throughput


def _picked(p: str, name: str) -> str:
    """The value at the place that the percentile rule takes."""
    return f"list(ms ORDER BY ms)[CAST(least(count(*) - 1, trunc(count(*) * {p}e0)) AS BIGINT) + 1] AS {name}"


STATS = f"""count(*) AS n_rows, min(ms) AS min_ms,
          {_picked("0.5", "p50")},
          {_picked("0.95", "p95")},
          {_picked("0.99", "p99")},
          max(ms) AS max_ms, CAST(sum(ms) AS BIGINT) AS sum_ms, CAST(sum(ms) AS BIGINT) / count(*) AS avg_ms"""
MS = BIDS + ", l AS (SELECT event_type, CAST(round(price * 100) AS BIGINT) AS ms, ts FROM bids)"


def _latencies(s: SparkSession, d: str) -> DataFrame:
    return _bids(s, d).select("event_type", F.round(F.col("price") * 100).cast("bigint").alias("ms"), "ts")


query("latency_percentiles", f"SELECT event_type, {STATS} FROM l GROUP BY 1", MS)(lambda s, d: latency.percentiles(_latencies(s, d), "event_type", "ms"))
query("latency_percentiles_approx")(lambda s, d: latency.approximate_percentiles(_latencies(s, d), "event_type", "ms"))


@query(
    "latency_processing",
    f"""
        SELECT event_type, {STATS}
        FROM (SELECT event_type,
          CAST(epoch_us(ts + CAST(CAST(round(price * 100) AS BIGINT) AS BIGINT) * INTERVAL '1 millisecond') - epoch_us(ts) AS BIGINT) // 1000 AS ms
        FROM bids)
        GROUP BY 1""",
)
def latency_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bids(spark, sf_dir).withColumn("done", F.expr("ts + make_dt_interval(0, 0, 0, cast(round(price * 100) / 1000 as decimal(18, 6)))"))
    return latency.percentiles(rows.withColumn("ms", F.expr("timestampdiff(MICROSECOND, ts, done) div 1000")), "event_type", "ms")


@query(
    "latency_total",
    f"""
        , w AS ({WINDOW_SQL["tumbling"].format(agg="max(epoch_us(ts))")})
        SELECT shard, {STATS}
        FROM (SELECT auction_id % 4 AS shard, (epoch_us(window_end) - 1000 - value) // 1000 AS ms FROM w)
        GROUP BY 1""",
    AMOUNTS,
)
def latency_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a window's last event to its end less a millisecond, by shard of auctions."""
    rows = _amounts(spark, sf_dir).groupBy("auction_id", F.window("ts", "1 hour").alias("w")).agg(F.max("ts").alias("last"))
    ms = F.expr("(timestampdiff(MICROSECOND, last, w.end) - 1000) div 1000")
    return latency.percentiles(rows.select((F.col("auction_id") % 4).alias("shard"), ms.alias("ms")), "shard", "ms")


query(
    "reservoir_sample",
    """
        SELECT event_type, event_id, price
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r
        FROM bids)
        WHERE r <= 100""",
)(
    lambda s, d: latency.reservoir(_bids(s, d).select("event_type", "event_id", "price"), "event_type", "event_id", 100)
)
DAY = "time_bucket(INTERVAL '1 day', ts)"
query(
    "load_shed",
    f"""
        SELECT {DAY} AS interval_start, count(*) AS generated, least(count(*), 300) AS emitted, count(*) - least(count(*), 300) AS dropped,
          round(100.0e0 * (count(*) - least(count(*), 300)) / count(*), 2) AS drop_pct
        FROM bids
        GROUP BY 1""",
)(lambda s, d: latency.shed(_bids(s, d), "1 day", 300))
query(
    "admitted_bids",
    f"""
        SELECT event_id
        FROM (SELECT event_id, row_number() OVER (PARTITION BY {DAY} ORDER BY ts, event_id) AS r
        FROM bids)
        WHERE r <= 300""",
)(lambda s, d: latency.admitted(_bids(s, d), "1 day", 300).select("event_id"))
query(
    "latency_snapshots",
    f"""
        SELECT event_type, day + INTERVAL '1 day' AS snapshot_at, CAST(sum(c) OVER w AS BIGINT) AS n_rows, CAST(sum(s) OVER w AS BIGINT) AS sum_ms,
          min(lo) OVER w AS min_ms, max(hi) OVER w AS max_ms
        FROM (SELECT event_type, {DAY} AS day, count(*) AS c, sum(ms) AS s, min(ms) AS lo, max(ms) AS hi
        FROM l
        GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    MS,
)(lambda s, d: latency.snapshots(_latencies(s, d), "1 day", "event_type", "ms"))
#: A join on event_type: rows without one have no snapshots.
SNAPSHOTS_SQL = f"""
, days AS (SELECT DISTINCT event_type, {DAY} AS day FROM l)
SELECT event_type, day + INTERVAL '1 day' AS snapshot_at, {STATS}
FROM days JOIN l USING (event_type) WHERE {DAY} <= day GROUP BY event_type, day"""
query("latency_snapshots_p", SNAPSHOTS_SQL, MS)(
    lambda s, d: latency.snapshot_percentiles(_latencies(s, d).where("event_type is not null"), "1 day", "event_type", "ms")
)
RATES = f"""
  SELECT event_type, {DAY} AS interval_start, count(*) AS n_rows, count(*) / 86400.0e0 AS per_second,
    count(*) - lag(count(*)) OVER (PARTITION BY event_type ORDER BY {DAY}) AS change, min(ts) AS first_ts, max(ts) AS last_ts
  FROM {{t}}
  GROUP BY 1, 2"""
query(
    "sink_rate",
    RATES.format(t="(SELECT * FROM bids WHERE price > 100)"),
)(lambda s, d: latency.interval_rates(core.high_value(_bids(s, d)), "1 day", 86400, "event_type"))
COUNTERS_SQL = f"""
, i AS (SELECT {DAY} AS interval_start, count(*) AS generated, least(count(*), 300) AS emitted FROM bids GROUP BY 1),
c AS (SELECT *, generated - emitted AS dropped FROM i),
t AS (
  SELECT interval_start, CAST(sum(generated) OVER w AS BIGINT) AS generated_total, CAST(sum(emitted) OVER w AS BIGINT) AS emitted_total,
         CAST(sum(dropped) OVER w AS BIGINT) AS dropped_total, generated / 86400.0e0 AS generated_per_sec, emitted / 86400.0e0 AS emitted_per_sec,
         dropped / 86400.0e0 AS dropped_per_sec
  FROM c WINDOW w AS (ORDER BY interval_start ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN generated_total > 0 THEN round(100.0e0 * dropped_total / generated_total, 6) ELSE 0.0e0 END AS drop_pct FROM t"""
query("source_counters", COUNTERS_SQL)(lambda s, d: latency.counters(_bids(s, d), "1 day", 86400, 300))
query("source_rates", RATES.format(t="bids"))(lambda s, d: latency.interval_rates(_bids(s, d), "1 day", 86400, "event_type"))
query("sink_totals", "SELECT event_type, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bids WHERE price > 100 GROUP BY 1")(
    lambda s, d: latency.final_rates(core.high_value(_bids(s, d)), "event_type")
)

# --- nodes
LOAD = BIDS + """,
load AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS tick, auction_id % 3 AS node, auction_id % 3 AS ord, max(least(100.0e0, price)) AS cpu_pct,
         count(*) AS pods, min(price) AS low
  FROM bids GROUP BY ALL)"""


def _load(s: SparkSession, d: str) -> DataFrame:
    node, tick = (F.col("auction_id") % 3).alias("node"), F.window("ts", "1 hour")["start"].alias("tick")
    cpu = F.max(F.least(F.lit(100.0), "price")).alias("cpu_pct")
    rows = _bids(s, d).groupBy(tick, node).agg(cpu, F.count("*").alias("pods"), F.min("price").alias("low"))
    return rows.withColumn("ord", F.col("node"))


USED = LOAD + """,
used AS (SELECT tick, node, CAST(round(cpu_pct * 9) AS DOUBLE) AS used, CAST(round(low * 1000) AS BIGINT) AS bytes_used, pods FROM load),
sizes AS (SELECT DISTINCT node, CASE node WHEN 0 THEN 900.0e0 WHEN 1 THEN 500.0e0 END AS millicores FROM load WHERE node < 2),
cpu AS (
  SELECT tick, node, least(100.0e0, greatest(0.0e0, 100.0e0 * used / coalesce(millicores, 1000.0e0))) AS pct
  FROM used LEFT JOIN sizes USING (node))"""


def _usage(s: SparkSession, d: str) -> DataFrame:
    used = F.round(F.col("cpu_pct") * 9).cast("double")
    return _load(s, d).select("tick", "node", used.alias("used"), F.round(F.col("low") * 1000).cast("bigint").alias("bytes_used"), "pods")


def _node_cpu(s: SparkSession, d: str) -> DataFrame:
    """Node 2 says nothing of its size."""
    sizes = _load(s, d).where("node < 2").select("node", F.when(F.col("node") == 0, 900.0).otherwise(500.0).alias("millicores")).distinct()
    return nodes.node_cpu(_usage(s, d), sizes)


query("cpu_utilisation", "SELECT tick, node, pct FROM cpu", USED)(_node_cpu)


@query(
    "mem_utilisation",
    """SELECT tick, node, CASE WHEN pods % 5 = 0 OR pods = 1 THEN 50.0e0
              ELSE least(100.0e0, greatest(0.0e0, 100.0e0 * bytes_used / ((pods - 1) * 10000))) END AS pct FROM used""",
    USED,
)
def mem_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of some nodes there is no sample, and of some no size."""
    used = _usage(spark, sf_dir)
    return nodes.node_memory(used.select("tick", "node", ((F.col("pods") - 1) * 10000).alias("bytes")), used.where("pods % 5 <> 0").select("tick", "node", F.col("bytes_used").alias("used")))


@query(
    "cpu_estimated",
    """
        SELECT tick, node, CASE WHEN pods % 3 = 0 THEN least(90.0e0, 15.0e0 + 8.0e0 * pods) ELSE pct END AS pct
        FROM cpu
        JOIN used USING (tick, node)""",
    USED,
)
def cpu_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pods = _usage(spark, sf_dir).select("tick", "node", "pods")
    return nodes.with_estimates(pods, _node_cpu(spark, sf_dir).join(pods.where("pods % 3 <> 0"), ["tick", "node"], "left_semi"))


CLUSTER_SQL = """
SELECT t.tick, coalesce(CAST(sum(CAST(pct AS DECIMAL(20,4))) AS DOUBLE) / count(pct), 50.0e0) AS pct
FROM (SELECT tick FROM load UNION SELECT tick + INTERVAL '30 minutes' FROM load) t LEFT JOIN cpu c ON c.tick = t.tick GROUP BY 1"""


@query("cluster_avg_cpu", CLUSTER_SQL, USED)
def cluster_avg_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all nodes; the half hours between have none."""
    ticks = _load(spark, sf_dir).select(F.explode(F.array("tick", F.expr("tick + interval 30 minutes"))).alias("tick")).distinct()
    return nodes.cluster_average(ticks, _node_cpu(spark, sf_dir))


query(
    "pod_cpu",
    """
        SELECT auction_id AS pod, CAST(sum(coalesce(CAST(round(price * 100) AS BIGINT), 100)) AS BIGINT) AS millicores
        FROM bids
        GROUP BY 1""",
)(
    lambda s, d: _bids(s, d).groupBy(F.col("auction_id").alias("pod")).agg(
        F.sum(quantities.millicores(F.concat(F.round(F.col("price") * 100).cast("bigint").cast("string"), F.lit("m")))).cast("bigint").alias("millicores"),
    )
)


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


def _cpu_text():
    """Millicores, cores, nanocores and what is none, by turns."""
    n = F.col("event_id")
    text = lambda c, unit: F.concat(c.cast("string"), F.lit(unit))
    return F.when(n % 4 == 0, text(n, "m")).when(n % 4 == 1, text(n, "")).when(n % 4 == 2, text(n * 1000000, "n")).otherwise("bad")


query(
    "quantity_cpu",
    """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN event_id * 1000.0e0 WHEN 2 THEN event_id::DOUBLE ELSE 0.0e0 END AS millicores
        FROM events""",
    "",
)(lambda s, d: _events(s, d).select("event_id", quantities.millicores(_cpu_text()).alias("millicores")))
_mem_text = lambda: F.concat(F.col("event_id").cast("string"), F.element_at(F.array(*map(F.lit, ("Ki", "Mi", "Gi", "x"))), (F.col("event_id") % 4 + 1).cast("int")))
query(
    "quantity_mem",
    """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 1024 WHEN 1 THEN event_id * 1048576 WHEN 2 THEN event_id * 1073741824 ELSE 0 END AS bytes
        FROM events""",
    "",
)(lambda s, d: _events(s, d).select("event_id", quantities.memory_bytes(_mem_text()).alias("bytes")))
query(
    "pods_pending",
    "SELECT event_id AS pod FROM bids WHERE event_type IN ('click', 'view') AND auction_id % 3 < 2",
)(
    lambda s, d: nodes.pending(_bids(s, d).select(F.col("event_id").alias("pod"), F.when(F.col("event_type").isin("click", "view"), "own").otherwise("other").alias("scheduler"), F.when(F.col("auction_id") % 3 == 0, "").when(F.col("auction_id") % 3 == 2, "n").alias("node")), "own").select(
        "pod",
    )
)


@query("nodes_eligible", "SELECT event_id AS node FROM bids WHERE price > 50 AND auction_id % 3 <> 1")
def nodes_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = F.array(F.struct(F.lit("Ready").alias("type"), F.when(F.col("price") > 50, "True").otherwise("False").alias("status")))
    taints = F.when(F.col("auction_id") % 3 == 1, F.array(F.struct(F.lit("NoSchedule").alias("effect"))))
    return nodes.eligible(_bids(spark, sf_dir).select(F.col("event_id").alias("node"), ready.alias("conditions"), taints.alias("taints"))).select("node")


# --- decisions
query("pick_first", "SELECT tick, arg_min(node, ord) AS node FROM load GROUP BY 1", LOAD)(lambda s, d: decisions.choose("FCFS", _load(s, d)))
query(
    "pick_least_loaded",
    """
        SELECT tick, node
        FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY cpu_pct, ord) AS r
        FROM load)
        WHERE r = 1""",
    LOAD,
)(lambda s, d: decisions.choose("LEAST_LOADED", _load(s, d)))
query(
    "assign_round_robin",
    """
        SELECT event_type AS run, event_id AS seq, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 3 AS node
        FROM bids""",
)(
    lambda s, d: decisions.round_robin(_bids(s, d).select(F.col("event_type").alias("run"), F.col("event_id").alias("seq")), 3)
)


@query(
    "pick_by_priority",
    """
        , c AS (SELECT tick, arg_min(node, ord) AS f
        FROM load
        GROUP BY 1), m AS (SELECT tick, node AS l
        FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY cpu_pct, ord) AS r
        FROM load)
        WHERE r = 1) SELECT event_id AS seq, CASE WHEN event_id % 10 = 3 THEN 1 ELSE CAST(event_id % 10 AS INT) END AS priority,
          CASE WHEN event_id % 10 >= 5 THEN l ELSE f END AS node
        FROM bids
        JOIN c ON c.tick = time_bucket(INTERVAL '1 hour', ts)
        JOIN m ON m.tick = c.tick""",
    LOAD,
)
def pick_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("event_id") % 10 == 3, "urgent").otherwise((F.col("event_id") % 10).cast("string"))
    requests = _bids(spark, sf_dir).select(F.col("event_id").alias("seq"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("tick"), priority.alias("priority"))
    return decisions.pick_by_priority(_load(spark, sf_dir), requests)


PLACE_SQL = """
, q AS (SELECT event_type AS run, event_id AS seq, time_bucket(INTERVAL '1 hour', ts) AS tick, event_id % 10 AS priority FROM bids),
o AS (
  SELECT *, row_number() OVER (PARTITION BY tick ORDER BY ord) - 1 AS place, row_number() OVER (PARTITION BY tick ORDER BY cpu_pct, ord) AS by_load, count(*) OVER (PARTITION BY tick) AS n
  FROM load),
i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) - 1 AS i FROM q)
SELECT 'FCFS' AS strategy, seq, node FROM q JOIN o USING (tick) WHERE place = 0
UNION ALL SELECT 'LEAST_LOADED', seq, node FROM q JOIN o USING (tick) WHERE by_load = 1
UNION ALL SELECT 'BALANCED', seq, node FROM i JOIN o USING (tick) WHERE place = i % n
UNION ALL SELECT 'PRIORITY', seq, node FROM q JOIN o USING (tick) WHERE CASE WHEN priority >= 5 THEN by_load = 1 ELSE place = 0 END"""


@query("place_by_strategy", PLACE_SQL, LOAD)
def place_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request by each strategy of the registry."""
    tick = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("tick")
    requests = _bids(spark, sf_dir).select(F.col("event_type").alias("run"), F.col("event_id").alias("seq"), tick, (F.col("event_id") % 10).cast("string").alias("priority"))
    load = _load(spark, sf_dir)
    every = [decisions.place(name, load, requests).select(F.lit(name).alias("strategy"), "seq", "node") for name in decisions.STRATEGIES]
    return reduce(DataFrame.unionByName, every)


REWARD = """
  CASE WHEN cpu < 30 THEN 0.5e0 + 0.3e0 * cpu / 30.0e0 WHEN cpu <= 70 THEN 1.0e0 WHEN cpu <= 90 THEN 1.0e0 - 0.5e0 * (cpu - 70.0e0) / 20.0e0 ELSE 0.2e0 END"""
STEPS = BIDS + f""",
steps AS (SELECT event_type AS run, event_id AS seq, auction_id % 3 AS node, least(100.0e0, price) AS cpu, ts FROM bids),
rewarded AS (SELECT *, {REWARD} AS reward FROM steps)"""


def _steps(s: SparkSession, d: str) -> DataFrame:
    node, cpu = (F.col("auction_id") % 3).alias("node"), F.least(F.lit(100.0), "price").alias("cpu")
    rows = _bids(s, d).select(F.col("event_type").alias("run"), F.col("event_id").alias("seq"), node, cpu, "ts")
    return rows.withColumn("reward", scores.reward(F.col("cpu")))


query(
    "reward_score",
    "SELECT run, seq, round(reward, 9) AS reward FROM rewarded",
    STEPS,
)(lambda s, d: _steps(s, d).select("run", "seq", F.round("reward", 9).alias("reward")))
query(
    "arm_stats",
    """
        SELECT run, node, count(*) AS selections, round(CAST(sum(CAST(reward AS DECIMAL(20,8))) AS DOUBLE), 6) AS total_reward,
          round(100.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY run), 6) AS share_pct,
          round(CAST(sum(CAST(reward AS DECIMAL(20,8))) AS DOUBLE) / count(*), 6) AS mean_reward
        FROM rewarded
        GROUP BY run, node""",
    STEPS,
)(lambda s, d: decisions.arm_stats(_steps(s, d)))
UCB_SQL = """
, arms AS (SELECT DISTINCT run, node FROM steps),
e AS (
  SELECT s.run, s.seq, a.node, a.node = s.node AS chosen, CASE WHEN a.node = s.node THEN CAST(reward AS DECIMAL(20,8)) ELSE 0 END AS r,
         row_number() OVER (PARTITION BY s.run, a.node ORDER BY s.seq) - 1 AS n_before
  FROM rewarded s JOIN arms a ON a.run IS NOT DISTINCT FROM s.run),
t AS (
  SELECT *, coalesce(CAST(sum(chosen::INT) OVER o AS BIGINT), 0) AS tried, coalesce(CAST(sum(r) OVER o AS DOUBLE), 0) AS total
  FROM e WINDOW o AS (PARTITION BY run, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run, seq, node, chosen, tried,
       CASE WHEN tried > 0 THEN round(total / tried + sqrt(2.0e0) * sqrt(ln(CAST(n_before + 1 AS DOUBLE)) / tried), 6) ELSE 1.7976931348623157e308 END AS bound,
       CASE WHEN min(tried) OVER (PARTITION BY run, seq) < 2 THEN 'EXPLORATION' ELSE 'EXPLOITATION' END AS phase
FROM t"""
#: The run of errors has no name.
NAMELESS = STEPS.replace("event_type AS run", "nullif(event_type, 'error') AS run")
_nameless = lambda s, d: _steps(s, d).withColumn("run", F.nullif("run", F.lit("error")))
query("ucb_scores", UCB_SQL, NAMELESS)(lambda s, d: decisions.ucb_scores(_nameless(s, d)))
BUCKET = "CASE WHEN {c} < 30 THEN 'LOW' WHEN {c} <= 70 THEN 'MED' ELSE 'HIGH' END"
query(
    "state_bucket",
    f"""
        SELECT tick, {BUCKET.format(c='mean')} || '_' || {BUCKET.format(c='most')} AS state
        FROM (SELECT tick, CAST(sum(CAST(cpu_pct AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS mean, max(cpu_pct) AS most
        FROM load
        GROUP BY 1)""",
    LOAD,
)(lambda s, d: decisions.states(_load(s, d)))
query(
    "epsilon_schedule",
    f"""
        SELECT run, seq, state, visits, round(greatest(0.05e0, 1 / sqrt(CAST(visits AS DOUBLE))), 6) AS epsilon
        FROM (SELECT *, count(*) OVER (PARTITION BY run, state ORDER BY seq) AS visits
        FROM (SELECT run, seq, {BUCKET.format(c='cpu')} AS state
        FROM steps))""",
    STEPS,
)(lambda s, d: decisions.epsilon_schedule(_steps(s, d).withColumn("state", scores.bucket(F.col("cpu")))))
query(
    "td_audit",
    """
        SELECT run, seq, round(q + 0.2e0 * (reward + 0.8e0 * q_next - q), 6) AS q_due, round(abs(reward - (q + 0.2e0 * (reward + 0.8e0 * q_next - q))), 6) AS off
        FROM (SELECT *, cpu / 100.0e0 AS q, seq % 7 / 7.0e0 AS q_next
        FROM rewarded)""",
    STEPS,
)(
    lambda s, d: decisions.td_audit(_steps(s, d).select("run", "seq", "reward", (F.col("cpu") / 100.0).alias("q"), (F.col("seq") % 7 / 7.0).alias("q_next"), F.col("reward").alias("q_new"))).select(
        "run",
        "seq",
        "q_due",
        "off",
    )
)
SNAP = "SELECT run, node, arg_max(cpu, seq) AS q FROM steps GROUP BY 1, 2"
query("q_snapshot", SNAP, STEPS)(lambda s, d: _steps(s, d).groupBy("run", "node").agg(F.max_by("cpu", "seq").alias("q")))
query(
    "top_q",
    f"SELECT * FROM ({SNAP}) ORDER BY q DESC, run, node LIMIT 10",
    STEPS,
)(
    lambda s, d: _steps(s, d).groupBy("run", "node").agg(F.max_by("cpu", "seq").alias("q")).orderBy(F.desc("q"), "run", "node").limit(10)
)
REGIME = "CASE WHEN cpu > 60 THEN 'BANDIT' WHEN cpu > 30 THEN 'LEAST_LOADED' ELSE 'FCFS' END"
query(
    "regime",
    f"SELECT run, seq, {REGIME} AS regime FROM steps",
    STEPS,
)(lambda s, d: _steps(s, d).select("run", "seq", scores.regime(F.col("cpu")).alias("regime")))
query(
    "regime_changes",
    f"""
        SELECT *
        FROM (SELECT run, seq, lag({REGIME}) OVER (PARTITION BY run ORDER BY seq) AS from_regime, {REGIME} AS to_regime
        FROM steps)
        WHERE from_regime <> to_regime""",
    STEPS,
)(lambda s, d: decisions.regime_changes(_steps(s, d)))
COOLDOWN_SQL = f"""
, r AS (SELECT run, seq, ts, {REGIME} AS regime FROM steps),
c(run, seq, ts, from_regime, to_regime) AS (
  SELECT run, seq, NULL::TIMESTAMP, NULL::VARCHAR, regime FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS nth FROM r) WHERE nth = 1
  UNION ALL
  SELECT n.run, n.seq, n.ts, n.was, n.regime FROM (
    SELECT r.*, c.to_regime AS was, row_number() OVER (PARTITION BY r.run ORDER BY r.seq) AS k
    FROM c JOIN r ON r.run IS NOT DISTINCT FROM c.run AND r.seq > c.seq AND r.regime <> c.to_regime AND (c.ts IS NULL OR r.ts - c.ts >= INTERVAL '3600 seconds')) n
  WHERE k = 1)
SELECT run, seq, from_regime, to_regime FROM c WHERE from_regime IS NOT NULL"""
query("regime_cooldown", COOLDOWN_SQL, "RECURSIVE " + NAMELESS)(lambda s, d: decisions.regime_cooldown(_nameless(s, d), 3600))
query(
    "decision_stats",
    """
        SELECT event_type AS strategy, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
        FROM bids
        GROUP BY 1""",
)(lambda s, d: compare.shares(_bids(s, d).select(F.col("event_type").alias("strategy")), "strategy"))

# --- records of runs, written as JSON and text from events and read back
USERS = """
  u AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 100) AS hi, CAST(max(event_id) AS BIGINT) * 7 + 1 AS ms, CAST(max(event_id) % 977 + 1 AS BIGINT) AS dur
  FROM events
  WHERE user_id IS NOT NULL
  GROUP BY 1)"""


def _users(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet").where("user_id is not null")
    high, last = F.count_if(F.col("value") > 100), F.max("event_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), high.alias("hi"), (last * 7 + 1).alias("ms"), (last % 977 + 1).alias("dur"))


def _jobs(s: SparkSession, d: str, users: DataFrame | None = None, name: Column | None = None) -> DataFrame:
    def vertex(name: str, came, went):
        metrics = F.struct(came.alias("read-records"), went.alias("write-records"), F.col("ms").alias("accumulated-backpressured-time"), F.col("hi").alias("accumulated-idle-time"))
        return F.struct(F.lit(name).alias("name"), F.lit(4).alias("parallelism"), metrics.alias("metrics"))

    none, n, hi = F.lit(0).cast("bigint"), F.col("n"), F.col("hi")
    parts = F.array(
        vertex("Source: Bid Generator", none, n), vertex("Filter: High Value -> Transform: EUR", n, hi),
        vertex("Window: Tumbling", hi, n - hi), vertex("Sink: Console", n - hi, none),
    )
    ms = F.col("ms")
    times = ms.alias("start-time"), (ms * 2).alias("end-time"), F.col("dur").alias("duration")
    record = F.struct(F.col("user_id").cast("string").alias("jid"), (F.lit("job") if name is None else name).alias("name"), F.lit("FINISHED").alias("state"), *times, parts.alias("vertices"))
    return (users or _users(s, d)).select(F.from_json(F.to_json(record), artifacts.JOB).alias("j")).select("j.*")


query(
    "job_header",
    f"""
        WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS jid, 'job' AS name, 'FINISHED' AS state, ms AS started, ms * 2 AS ended,
          (dur // 10) / 100.0e0 AS duration_sec
        FROM u""",
    "",
)(lambda s, d: artifacts.header(_jobs(s, d)))
query(
    "job_json_explode",
    f"""
        WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS jid, pos, records_in, records_out
        FROM (SELECT user_id, 0 AS pos, 0 AS records_in, n AS records_out
        FROM u
        UNION ALL SELECT user_id, 1, n, hi
        FROM u
        UNION ALL SELECT user_id, 2, hi, n - hi
        FROM u
        UNION ALL SELECT user_id, 3, n - hi, 0
        FROM u)""",
    "",
)(lambda s, d: artifacts.vertices(_jobs(s, d)).select("jid", "pos", "records_in", "records_out"))
query(
    "vertex_classify",
    f"""
        WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS jid, unnest(['source', 'filter', 'window', 'sink']) AS kind
        FROM u""",
    "",
)(
    lambda s, d: artifacts.vertices(_jobs(s, d)).select("jid", artifacts.vertex_class(F.col("vertex")).alias("kind"))
)
query(
    "processed_events",
    f"""
        WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS jid, CASE WHEN hi > 0 THEN hi ELSE n END AS processed,
          CASE WHEN hi > 0 THEN 'filter' ELSE 'source' END AS stage
        FROM u""",
    "",
)(
    lambda s, d: artifacts.processed(artifacts.by_class(artifacts.vertices(_jobs(s, d)))).select("jid", "processed", "stage")
)
query(
    "throughput",
    f"""
        WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS jid, (CASE WHEN hi > 0 THEN hi ELSE n END) * 1000 // dur AS throughput
        FROM u""",
    "",
)(
    lambda s, d: artifacts.processed(artifacts.by_class(artifacts.vertices(_jobs(s, d)))).select("jid", "throughput")
)
query(
    "filter_selectivity",
    f"WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS jid, (hi * 1000 // n) / 10.0e0 AS pct FROM u",
    "",
)(
    lambda s, d: artifacts.by_class(artifacts.vertices(_jobs(s, d))).select(
        "jid",
        artifacts.selectivity(F.col("filter_out"), F.col("filter_in")).alias("pct"),
    )
)
query(
    "backpressure",
    f"""
        WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS jid, unnest(range(4))::INT AS pos, ms AS backpressured_ms, hi AS idle_ms
        FROM u""",
    "",
)(lambda s, d: artifacts.vertices(_jobs(s, d)).select("jid", "pos", "backpressured_ms", "idle_ms"))
query("latest_job", f"WITH {USERS} SELECT CAST(arg_max(user_id, ms) AS VARCHAR) AS jid FROM u", "")(lambda s, d: artifacts.latest(_jobs(s, d)))


def _lines(s: SparkSession, d: str, *parts) -> DataFrame:
    return _users(s, d).select((F.col("user_id") % 10).alias("run"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("line"))


_n = lambda c: F.format_number(F.col(c) * 1000, 0)
query(
    "parse_source_log",
    f"""
        WITH {USERS}, g AS (SELECT user_id % 10 AS run, CAST(sum(n * 1000) AS BIGINT) AS generated, CAST(sum(hi * 1000) AS BIGINT) AS emitted,
          CAST(sum((n - hi) * 1000) AS BIGINT) AS dropped
        FROM u
        GROUP BY 1) SELECT run, generated, emitted, dropped, (dropped * 10000 // generated) / 100.0e0 AS drop_pct
        FROM g""",
    "",
)(
    lambda s, d: artifacts.source_log(
        _lines(s, d, "[Source-1] FINALIZADO en 90.1s: generated=", _n("n"), ", emitted=", _n("hi"), ", dropped=", F.format_number((F.col("n") - F.col("hi")) * 1000, 0), " (0.0%)"),
    )
)
query(
    "parse_latency_log",
    f"""
        WITH {USERS} SELECT run, CAST(round_even(avg(n), 0) AS BIGINT) AS p50, CAST(round_even(avg(n + 5), 0) AS BIGINT) AS p95,
          CAST(round_even(avg(n + 9), 0) AS BIGINT) AS p99, round_even(avg(n + 0.0e0), 1) AS avg, round_even(sum(n * n) / sum(n + 0.0e0), 1) AS weighted_avg
        FROM (SELECT user_id % 10 AS run, n
        FROM u)
        GROUP BY 1""",
    "",
)(
    lambda s, d: artifacts.latency_log(
        _lines(s, d, "[Latency-TOTAL-0] FINAL count=", F.col("n"), " min=1ms p50=", F.col("n"), "ms p95=", F.col("n") + 5, "ms p99=", F.col("n") + 9, "ms max=9ms avg=", F.col("n"), ".0ms"),
    )
)
query(
    "parse_sink_log",
    f"WITH {USERS} SELECT user_id % 10 AS run, n AS records, hi AS rate FROM u",
    "",
)(
    lambda s, d: artifacts.sink_log(_lines(s, d, "[Sink-0] records=", F.col("n"), " rate=", F.col("hi"), "/s"))
)
query(
    "parse_selections",
    f"""
        WITH {USERS} SELECT user_id % 10 AS run, 'node-' || user_id AS node, hi + 0.0e0 AS cpu, 0.5e0 AS reward, n AS total
        FROM u""",
    "",
)(
    lambda s, d: artifacts.selection_log(
        _lines(s, d, "[BANDIT] [SELECTION] Node: node-", F.col("user_id"), " | Reason: EXPLORATION | CPU: ", F.col("hi"), ".0% | Reward: 0.5 | Total: ", F.col("n"), " | Arm: 1"),
    )
)
query(
    "parse_td_updates",
    f"""
        WITH {USERS} SELECT user_id % 10 AS run, 'LOW_LOW' AS state, hi AS action, 0.5e0 AS reward, 0.5e0 AS q, n + 0.25e0 AS q_new
        FROM u""",
    "",
)(
    lambda s, d: artifacts.td_log(
        _lines(s, d, "[SARSA] [UPDATE] s=LOW_LOW a=", F.col("hi"), " r=0.5 s'=LOW_LOW a'=1  Q: 0.5000 -> ", F.col("n"), ".2500"),
    )
)
query(
    "parse_node_metrics",
    f"WITH {USERS} SELECT 'node-' || user_id AS node, n + 0.0e0 AS millicores, hi * 1048576 AS bytes FROM u",
    "",
)(
    lambda s, d: _lines(s, d, "node-", F.col("user_id"), "   ", F.col("n"), "m   19%   ", F.col("hi"), "Mi  24%").select(F.split("line", "\\s+").alias("c")).select(
        F.col("c")[0].alias("node"),
        quantities.millicores(F.col("c")[1]).alias("millicores"),
        quantities.memory_bytes(F.col("c")[3]).alias("bytes"),
    )
)
PLACED = f"WITH {USERS}, p AS (SELECT user_id % 10 AS run, 'n' || (n % 4) AS node, count(*) AS pods FROM u GROUP BY 1, 2) "


def _placement(s: SparkSession, d: str) -> DataFrame:
    return artifacts.placement(_lines(s, d, "pod-", F.col("user_id"), "  1/1  Running  0  5m  10.0.0.1  n", F.col("n") % 4, "  <none>"))


query("placement_counts", PLACED + "SELECT * FROM p", "")(lambda s, d: _placement(s, d))
query(
    "placement_balance",
    PLACED + "SELECT run, count(*) AS nodes_used, CAST(sum(pods) AS BIGINT) AS pods, CASE count(*) WHEN 1 THEN 'unbalanced' WHEN 3 THEN 'balanced' ELSE 'partial' END AS balance FROM p GROUP BY 1",
    "",
)(lambda s, d: artifacts.balance(_placement(s, d)))


def _texts(s: SparkSession, d: str, *parts) -> DataFrame:
    """A text for each hundred users, so none grows with the table."""
    lines = _lines(s, d, *parts).withColumn("k", F.regexp_extract("line", "#(\\d+)", 1).cast("long")).withColumn("run", F.expr("k div 100"))
    return lines.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "").alias("text"))


query(
    "parse_decisions",
    f"""
        WITH {USERS} SELECT user_id // 100 AS run, row_number() OVER (PARTITION BY user_id // 100 ORDER BY user_id) AS seq, 'p#' || user_id AS pod,
          'FCFS' AS strategy, CASE WHEN n % 2 = 0 THEN 'n1' END AS node, hi + 0.5e0 AS cpu
        FROM u""",
    "",
)(
    lambda s, d: artifacts.decisions(
        _texts(s, d, "[SCHEDULING] Pod: p#", F.col("user_id"), "\n  Strategy: FCFS\n", F.when(F.col("n") % 2 == 0, "  Result: SCHEDULED to n1\n").otherwise(""), "  Node CPU: ", F.col("hi"), ".5% (real)\n"),
    )
)
query(
    "parse_switches",
    f"""
        WITH {USERS} SELECT user_id // 100 AS run, row_number() OVER (PARTITION BY user_id // 100 ORDER BY user_id) AS seq, 'FCFS' AS from_strategy,
          'B#' || user_id AS to_strategy, hi + 0.5e0 AS cpu, TIMESTAMP '2025-11-27 22:38:18' AS at
        FROM u""",
    "",
)(
    lambda s, d: artifacts.switches(
        _texts(s, d, "[STRATEGY SWITCH]\n  From: FCFS\n  To: B#", F.col("user_id"), "\n  Reason: Cluster CPU = ", F.col("hi"), ".5%\n  Time: 2025-11-27 22:38:18\n"),
    )
)
query(
    "parse_job_name",
    f"WITH {USERS} SELECT user_id, n || 'k' AS rate, CAST(hi AS VARCHAR) AS par FROM u",
    "",
)(
    lambda s, d: _users(s, d).select("user_id", artifacts.job_name(F.concat(F.lit(NAME_HEAD), F.lit("[rate="), F.col("n"), F.lit("k,par="), F.col("hi"), F.lit(",win=TUM-10s]"))).alias("m")).select(
        "user_id",
        F.col("m")["rate"].alias("rate"),
        F.col("m")["par"].alias("par"),
    )
)
query(
    "metrics_csv_repair",
    f"""
        WITH {USERS} SELECT user_id AS run, 4 AS n_names, 4 AS n_values, CAST(n AS VARCHAR) AS a, '0' AS c, CAST(ms AS VARCHAR) AS d
        FROM u""",
    "",
)(
    lambda s, d: artifacts.repair_csv(_users(s, d).select(F.col("user_id").alias("run"), F.concat(F.lit("a,b,c,d\n"), F.col("n"), F.lit(","), F.col("hi"), F.lit(",0\n0,"), F.col("ms"), F.lit("\n")).alias("text"))).select(
        "run",
        F.size("names").alias("n_names"),
        F.size("values").alias("n_values"),
        F.col("values")[0].alias("a"),
        F.col("values")[2].alias("c"),
        F.col("values")[3].alias("d"),
    )
)

# --- comparison: strategy is the user's remainder, distribution the event type; latency is the price in cents
RUNS = MS.replace("SELECT event_type, CAST", "SELECT 's' || (auction_id % 5) AS strategy, price, event_id, event_type AS distribution, CAST") + """,
runs AS (
  SELECT strategy, distribution, count(*) AS throughput, max(event_id) AS seq,
         """ + _picked("0.95", "p95") + ", " + _picked("0.99", "p99") + """,
         round(100.0e0 * count(*) FILTER (price > 100) / count(*), 2) AS drop_pct,
         round(100.0e0 * count(*) FILTER (ms > 15000) / count(*), 2) AS stale_pct
  FROM l GROUP BY ALL)"""


def _runs(s: SparkSession, d: str, late: bool = False) -> DataFrame:
    """A row per strategy and distribution; late: with percentiles."""
    strategy, ms = F.concat(F.lit("s"), (F.col("auction_id") % 5).cast("string")), F.round(F.col("price") * 100).cast("bigint")
    rows = _bids(s, d).select(strategy.alias("strategy"), F.col("event_type").alias("distribution"), ms.alias("ms"), "price", "event_id").withColumn("run", F.concat_ws("/", "strategy", "distribution"))
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 2)
    counts = rows.groupBy("run", "strategy", "distribution").agg(
        F.count("*").alias("throughput"), F.max("event_id").alias("seq"), share(F.col("price") > 100).alias("drop_pct"), share(F.col("ms") > 15000).alias("stale_pct")
    )
    return (counts.join(latency.percentiles(rows, "run", "ms").select("run", "p95", "p99"), "run") if late else counts).drop("run")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
for _name, _column in (("pivot_throughput", "throughput"), ("pivot_drop", "drop_pct"), ("pivot_p95", "p95"), ("pivot_p99", "p99")):
    _cells = ", ".join(f"max({_column}) FILTER (distribution = '{t}') AS \"{t}\"" for t in EVENT_TYPES)
    query(_name, f"SELECT strategy, {_cells} FROM runs GROUP BY 1", RUNS)(lambda s, d, c=_column: compare.matrix(_runs(s, d, c in ("p95", "p99")), c, list(EVENT_TYPES)))
WANTED = ["s0", "s1", "s2", "s9"]
COMPARED = """
  SELECT w.strategy, r.throughput, CASE WHEN r.throughput IS NULL THEN 'FAILED' ELSE 'FINISHED' END AS state
  FROM (SELECT unnest(['s0', 's1', 's2', 's9']) AS strategy) w
  LEFT JOIN (SELECT *
  FROM runs
  WHERE distribution = 'click') r USING (strategy)"""
query("compare_by_distribution", COMPARED, RUNS)(lambda s, d: compare.by_strategy(_runs(s, d), WANTED, "click"))
query(
    "run_outcomes",
    f"""
        SELECT count(*) FILTER (state = 'FINISHED') AS succeeded, count(*) FILTER (state <> 'FINISHED') AS failed, count(*) AS total
        FROM ({COMPARED})""",
    RUNS,
)(lambda s, d: compare.outcomes(compare.by_strategy(_runs(s, d), WANTED, "click")))
query(
    "gain_vs_baseline",
    """
        SELECT distribution, strategy,
          round(100.0e0 * (throughput / max(CASE WHEN strategy = 's0' THEN throughput END) OVER (PARTITION BY distribution) - 1), 6) AS gain_pct
        FROM runs""",
    RUNS,
)(lambda s, d: compare.gains(_runs(s, d), "s0", "throughput"))
query(
    "rank_strategies",
    """
        SELECT distribution, strategy, rank() OVER (PARTITION BY distribution ORDER BY throughput DESC) AS place
        FROM runs""",
    RUNS,
)(lambda s, d: compare.ranks(_runs(s, d), "throughput"))
query(
    "consolidate",
    """
        SELECT strategy, distribution, throughput, p95, NULL::BIGINT AS p99, 'old' AS layout
        FROM runs
        UNION ALL SELECT strategy, distribution, throughput, NULL, p99, 'new'
        FROM runs""",
    RUNS,
)(
    lambda s, d: compare.consolidate(
        {"old": _runs(s, d, True).select("strategy", "distribution", "throughput", "p95"), "new": _runs(s, d, True).select("strategy", "distribution", "throughput", "p99")},
    )
)


@query("plot_summary", "SELECT distribution, strategy, throughput, drop_pct, stale_pct FROM runs", RUNS)
def plot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of stale rows comes as text without a leading 0."""
    text = F.regexp_replace(F.col("stale_pct").cast("string"), "^0\\.", ".")
    return _runs(spark, sf_dir).select("distribution", "strategy", "throughput", "drop_pct", text.try_cast("double").alias("stale_pct"))
