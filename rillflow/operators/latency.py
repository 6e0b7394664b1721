"""Latency, throughput and loss figures."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored
from .ordered import dealt

SHARES = (0.5, 0.95, 0.99)


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """count, min, p50, p95, p99, max, sum and avg of values of 0 or more; p is sorted[min(n - 1, int(n * p))].

    Exact without a group's values in one task, however many are distinct. Counts by (group, value) combine before the
    shuffle and are sorted by range over all partitions. Counts of parts tell in which part a rank lies, and only that part is
    searched. A null group is a group like any other.
    """
    counts = rows.where(f"{value} >= 0").groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = dealt(counts, [group], "v")
    own = placed.groupBy(group, "_part").agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("v") * F.col("c")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    parts = own.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    ranks = [F.least(F.col("all") - 1, (F.col("all") * F.lit(p)).cast("long")) for p in SHARES]
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), r.alias("rank")) for k, r in enumerate(ranks))))
    wanted = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.col("upto") - F.col("n")).alias("before"), "upto", asked.alias("ask"))
    wanted = wanted.where("ask.rank >= before and ask.rank < upto")  # three rows a group
    searched = placed.join(wanted, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    passed = F.col("before") + F.sum("c").over(Window.partitionBy("_g", "_p", "ask.k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = searched.withColumn("passed", passed).where("passed > ask.rank").groupBy("_g")
    picked = found.agg(*(F.min(F.when(F.col("ask.k") == k, F.col("v"))).alias(f"p{round(p * 100)}") for k, p in enumerate(SHARES)))
    sums = parts.groupBy(group).agg(F.sum("n").alias("n_rows"), F.min("low").alias("min_ms"), F.max("high").alias("max_ms"), F.sum("total").alias("sum_ms"))
    met = sums.join(picked, F.col(group).eqNullSafe(F.col("_g")))
    return met.select(group, "n_rows", "min_ms", "p50", "p95", "p99", "max_ms", "sum_ms", (F.col("sum_ms") / F.col("n_rows")).alias("avg_ms"))


def approximate_percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    p = F.percentile_approx(value, [0.5, 0.95, 0.99], 10_000)
    return rows.where(f"{value} >= 0").groupBy(group).agg(p.alias("p")).select(group, *(F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


def reservoir(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """A uniform sample of k rows a group: the k lowest digests of key. The rank is cut inside each task before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def shed(rows: DataFrame, interval: str, capacity: int) -> DataFrame:
    """Generated, emitted and dropped rows of each interval under an admission cap."""
    counts = rows.groupBy(F.window("ts", interval).alias("w")).agg(F.count("*").alias("generated"))
    emitted = F.least("generated", F.lit(capacity))
    dropped = F.col("generated") - emitted
    return counts.select(F.col("w.start").alias("interval_start"), "generated", emitted.alias("emitted"), dropped.alias("dropped"), F.round(100.0 * dropped / F.col("generated"), 2).alias("drop_pct"))


def admitted(rows: DataFrame, interval: str, capacity: int) -> DataFrame:
    """The first `capacity` rows of each interval, by time and event_id."""
    order = Window.partitionBy(F.window("ts", interval)).orderBy("ts", "event_id")
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= capacity).drop("_rank")


def counters(rows: DataFrame, interval: str, seconds: int, capacity: int) -> DataFrame:
    """A source's counters at the end of each interval with rows: totals so far of rows generated, emitted and dropped, the
    interval's rates, and the part dropped so far (0 if none were generated).

    Intervals are summed up first; the running totals go over one row an interval, in one task.
    """
    each = shed(rows, interval, capacity).select("interval_start", "generated", "emitted", "dropped")
    so_far = Window.partitionBy().orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)
    totals = each.select(
        "interval_start", *(F.sum(c).over(so_far).alias(f"{c}_total") for c in ("generated", "emitted", "dropped")),
        *((F.col(c) / F.lit(float(seconds))).alias(f"{c}_per_sec") for c in ("generated", "emitted", "dropped")),
    )
    share = F.when(F.col("generated_total") > 0, F.round(100.0 * F.col("dropped_total") / F.col("generated_total"), 6)).otherwise(0.0)
    return totals.withColumn("drop_pct", share)


def snapshots(rows: DataFrame, interval: str, group: str, value: str) -> DataFrame:
    """Figures of a group so far, at the end of each interval in which it has rows."""
    figures = F.count("*").alias("c"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")
    sums = rows.groupBy(group, F.window("ts", interval).alias("w")).agg(*figures)
    so_far = Window.partitionBy(group).orderBy("w.start").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(
        group, F.col("w.end").alias("snapshot_at"), F.sum("c").over(so_far).alias("n_rows"), F.sum("s").over(so_far).alias("sum_ms"),
        F.min("lo").over(so_far).alias("min_ms"), F.max("hi").over(so_far).alias("max_ms"),
    )


def snapshot_percentiles(rows: DataFrame, interval: str, group: str, value: str) -> DataFrame:
    """group, snapshot_at, n_rows, min_ms, p50, p95, p99, max_ms, sum_ms, avg_ms of all values so far (but nulls), at the end of each interval in
    which the group has rows; p is sorted[min(n - 1, int(n * p))]. Exact, however many values there are.

    Counts by (group, interval, value) are sorted by range by value, and a run of about the square root of their number is a chunk. Sums by
    interval and chunk, run along intervals and then along chunks, tell in which chunk a snapshot's rank lies; only that chunk's
    counts up to the snapshot are searched. So a snapshot costs a few times that root, and no task sees a group's values. A null
    group is a group like any other.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.window("ts", interval).alias("w"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = counts.select("_g", F.col("w.end").alias("at"), "v", "c").repartitionByRange("_g", "v", "at").sortWithinPartitions("_g", "v", "at")
    placed = stored(placed.withColumn("pos", F.monotonically_increasing_id()))
    bits = max(10, ceil(log2(max(1, placed.count())) / 2))
    placed = placed.withColumn("chunk", F.shiftright("pos", bits))
    figures = F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("v") * F.col("c")).alias("total")
    own = stored(placed.groupBy("_g", "chunk", "at").agg(*figures))
    each = own.groupBy("_g", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
    so_far = Window.partitionBy("_g").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    snaps = each.select(
        F.col("_g").alias("_of"), F.col("at").alias("snapshot_at"), F.sum("n").over(so_far).alias("n_rows"), F.min("low").over(so_far).alias("min_ms"),
        F.max("high").over(so_far).alias("max_ms"), F.sum("total").over(so_far).alias("sum_ms"),
    )
    # every chunk of a group at every snapshot
    cells = own.select("_g", "chunk").distinct().join(snaps.select("_of", "snapshot_at", "n_rows"), F.col("_g").eqNullSafe(F.col("_of"))).drop("_of")
    new = own.select(F.col("_g").alias("_of"), F.col("chunk").alias("_chunk"), "at", "n")
    cells = cells.join(new, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("chunk") == F.col("_chunk")) & (F.col("snapshot_at") == F.col("at")), "left")
    along = Window.partitionBy("_g", "chunk").orderBy("snapshot_at").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("_g", "chunk", "snapshot_at", "n_rows", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("inside"))
    across = Window.partitionBy("_g", "snapshot_at").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("inside").over(across)).withColumn("before", F.col("upto") - F.col("inside"))
    ranks = [F.least(F.col("n_rows") - 1, (F.col("n_rows") * F.lit(p)).cast("long")) for p in SHARES]
    asks = F.array(*(F.struct(F.lit(k).alias("k"), r.alias("rank")) for k, r in enumerate(ranks)))
    here = F.filter(asks, lambda a: (a["rank"] >= F.col("before")) & (a["rank"] < F.col("upto")))
    wanted = cells.select(F.col("_g").alias("_of"), F.col("chunk").alias("_chunk"), "snapshot_at", "before", F.explode(here).alias("ask"))  # three rows a snapshot
    searched = placed.join(wanted, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("chunk") == F.col("_chunk")) & (F.col("at") <= F.col("snapshot_at")))
    passed = F.col("before") + F.sum("c").over(Window.partitionBy("_g", "snapshot_at", "ask.k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    found = searched.withColumn("passed", passed).where("passed > ask.rank").groupBy("_g", F.col("snapshot_at").alias("_at"))
    picked = found.agg(*(F.min(F.when(F.col("ask.k") == k, F.col("v"))).alias(f"p{round(p * 100)}") for k, p in enumerate(SHARES)))
    met = snaps.join(picked, F.col("_of").eqNullSafe(F.col("_g")) & (F.col("snapshot_at") == F.col("_at")))
    return met.select(
        F.col("_of").alias(group), "snapshot_at", "n_rows", "min_ms", "p50", "p95", "p99", "max_ms", "sum_ms", (F.col("sum_ms") / F.col("n_rows")).alias("avg_ms")
    )


def interval_rates(rows: DataFrame, interval: str, seconds: int, group: str) -> DataFrame:
    """Rows of each interval, rows a second, the change from the group's interval before, first and last time."""
    sums = rows.groupBy(group, F.window("ts", interval).alias("w")).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    before = F.lag("n_rows").over(Window.partitionBy(group).orderBy("w.start"))
    return sums.select(group, F.col("w.start").alias("interval_start"), "n_rows", (F.col("n_rows") / F.lit(float(seconds))).alias("per_second"), (F.col("n_rows") - before).alias("change"), "first_ts", "last_ts")


def final_rates(rows: DataFrame, group: str) -> DataFrame:
    """A sink's last line: rows of the whole run, and the times of the first and the last."""
    return rows.groupBy(group).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
