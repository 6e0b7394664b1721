"""A run's row of metrics: put together from the run's records, written, and read from the CSVs of several layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import artifacts

# fixed values: columns of the metrics files, by layout
FIRST = (
    "strategy job_id state duration_ms duration_sec source_records throughput filter_in filter_out filter_efficiency window_in window_out sink_in "
    "total_tms nodes_used scheduling_decisions strategy_switches"
).split()
FULL = (
    "strategy workload distribution rate duration_sec cpu_load parallelism state throughput_processed throughput_generated throughput_emitted "
    "processed_events total_generated total_dropped drop_pct nodes_used total_tms scheduling_decisions strategy_switches "
    "lat_proc_p50 lat_proc_p95 lat_proc_p99 lat_proc_avg lat_total_p50 lat_total_p95 lat_total_p99 lat_total_avg"
).split()
LAYOUTS = {"first": FIRST, "full": FULL, "aged": [*FULL, "max_event_age", "stale_dropped", "stale_pct"]}
TEXTS = ("strategy", "job_id", "workload", "distribution", "state")
DOUBLES = ("duration_sec", "filter_efficiency", "drop_pct", "lat_proc_avg", "lat_total_avg", "stale_pct")


def csv_records(texts: DataFrame) -> DataFrame:
    """run, record (from 0), layout and fields (a map of strings) of metrics files, which may hold any number of records.

    A counter that was written as two lines of 0 broke its record: the line feed and the second 0 go. So no record
    may begin with a field of 0; they begin with a strategy. A record's layout is told by its number of fields, since files
    of several layouts were put under one heading; "unknown" has no fields. Headings, wherever they stand, are left out.
    """
    glued = F.regexp_replace("text", "\\r?\\n0(?=,|\\r?\\n|$)", "")
    lines = F.filter(F.split(glued, "\\r?\\n"), lambda x: (x != "") & ~F.startswith(x, F.lit("strategy,")))
    rows = texts.select("run", F.posexplode(F.transform(lines, lambda x: F.split(x, ","))).alias("record", "values"))
    layout, fields = F.lit("unknown"), F.lit(None).cast("map<string,string>")
    for name, columns in LAYOUTS.items():
        fits = F.size("values") == len(columns)
        layout = F.when(fits, name).otherwise(layout)
        fields = F.when(fits, F.map_from_arrays(F.array(*map(F.lit, columns)), F.col("values"))).otherwise(fields)
    return rows.select("run", "record", layout.alias("layout"), fields.alias("fields"))


def consolidate_files(texts: DataFrame) -> DataFrame:
    """run, record, layout and every column of any layout with its type; what a layout lacks or marks as N/A is null."""
    names = list(dict.fromkeys([*LAYOUTS["aged"], *FIRST]))

    def typed(name: str) -> Column:
        value = F.col("fields")[name]
        return (value if name in TEXTS else value.try_cast("double" if name in DOUBLES else "long")).alias(name)

    return csv_records(texts).select("run", "record", "layout", *map(typed, names))


def settings(name: Column) -> dict[str, Column]:
    """rate, parallelism, cpu_load and distribution from a job's name; constant arrival isn't written there."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    of = F.coalesce(artifacts.job_name(name), none)
    rate = F.regexp_extract(of["rate"], "^(\\d+)k$", 1).try_cast("long") * 1000
    return {"rate": rate, "parallelism": of["par"].try_cast("long"), "cpu_load": of["cpu"].try_cast("long"), "distribution": F.coalesce(of["dist"], F.lit("CONSTANT"))}


def metrics_row(jobs: DataFrame, source: DataFrame, processing: DataFrame, total: DataFrame, placements: DataFrame, scheduler: DataFrame) -> DataFrame:
    """run and the columns of FULL: a row per job. jobs as read_jobs gives them; the others are lines (run, line).

    A figure whose file or line is missing is null; counts of pods, decisions and switches are then 0, as are source
    totals without final lines. Lines of all kinds are marked, put together and summed up by run in one shuffle; sums, a row a
    run, are joined to the jobs. A run has few nodes.
    """
    own = jobs.withColumn("jid", F.col("run"))
    duration = F.col("duration")
    head = own.select(
        "run", "workload", "strategy", "state", "duration", F.when(duration != 0, F.floor(duration / 10) / 100).alias("duration_sec"), *(c.alias(n) for n, c in settings(F.col("name")).items())
    )
    done = artifacts.processed(artifacts.by_class(artifacts.vertices(own))).withColumnRenamed("jid", "run").drop("stage")
    kinds = {"source": source, "proc": processing, "total": total, "placed": placements, "scheduler": scheduler}
    lines = reduce(DataFrame.unionByName, (df.select("run", "line", F.lit(kind).alias("kind")) for kind, df in kinds.items()))
    of = lambda kind, word="": F.when((F.col("kind") == kind) & F.contains("line", F.lit(word)), F.col("line"))
    node = F.when(~F.startswith(F.trim("line"), F.lit("NAME")), artifacts.node_of(of("placed")))
    late = [m.alias(f"lat_{kind}_{c}") for kind in ("proc", "total") for c, m in artifacts.latency_means(of(kind, artifacts.TRACKER_END)).items()]
    sums = lines.groupBy("run").agg(
        *artifacts.source_sums(of("source", artifacts.SOURCE_END)), *late, F.size(F.collect_set(node)).alias("nodes_used"), F.count(node).alias("total_tms"),
        F.count(of("scheduler", "[SCHEDULING]")).alias("scheduling_decisions"), F.count(of("scheduler", "STRATEGY SWITCH")).alias("strategy_switches"),
    )
    met = head.join(done, "run", "left").join(sums, "run", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("nodes_used", "total_tms", "scheduling_decisions", "strategy_switches")}
    generated, emitted, dropped = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("generated", "emitted", "dropped"))
    rate = lambda n: F.when(generated > 0, artifacts.per_second(n, duration))
    values = {
        **counts, "throughput_processed": F.col("throughput"), "throughput_generated": rate(generated), "throughput_emitted": rate(emitted),
        "processed_events": F.coalesce("processed", F.lit(0)).cast("long"), "total_generated": generated, "total_dropped": dropped,
        "drop_pct": F.when(generated > 0, artifacts.drop_share(generated, dropped)),
    }
    return met.select("run", *(values.get(c, F.col(c)).alias(c) for c in FULL))


def summary(texts: DataFrame) -> DataFrame:
    """run, state, duration_ms, decisions, switches, distribution of summary files: a label counts at its line's beginning only.

    The value may stand on the label's line or on the next one.
    """

    def after(label: str, value: str) -> Column:
        found = F.regexp_extract("text", f"(?m)^(?:- )?{label}:\\s*({value})", 1)
        return F.when(found != "", found)

    # fixed values: the labels of the files
    return texts.select(
        "run", after("Estado final", "\\S+").alias("state"), after("Duración", "\\d+(?= ms)").try_cast("long").alias("duration_ms"),
        after("Scheduling decisions", "\\d+").try_cast("long").alias("decisions"), after("Strategy switches", "\\d+").try_cast("long").alias("switches"),
        F.trim(after("Distribución de TaskManagers", "\\S[^\\n]*")).alias("distribution"),
    )


def write_metrics(rows: DataFrame, path: str) -> None:
    """CSV files with a heading, in folders by workload and strategy."""
    rows.write.partitionBy("workload", "strategy").option("header", True).csv(path)
