"""Records that benchmark runs leave: job JSON, log lines, resource tables and metric CSVs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

# fixed values: the job record's fields
METRICS = "struct<`read-records`:bigint,`write-records`:bigint,`accumulated-backpressured-time`:bigint,`accumulated-idle-time`:bigint>"
JOB = f"jid string, name string, state string, `start-time` bigint, `end-time` bigint, duration bigint, vertices array<struct<name:string,parallelism:int,metrics:{METRICS}>>"
# fixed values: the classes of a vertex, first match first
CLASSES = (
    ("source", "Source: Bid Generator"), ("cpu", "CPU Load Simulator"), ("latency", "Latency Tracker"), ("filter", "Filter"),
    ("transform", "Transform"), ("window", "Window"), ("sink", "Sink"),
)


def header(jobs: DataFrame) -> DataFrame:
    return jobs.select("jid", "name", "state", F.col("start-time").alias("started"), F.col("end-time").alias("ended"), (F.floor(F.col("duration") / 10) / 100).alias("duration_sec"))


def vertices(jobs: DataFrame) -> DataFrame:
    """A row per vertex; counts that are missing are 0."""
    rows = jobs.select("jid", "duration", F.posexplode("vertices").alias("pos", "v"))
    count = lambda c: F.coalesce(F.col("v.metrics")[c], F.lit(0))
    return rows.select(
        "jid", "duration", "pos", F.col("v.name").alias("vertex"), F.col("v.parallelism").alias("parallelism"), count("read-records").alias("records_in"),
        count("write-records").alias("records_out"), count("accumulated-backpressured-time").alias("backpressured_ms"), count("accumulated-idle-time").alias("idle_ms"),
    )


def vertex_class(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, mark in reversed(CLASSES):
        out = F.when(F.contains(name, F.lit(mark)), label).otherwise(out)
    return out


def by_class(rows: DataFrame) -> DataFrame:
    """jid, duration and, for each class, the records out of its last vertex; for filters and sinks also those in."""
    kind = vertex_class(F.col("vertex"))
    last = lambda label, c: F.coalesce(F.max_by(F.when(kind == label, F.col(c)), F.when(kind == label, F.col("pos"))), F.lit(0))
    came, went = (last(label, "records_in").alias(f"{label}_in") for label in ("filter", "sink")), (last(label, "records_out").alias(f"{label}_out") for label, _ in CLASSES)
    return rows.groupBy("jid", "duration").agg(*went, *came)


def processed(rows: DataFrame) -> DataFrame:
    """processed, stage: of latency, transform, cpu and filter the first with records, else the source; and their rate.

    A job that processed nothing has no rate.
    """
    order = ("latency", "transform", "cpu", "filter")
    value, stage = F.col("source_out"), F.lit("source")
    for label in reversed(order):
        some = F.col(f"{label}_out") > 0
        value, stage = F.when(some, F.col(f"{label}_out")).otherwise(value), F.when(some, label).otherwise(stage)
    return rows.select("jid", value.alias("processed"), stage.alias("stage"), throughput(value, F.col("duration")).alias("throughput"))


def per_second(records: Column, duration_ms: Column) -> Column:
    """Whole records a second; null without a duration."""
    return F.when(duration_ms > 0, F.call_function("div", records.cast("long") * 1000, duration_ms.cast("long")))


def throughput(records: Column, duration_ms: Column) -> Column:
    return F.when(records > 0, per_second(records, duration_ms))


def selectivity(records_out: Column, records_in: Column) -> Column:
    return F.when(records_in > 0, F.floor(records_out * 1000 / records_in) / 10)


def latest(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.max_by("jid", "start-time").alias("jid"))


def number(line: Column, name: str, pattern: str = "[0-9,.]+") -> Column:
    """The number after name= in a line, commas left out; null if there is none."""
    found = F.regexp_extract(line, rf"(?:^|[\s(]){name}=({pattern})", 1)
    return F.when(found != "", F.rtrim(F.replace(found, F.lit(",")), F.lit(".")).try_cast("double"))


# fixed values: the words of a source's and a tracker's last line
SOURCE_END, TRACKER_END = "FINALIZADO", " FINAL "


def source_sums(line: Column) -> list[Column]:
    """Sums over the last lines of sources; null lines don't count."""
    return [F.sum(number(line, c).cast("long")).alias(c) for c in ("generated", "emitted", "dropped")]


def drop_share(generated: Column, dropped: Column) -> Column:
    """The part dropped in percent, cut to 2 decimals."""
    return F.when(generated > 0, F.floor(dropped * 10000 / generated) / 100).otherwise(0.0)


def source_log(lines: DataFrame) -> DataFrame:
    """Sums of the final lines of sources and the part dropped, cut to 2 decimals."""
    sums = lines.where(F.contains("line", F.lit(SOURCE_END))).groupBy("run").agg(*source_sums(F.col("line")))
    return sums.withColumn("drop_pct", drop_share(F.col("generated"), F.col("dropped")))


def latency_means(line: Column) -> dict[str, Column]:
    """Means over subtasks of their percentiles and averages; null lines don't count."""
    return {**{c: F.bround(F.avg(number(line, c)), 0).cast("long") for c in ("p50", "p95", "p99")}, "avg": F.bround(F.avg(number(line, "avg")), 1)}


def latency_log(lines: DataFrame) -> DataFrame:
    """Plain means over subtasks of their final percentiles and averages, and the mean weighted by their counts; halves go to even."""
    of = lambda c: number(F.col("line"), c)
    return lines.where(F.contains("line", F.lit(TRACKER_END))).groupBy("run").agg(
        *(c.alias(n) for n, c in latency_means(F.col("line")).items()),
        F.bround(F.sum(of("avg") * of("count")) / F.sum(of("count")), 1).alias("weighted_avg"),
    )


def sink_log(lines: DataFrame) -> DataFrame:
    return lines.select("run", number(F.col("line"), "records").cast("long").alias("records"), number(F.col("line"), "rate").cast("long").alias("rate"))


def blocks(texts: DataFrame, mark: str) -> DataFrame:
    """run, seq, block: what follows each mark in a text. What stands before the first mark was cut off and is left out."""
    parts = F.split("text", mark.replace("[", "\\[").replace("]", "\\]"))
    return texts.select("run", F.posexplode(parts).alias("seq", "block")).where("seq > 0")


def _after(name: str, pattern: str = "[^\\n]*") -> Column:
    found = F.regexp_extract("block", f"{name}: ({pattern})", 1)
    return F.when(found != "", found)


def decisions(texts: DataFrame) -> DataFrame:
    node = F.regexp_extract("block", "SCHEDULED to (\\S+)", 1)
    return blocks(texts, "[SCHEDULING]").select(
        "run", F.col("seq").cast("long").alias("seq"), _after(" Pod", "\\S+").alias("pod"), _after("Strategy", "\\S+").alias("strategy"),
        F.when(node != "", node).alias("node"), _after("Node CPU", "[0-9.]+").try_cast("double").alias("cpu"),
    )


def switches(texts: DataFrame) -> DataFrame:
    cpu = F.regexp_extract("block", "CPU = ([0-9.]+)", 1)
    return blocks(texts, "[STRATEGY SWITCH]").select(
        "run", F.col("seq").cast("long").alias("seq"), _after("From", "\\S+").alias("from_strategy"), _after("To", "\\S+").alias("to_strategy"),
        cpu.try_cast("double").alias("cpu"), _after("Time").try_cast("timestamp_ntz").alias("at"),
    )


def numbered(lines: DataFrame, mark: str) -> DataFrame:
    """run, seq, at, line of lines (run, at, line) that belong to a block: one begins with each line that holds the mark.

    A run's lines may be many and lie in many tasks; a block goes on over the end of a task's part. Lines before a run's first
    mark are the rest of a block that was cut off, and are left out.
    """
    begins = F.contains("line", F.lit(mark)).cast("int")
    rows = running(lines.select("run", "at", "line"), ["run"], "at", {"_marks": begins})
    return rows.withColumn("seq", (F.col("_marks") + begins).cast("long")).where("seq > 0").select("run", "seq", "at", "line")


def _first(pattern: str) -> Column:
    """What the pattern's group takes from the first line of a block that has it."""
    found = F.regexp_extract("line", pattern, 1)
    return F.min_by(F.when(found != "", found), F.when(found != "", F.col("at")))


def decision_lines(lines: DataFrame) -> DataFrame:
    """decisions() of lines (run, at, line) in any number of splits; a block's fields are picked line by line, so it may have any length."""
    return numbered(lines, "[SCHEDULING]").groupBy("run", "seq").agg(
        _first(" Pod: (\\S+)").alias("pod"), _first("Strategy: (\\S+)").alias("strategy"), _first("SCHEDULED to (\\S+)").alias("node"), _first("Node CPU: ([0-9.]+)").try_cast("double").alias("cpu")
    )


def switch_lines(lines: DataFrame) -> DataFrame:
    """switches() of lines (run, at, line) in any number of splits."""
    return numbered(lines, "[STRATEGY SWITCH]").groupBy("run", "seq").agg(
        _first("From: (\\S+)").alias("from_strategy"), _first("To: (\\S+)").alias("to_strategy"), _first("CPU = ([0-9.]+)").try_cast("double").alias("cpu"),
        _first("Time: (.*)").try_cast("timestamp_ntz").alias("at_time"),
    ).withColumnRenamed("at_time", "at")


def selection_log(lines: DataFrame) -> DataFrame:
    of = lambda name, p: F.regexp_extract("line", f"{name}: ({p})", 1)
    number_of = lambda name: of(name, "[0-9.]+").try_cast("double")
    return lines.where(F.contains("line", F.lit("[SELECTION]"))).select(
        "run", of("Node", "\\S+").alias("node"), number_of("CPU").alias("cpu"), number_of("Reward").alias("reward"), of("Total", "[0-9]+").try_cast("long").alias("total")
    )


def td_log(lines: DataFrame) -> DataFrame:
    of = lambda p: F.regexp_extract("line", p, 1)
    return lines.where(F.contains("line", F.lit("[UPDATE]"))).select(
        "run", of(" s=(\\S+)").alias("state"), of(" a=(\\d+)").try_cast("long").alias("action"), of(" r=([0-9.]+)").try_cast("double").alias("reward"),
        of("Q: ([0-9.]+)").try_cast("double").alias("q"), of("-> ([0-9.]+)").try_cast("double").alias("q_new"),
    )


def node_of(line: Column) -> Column:
    """The seventh column of a placement table's line."""
    return F.get(F.split(F.trim(line), "\\s+"), F.lit(6))


def placement(lines: DataFrame) -> DataFrame:
    """Pods of each node, from the seventh column of a placement table without its heading."""
    return lines.where(~F.startswith(F.trim("line"), F.lit("NAME"))).select("run", node_of(F.col("line")).alias("node")).where("node is not null").groupBy("run", "node").agg(F.count("*").alias("pods"))


def balance(pods: DataFrame) -> DataFrame:
    used = F.count("*")
    label = F.when(used == 1, "unbalanced").when(used == 3, "balanced").otherwise("partial")
    return pods.groupBy("run").agg(used.alias("nodes_used"), F.sum("pods").alias("pods"), label.alias("balance"))


def job_name(name: Column) -> Column:
    """The settings in a run name, as a map."""
    return F.str_to_map(F.regexp_extract(name, "\\[([^\\]]*)\\]", 1), F.lit(","), F.lit("="))


def repair_csv(texts: DataFrame) -> DataFrame:
    """run and values of each record of metric CSVs whose records were broken by a stray line feed.

    A file is its heading and one record. Lines after the record's first begin with a repeat of the field before, which
    goes; the values are as many as the heading's fields.
    """
    lines = F.filter(F.split("text", "\r?\n"), lambda x: x != "")
    rest = F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: F.regexp_replace(x, "^[^,]*,?", ""))
    joined = F.array_join(F.filter(F.concat(F.slice(lines, 2, 1), rest), lambda x: x != ""), ",")
    return texts.select("run", F.split(F.get(lines, F.lit(0)), ",").alias("names"), F.split(joined, ",").alias("values"))
