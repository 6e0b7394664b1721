"""Runs side by side: consolidation, matrices, ranks and gains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .artifacts import balance, throughput


def consolidate(layouts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all layouts by name of column, with the layout's name; columns that a layout lacks are null."""
    named = [df.withColumn("layout", F.lit(name)) for name, df in layouts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def by_strategy(runs: DataFrame, required: list[str], distribution: str) -> DataFrame:
    """A row for each required strategy, its latest run or FAILED. required is a short list."""
    wanted = runs.sparkSession.createDataFrame([(s,) for s in required], "strategy string")
    last = runs.where(F.col("distribution") == distribution).groupBy("strategy").agg(F.max_by("throughput", "seq").alias("throughput"))
    return F.broadcast(wanted).join(last, "strategy", "left").withColumn("state", F.when(F.col("throughput").isNull(), "FAILED").otherwise("FINISHED"))


def matrix(runs: DataFrame, value: str, distributions: list[str]) -> DataFrame:
    return runs.groupBy("strategy").pivot("distribution", distributions).agg(F.max(value))


def gains(runs: DataFrame, base: str, value: str) -> DataFrame:
    """Percent over the base strategy's value in the same distribution."""
    own = F.max(F.when(F.col("strategy") == base, F.col(value))).over(Window.partitionBy("distribution"))
    return runs.withColumn("gain_pct", F.round(100.0 * (F.col(value) / own - 1), 6)).select("distribution", "strategy", "gain_pct")


def ranks(runs: DataFrame, value: str) -> DataFrame:
    place = F.rank().over(Window.partitionBy("distribution").orderBy(F.col(value).desc()))
    return runs.select("distribution", "strategy", place.cast("long").alias("place"))


def outcomes(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("state") == "FINISHED").alias("succeeded"), F.count_if(F.col("state") != "FINISHED").alias("failed"), F.count("*").alias("total"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    found = rows.groupBy(by).agg(F.count("*").alias("n"))
    return found.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def high_load(jobs: DataFrame, pods: DataFrame, required: list[str]) -> DataFrame:
    """strategy, state, throughput, duration_sec, distribution, balance: a row for each required strategy.

    jobs: strategy and a job's fields; pods: strategy, node, pods. The throughput is that of the job's first vertex; the
    distribution lists pods and node by node; a strategy without a job has the state below and nothing else. required
    is a short list.
    """
    wanted = jobs.sparkSession.createDataFrame([(s,) for s in required], "strategy string")
    first = F.get("vertices", F.lit(0))["metrics"]["write-records"]
    ran = jobs.select(
        "strategy", "state", throughput(F.coalesce(first, F.lit(0)), F.col("duration")).alias("throughput"), (F.floor(F.coalesce("duration", F.lit(0)) / 100) / 10).alias("duration_sec")
    )
    each = F.array_sort(F.collect_list(F.struct("node", "pods")))
    spread = pods.groupBy("strategy").agg(F.array_join(F.transform(each, lambda x: F.concat_ws(" ", x["pods"], x["node"])), " ").alias("distribution"))
    even = balance(pods.withColumnRenamed("strategy", "run")).select(F.col("run").alias("strategy"), "balance")
    met = F.broadcast(wanted).join(ran, "strategy", "left").join(spread, "strategy", "left").join(even, "strategy", "left")
    missing = F.col("state").isNull()
    # fixed value: the state of a run that isn't there
    return met.select(
        "strategy", F.when(missing, "No ejecutado").otherwise(F.col("state")).alias("state"),
        *(F.when(~missing, F.col(c)).alias(c) for c in ("throughput", "duration_sec", "distribution", "balance")),
    )


def markdown(frame: DataFrame, most: int = 200) -> str:
    """A comparison table as text; "-" stands for null. Tables of more than `most` rows are refused, not cut."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are not a comparison table")
    lines = [frame.columns, ["---"] * len(frame.columns), *([("-" if v is None else str(v)) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
