"""Utilisation and predicates of cluster nodes and pods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantities import estimated_cpu, utilisation

def pending(pods: DataFrame, scheduler: str) -> DataFrame:
    return pods.where((F.col("scheduler") == scheduler) & (F.col("node").isNull() | (F.col("node") == "")))


def eligible(nodes: DataFrame) -> DataFrame:
    """Ready and without a taint that keeps pods away. Nodes without conditions aren't ready; without taints are free."""
    ready = F.coalesce(F.exists("conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True")), F.lit(False))
    tainted = F.coalesce(F.exists("taints", lambda t: t["effect"].isin("NoSchedule", "NoExecute")), F.lit(False))
    return nodes.where(ready & ~tainted)


def node_cpu(usage: DataFrame, allocatable: DataFrame, default: float = 1000.0) -> DataFrame:
    """tick, node, pct: millicores used, of those of the node. usage: tick, node, used; allocatable: node, millicores.

    A node that isn't listed has `default` millicores.
    """
    met = usage.join(allocatable, "node", "left")
    return met.select("tick", "node", utilisation(F.col("used"), F.coalesce("millicores", F.lit(default)), 0.0).alias("pct"))


def node_memory(nodes: DataFrame, usage: DataFrame, missing: float = 50.0) -> DataFrame:
    """tick, node, pct of bytes. nodes: tick, node, bytes; usage: tick, node, used. Nodes without a sample have `missing`."""
    met = nodes.join(usage, ["tick", "node"], "left")
    return met.select("tick", "node", utilisation(F.col("used"), F.col("bytes"), missing).alias("pct"))


def with_estimates(pods: DataFrame, measured: DataFrame) -> DataFrame:
    """tick, node, pct: what was measured, else the estimate by the node's pods. pods: tick, node, pods; measured: tick, node, pct."""
    met = pods.join(measured, ["tick", "node"], "left")
    return met.select("tick", "node", F.coalesce("pct", estimated_cpu(F.col("pods"))).alias("pct"))


def cluster_average(ticks: DataFrame, cpu: DataFrame, missing: float = 50.0) -> DataFrame:
    """tick, pct: the mean over a tick's nodes, to 4 decimals before it is summed; `missing` for a tick without any."""
    mean = cpu.groupBy("tick").agg((F.sum(F.col("pct").cast("decimal(20,4)")).cast("double") / F.count("pct")).alias("pct"))
    return ticks.join(mean, "tick", "left").select("tick", F.coalesce("pct", F.lit(missing)).alias("pct"))
