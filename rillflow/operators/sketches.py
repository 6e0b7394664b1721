"""Percentiles from sketches that can be merged: figures of a stream's intervals, and of all up to an interval.

A sketch (KLL) is a binary column of some kilobytes, whatever it has seen. With K, the value given for a percentile is one whose
true rank is within ERROR of the asked one, as a share of all values, in 99 of 100 cases; with up to K values it's exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, ERROR = 1024, 0.005
#: What a sketch keeps beside the values, all of which add up over sketches.
FIGURES = {"n_rows": F.sum, "sum_ms": F.sum, "min_ms": F.min, "max_ms": F.max}


def sketched(rows: DataFrame, by: list[Column | str], value: str, k: int = K) -> DataFrame:
    """by, sketch and FIGURES of values of 0 or more (whole numbers; null and negative ones don't count). Tasks sketch before the shuffle."""
    known = F.col(value).cast("long")
    figures = F.count("*").alias("n_rows"), F.sum(known).alias("sum_ms"), F.min(known).alias("min_ms"), F.max(known).alias("max_ms")
    return rows.where(known >= 0).groupBy(*by).agg(F.kll_sketch_agg_bigint(known, F.lit(k)).alias("sketch"), *figures)


def percentiles(sketch: Column | str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> list[Column]:
    """p50, p95, p99 of a sketch, by the rule of exact percentiles: sorted[min(n - 1, int(n * p))]. They are that value as long as the
    sketch holds all values."""
    # the sketch takes the first value with a rank of p or more, and the rule the next one where n * p is whole
    return [F.kll_sketch_get_quantile_bigint(sketch, F.lit(p + 1e-7)).alias(f"p{round(p * 100)}") for p in shares]


def merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """One sketch and its figures for each of by, of rows that have these."""
    return rows.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), *(f(c).alias(c) for c, f in FIGURES.items()))


def along(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with the sketch and figures of all rows of the group up to and with this one. A group's rows, one an interval, are in one task."""
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(group, order, F.kll_merge_agg_bigint("sketch").over(so_far).alias("sketch"), *(f(c).over(so_far).alias(c) for c, f in FIGURES.items()))


def snapshots(rows: DataFrame, interval: str, group: str, value: str, k: int = K) -> DataFrame:
    """group, snapshot_at, n_rows, sum_ms, min_ms, max_ms, avg_ms, p50, p95, p99 of all values so far, at the end of each interval with rows.

    A sketch is made of each interval's values, and sketches are merged along the intervals: no task sees a group's values.
    """
    each = sketched(rows, [group, F.window("ts", interval).alias("w")], value, k).withColumn("snapshot_at", F.col("w.end"))
    found = along(each, group, "snapshot_at")
    return found.select(group, "snapshot_at", *FIGURES, (F.col("sum_ms") / F.col("n_rows")).alias("avg_ms"), *percentiles("sketch"))
