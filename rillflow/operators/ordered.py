"""Sums and values over earlier rows of a group, for groups that may hold most of a table.

A window by group would put a whole group in one task. Rows are sorted by range over all partitions instead, so that a
large group spans many; each group's part of a partition is summed up, these few sums run over the partitions, and
each row adds what its part has before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored


def _met(own: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """own with what parts has for its group and partition; a null is a group like any other."""
    named = parts.toDF(*(f"_of_{c}" if c in (*by, "_part") else c for c in parts.columns))
    same = F.lit(True)
    for c in (*by, "_part"):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return own.join(named, same)


def dealt(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with _part, the range of (by, order) that they are in."""
    return stored(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column], tied: tuple[str, ...] = ()) -> DataFrame:
    """rows with a column for each of sums: its total over the group's rows before this one, 0 for the first.

    Rows with the same order come in any sequence. Names of sums in tied, of values of 0 or more, have a column name_tied as well: the
    total before all rows with the same order, which are in one task. Sums of doubles depend on the partitions in their last
    digits; give decimals.
    """
    placed = dealt(rows, by, order)
    parts = placed.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", *(F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()))
    # equal orders are in one range, and rows lie sorted for this window already
    own = own.withColumns({f"{n}_tied": F.min(n).over(Window.partitionBy(*by, "_part", order)) for n in tied})
    totals = [(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums] + [(F.col(f"{n}_tied") + F.col(f"_{n}")).alias(f"{n}_tied") for n in tied]
    return _met(own, parts, by).select(*rows.columns, *totals)


def previous(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows with `name`: value in the group's row before this one, null for the first."""
    placed = dealt(rows, by, order)
    last = placed.groupBy(*by, "_part").agg(F.max_by(F.struct(value), order).alias("_last"))
    last = last.select(*by, "_part", F.lag("_last").over(Window.partitionBy(*by).orderBy("_part"))[value].alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy(order)
    own = placed.withColumn("_nth", F.row_number().over(inside)).withColumn("_own", F.lag(value).over(inside))
    return _met(own, last, by).select(*rows.columns, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_own")).alias(name))
