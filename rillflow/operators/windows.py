"""Windows of static rows that neither copy a row for each window nor need a key's rows in one task.

Both work on partial results (sum, count, greatest, least), of which every aggregate of the pipeline is made.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import dealt

MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(interval: str) -> int:
    """'90 seconds' or '1 hour 30 minutes' in microseconds; months have no fixed length and raise ValueError."""
    text = interval.strip().lower()
    parts = re.findall(r"(\d+)\s+([a-z]+?)s?(?=\s|$)", text)
    if not re.fullmatch(r"\d+\s+[a-z]+(\s+\d+\s+[a-z]+)*", text) or any(unit not in MICROS for _, unit in parts):
        raise ValueError(f"{interval!r} isn't a number of {', '.join(MICROS)}")
    return sum(int(n) * MICROS[unit] for n, unit in parts)


def partial(amount: str = "amount") -> list[Column]:
    """Sums are exact to 5 decimals."""
    value = F.col(amount)
    return [F.sum(value.cast("decimal(20,5)")).alias("_sum"), F.count("*").alias("_rows"), F.count(value).alias("_n"), F.max(value).alias("_most"), F.min(value).alias("_least")]


def merged() -> list[Column]:
    return [F.sum("_sum").alias("_sum"), F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"), F.max("_most").alias("_most"), F.min("_least").alias("_least")]


def value(name: str) -> Column:
    """An aggregate of the pipeline from merged partial results."""
    total = F.col("_sum").cast("double")
    known = {"sum": total, "avg": total / F.when(F.col("_n") > 0, F.col("_n")), "count": F.col("_rows").cast("double"), "max": F.col("_most"), "min": F.col("_least")}
    if name not in known:
        raise ValueError(f"unknown aggregate {name!r}")
    return known[name].alias("value")


def sliding(rows: DataFrame, size: str, slide: str) -> DataFrame:
    """auction_id, window_start, window_end and partial results, by panes.

    A pane is the greatest span that windows' bounds are multiples of. Rows are summed up by key and pane before they are dealt
    out; a key's panes are then spread to their windows where they lie, so what is dealt out doesn't grow with size / slide. Windows
    begin at multiples of slide since 1970, as Spark's do. A key's panes, a row each, are in one task.
    """
    long, step = micros(size), micros(slide)
    pane, kind = math.gcd(long, step), dict(rows.dtypes)["ts"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    panes = rows.where("ts is not null").groupBy("auction_id", (at - F.pmod(at, F.lit(pane))).alias("_pane")).agg(*partial()).repartition("auction_id")
    # the windows [w, w + long) that hold a pane: w from the pane's end less long, to the pane
    last = F.col("_pane") - F.pmod(F.col("_pane"), F.lit(step))
    first = F.col("_pane") + pane - long
    first = first + F.pmod(-first, F.lit(step))
    each = panes.where(first <= last).withColumn("_w", F.explode(F.sequence(first, last, F.lit(step))))
    found = each.groupBy("auction_id", "_w").agg(*merged())
    time = lambda c: F.timestamp_micros(c).cast(kind)
    return found.select("auction_id", time(F.col("_w")).alias("window_start"), time(F.col("_w") + long).alias("window_end"), "_sum", "_rows", "_n", "_most", "_least")


def sessions(rows: DataFrame, gap: str) -> DataFrame:
    """auction_id, window_start, window_end and partial results of sessions: rows of a key at most `gap` apart are in one.

    Rows are sorted by range over all partitions and made into sessions there. Only a part's first and last session of a key may
    go on in another part: these, two rows a key and part at most, are put together along the parts. Where a key has one
    part, its sessions are complete.
    """
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(micros(gap) / 1_000_000).cast("decimal(18,6)"))
    placed = dealt(rows.where("ts is not null").select("auction_id", "amount", "ts"), ["auction_id"], "ts")
    inside = Window.partitionBy("auction_id", "_part").orderBy("ts")
    fresh = F.coalesce(F.col("ts") > F.lag("ts").over(inside) + wait, F.lit(True)).cast("long")
    numbered = placed.withColumn("_fresh", fresh).withColumn("_nth", F.sum("_fresh").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    own = numbered.groupBy("auction_id", "_part", "_nth").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), *partial())
    own = own.withColumn("_last", F.max("_nth").over(Window.partitionBy("auction_id", "_part")))
    at_edge = (F.col("_nth") == 1) | (F.col("_nth") == F.col("_last"))
    along = Window.partitionBy("auction_id").orderBy("_part", "_nth")
    edges = own.where(at_edge).withColumn("_fresh", F.coalesce(F.col("_from") > F.lag("_to").over(along) + wait, F.lit(True)).cast("long"))
    edges = edges.withColumn("_session", F.sum("_fresh").over(along))
    joined = edges.groupBy("auction_id", "_session").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), *merged()).drop("_session")
    whole = own.where(~at_edge).select(*joined.columns).unionByName(joined)
    return whole.select("auction_id", F.col("_from").alias("window_start"), (F.col("_to") + wait).alias("window_end"), "_sum", "_rows", "_n", "_most", "_least")
