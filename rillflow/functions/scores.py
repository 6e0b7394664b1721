"""Columns: what a load is worth, and the class that it falls in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reward(cpu: Column) -> Column:
    """1 in [30, 70]; rising from 0.5 below, falling to 0.5 at 90 above, 0.2 beyond."""
    raw = F.when(cpu < 30, 0.5 + 0.3 * cpu / 30.0).when(cpu <= 70, F.lit(1.0)).when(cpu <= 90, 1.0 - 0.5 * (cpu - 70.0) / 20.0).otherwise(F.lit(0.2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def bucket(cpu: Column) -> Column:
    return F.when(cpu < 30, "LOW").when(cpu <= 70, "MED").otherwise("HIGH")


def regime(cpu: Column) -> Column:
    return F.when(cpu > 60, "BANDIT").when(cpu > 30, "LEAST_LOADED").otherwise("FCFS")
