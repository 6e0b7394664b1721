"""Columns: quantities with units, and shares of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: factors of memory suffixes
BINARY = {"Ki": 1024, "Mi": 1024**2, "Gi": 1024**3, "Ti": 1024**4}


def millicores(text: Column) -> Column:
    """'2387m', '2' or '250000000n' in millicores; anything else is 0."""
    number = lambda cut: F.substring(text, F.lit(1), F.length(text) - cut).try_cast("double")
    value = F.when(F.endswith(text, F.lit("n")), number(1) / 1e6).when(F.endswith(text, F.lit("m")), number(1)).otherwise(text.try_cast("double") * 1000)
    return F.coalesce(value, F.lit(0.0))


def memory_bytes(text: Column) -> Column:
    """'1943Mi' or a bare number in bytes; anything else is 0."""
    value = text.try_cast("double")
    for suffix, factor in BINARY.items():
        value = F.when(F.endswith(text, F.lit(suffix)), F.substring(text, F.lit(1), F.length(text) - 2).try_cast("double") * float(factor)).otherwise(value)
    return F.coalesce(value, F.lit(0.0)).cast("long")


def utilisation(used: Column, allocatable: Column, missing: float) -> Column:
    """Percent in [0, 100]; `missing` stands in where nothing was measured."""
    percent = 100.0 * used / F.when(allocatable > 0, allocatable)
    return F.when(percent.isNull(), F.lit(missing)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent)))


def estimated_cpu(pods: Column) -> Column:
    return F.least(F.lit(90.0), 15.0 + 8.0 * pods)
