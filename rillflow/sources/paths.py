"""Paths as Spark's readers take and give them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(path: str) -> str:
    """A path of which no character is read as a pattern."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path.rstrip("/"))


def plain(path: Column | str) -> Column:
    """A path from a file's metadata as it's written, without %xx."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
