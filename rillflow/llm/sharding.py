"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. The rows lie in parts: runs of PART rows of a file, known by the file and the row's number in it, so that a row's part
   and place are the same whoever reads it and however files are split into tasks.
2. The targets are cells: runs of at most CELL slots of a shard. How many rows of each part go to each cell is a
   multivariate hypergeometric draw over all parts and cells. A task draws its parts' rows of that matrix alone: it
   halves the range of parts again and again and draws how many of the cells' slots the first half takes, with the same
   generator at the same node in every task. Nobody holds the matrix.
3. A part's rows are permuted against its cells, exchanged by cell, and permuted again inside the cell, which gives the
   slot. Every order of the rows over all slots is as likely as any other, up to the generator.

Only the part's name and the row's place go through Python; rows stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

PART, CELL = 1 << 16, 1 << 14
#: numpy draws from fewer than this many; larger draws are made here.
NUMPY_BELOW = 10**9


def large(rng, good: int, bad: int, n: int) -> int:
    """How many of `good` are among n drawn from good + bad without putting back, by inversion around the mode.

    Values beyond 40 standard deviations have no chance that a double could tell from 0.
    """
    import numpy as np

    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = int(40 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 64
    low, high = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def draw(rng, colours, n: int, below: int = NUMPY_BELOW):
    """How many of each colour are among n drawn without putting back from colours[i] of colour i."""
    import numpy as np

    total = int(colours.sum())
    if len(colours) < 2 or total < below:
        return rng.multivariate_hypergeometric(colours, n, method="marginals") if len(colours) > 1 else np.array([n])
    half = len(colours) // 2
    first = int(colours[:half].sum())
    k = large(rng, first, total - first, n)
    return np.concatenate([draw(rng, colours[:half], k, below), draw(rng, colours[half:], n - k, below)])


def matrix_row(part: int, ends, cells, seed: int, below: int = NUMPY_BELOW):
    """How many rows of a part go to each cell. ends: rows up to and with each part; cells: slots of each cell."""
    import numpy as np

    low, high, left = 0, len(ends), np.asarray(cells)
    while high - low > 1:
        middle = (low + high) // 2
        first = int(ends[middle - 1] - (ends[low - 1] if low else 0))
        taken = draw(np.random.default_rng([seed, low, high]), left, first, below)
        low, high, left = (low, middle, taken) if part < middle else (middle, high, left - taken)
    return left


def cells_of(total: int, shards: int, most: int = CELL) -> tuple[list[int], int]:
    """The slots of each cell, shard by shard, and how many cells a shard has. Shards differ by one row at most, the first ones are larger."""
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    each = max(1, -(-sizes[0] // most))
    return [size * (j + 1) // each - size * j // each for size in sizes for j in range(each)], each


def _numbered(docs: DataFrame, most: int) -> DataFrame:
    """row, _part, _place: where each row lies in its file."""
    at = F.col("_metadata.row_index")
    part = F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {most}"))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), part.alias("_part"), (at % most).alias("_place"))


def _parts(rows: DataFrame) -> list:
    return rows.groupBy("_part").agg(F.count("*").alias("n"), F.max("_place").alias("last")).orderBy("_part").collect()


def placed(docs: DataFrame, most: int = PART) -> tuple[DataFrame, list]:
    """docs with parts and places, and (part, rows) of each part: a few bytes for each `most` rows come to the driver.

    Rows that aren't those of whole Parquet files are written to a table first.
    """
    try:
        rows = _numbered(docs, most)
        parts = _parts(rows)
        if all(p.n == p.last + 1 for p in parts):
            return rows, parts
    except AnalysisException:  # rows that come from no Parquet file have no place in one
        pass
    rows = _numbered(cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))), most)
    return rows.withColumn("row", F.col("row")["own"]), _parts(rows)


def shuffle(docs: DataFrame, shards: int, seed: int = 0, part: int = PART, cell: int = CELL) -> DataFrame:
    """row (all columns of docs), shard (from 0) and slot (gapless from 0 within the shard): a row per row of docs.

    Numbers of rows differ by one at most between shards. The same files, seed and settings give the same places. Nulls, empty
    and very long texts and rows that repeat are rows like any other, since only a row's place counts; docs may have
    columns of any name. An empty table gives no rows.
    """
    import numpy as np

    rows, parts = placed(docs, part)
    names, ends = np.array([p[0] for p in parts], np.int64), np.cumsum([p.n for p in parts], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    slots, each = cells_of(total, shards, cell)
    slots = np.array(slots, np.int64)

    @F.pandas_udf("long")
    def target(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        dealt: dict[int, np.ndarray] = {}  # of the parts met last: a cell for each place
        for own, place in batches:
            out = np.empty(len(own), np.int64)
            for name in own.unique():
                if name not in dealt:
                    k = int(np.searchsorted(names, name))
                    cells = np.repeat(np.arange(len(slots)), matrix_row(k, ends, slots, seed))
                    while len(dealt) >= 8:
                        del dealt[next(iter(dealt))]
                    dealt[name] = np.random.default_rng([seed, k]).permutation(cells)
                here = (own == name).to_numpy()
                out[here] = dealt[name][place.to_numpy()[here]]
            yield pd.Series(out)

    exchanged = rows.withColumn("_cell", target("_part", "_place"))
    shard, turn = F.expr(f"int(_cell div {each})"), F.col("_cell") % each
    size = F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)
    start = F.call_function("div", size * turn, F.lit(each).cast("long"))
    inside = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed), "_part", "_place"), "_part", "_place")
    return exchanged.select("row", shard.alias("shard"), (start + F.row_number().over(inside) - 1).alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Parquet files in a folder for each shard, in order of slots; a shard may take many files."""
    flat = rows.select("shard", "slot", "row")
    flat.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
