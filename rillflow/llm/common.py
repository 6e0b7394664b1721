"""What the operators of this subpackage share: cutting lineage, graph components, input checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, stored

#: Rows of text that a Python task turns into output at a time are cut at this many bytes.
CHUNK_BYTES = 4 << 20
#: Rows of 64 bits each that the filter of parted() has at most.
FILTER_WORDS = 1 << 18


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that later reads don't depend on executors or on its plan.

    A table and not checkpoint(): a checkpoint keeps its plan's estimate of size, which is a product over joins and
    grows in a loop without end, while a table has a true size for Spark to plan with. A table stays until drop() or as
    long as the folder, which is scratch space and is emptied as checkpoints are.
    """
    return stored(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], draw: Column, how: str = "inner") -> DataFrame:
    """rows joined with the row of their group, where groups were summed up by the same columns.

    Spark would join them as the sums were dealt, a group in one task. By the salt, one of two drawn for each row, the
    groups are dealt anew, so that a hot group's rows are a skewed partition that Spark may split.
    """
    salted = groups.withColumn("_salt", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumn("_salt", F.pmod(draw, F.lit(2)).cast("int")).join(salted, [*by, "_salt"], how).drop("_salt")


def parted(rows: DataFrame, keys: DataFrame, key: str, words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be one of keys, and rows whose key is none of them or null: told apart without a shuffle of rows.

    Each key sets one of 64 * words bits by its hash; the words that have a bit are broadcast, a few MB at most however many keys
    there are. The more bits are set, the more of the other rows come in the first part; a row with a key of keys always does.
    """
    digest = F.xxhash64(key)
    word, bit = F.pmod(F.shiftright(digest, 6), F.lit(words)), digest.bitwiseAND(F.lit(63)).cast("int")
    bits = keys.where(F.col(key).isNotNull()).select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits"))
    met = rows.join(F.broadcast(bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))), word == F.col("_word"), "left")
    may = F.coalesce(F.getbit("_bits", bit), F.lit(0)) == 1
    return met.where(may).drop("_word", "_bits"), met.where(~may).drop("_word", "_bits")


def chunks(batches, column: str, most: int = CHUNK_BYTES):
    """Slices of Arrow batches whose strings in column take about most bytes at once; a longer single row comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: a row (id, component) for each id on an edge; component is the least id.

    Each round, every node takes the least of itself and its neighbours, and then what that one took, and the graph is
    contracted to what was taken. Every node but the least of its surroundings is taken in, so the nodes at least halve.
    A round is joins and sums by node; the driver sees one count. Nulls on an edge are ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    graph = cut(pairs.union(pairs.select(F.col("y"), F.col("x"))).distinct())
    labels, jumps = graph.select(F.col("x").alias("id"), F.col("x").alias("component")), []
    while graph.limit(1).count():
        took = graph.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        twice = took.select(F.col("x").alias("to"), F.col("to").alias("far"))
        jumps.append(cut(took.join(twice, "to").select("x", "far")))
        moved = graph.join(jumps[-1], "x").select(F.col("far").alias("fx"), "y").join(jumps[-1].toDF("y", "fy"), "y")
        smaller = cut(moved.where("fx <> fy").select(F.col("fx").alias("x"), F.col("fy").alias("y")).distinct())
        drop(graph)
        graph = smaller
    for k, jump in enumerate(jumps):  # the first names every id
        moved = labels.join(jump.toDF("component", "far"), "component", "left").select("id", F.coalesce("far", "component").alias("component"))
        labels = moved if k else jump.toDF("id", "component")
    if not jumps:
        return labels
    named = cut(labels)
    drop(graph, *jumps)
    return named
