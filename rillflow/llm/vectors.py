"""Near-duplicate embeddings: an epsilon grid order join within labels.

1. Equal vectors of a label are one point with a weight. Points are scaled to length 1; cosine >= c is then a distance
   of at most eps = sqrt(2 - 2c), and projecting on orthonormal directions never makes a distance larger.
2. The leading principal directions come from a bounded sample; each gives a grid of width eps. Points are sorted by
   label and cells, and the sorted sequence is cut into blocks of BLOCK points, each with the box of its projections.
3. Intervals of blocks make a tree of FAN branches. Pairs of intervals are split level by level, and a pair whose boxes
   are more than eps apart in the projected space is dropped with all below it: no pair of it can link.
4. Pairs of blocks that are left are put into tiles, so that a block travels once a tile, and are compared by a matrix product in
   double precision. What leaves a task is the number of links of each point and a spanning forest of the links, not the
   links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .common import components, cut, join_groups

BLOCK, FAN, DIRECTIONS, SAMPLE, TILE = 256, 16, 6, 4000, 8


def _can_link():
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)


def points(vectors: DataFrame) -> DataFrame:
    """vec_id, label, point (doubles) and its 128-bit name k1, k2, for vectors that can link at all."""
    good = vectors.where(_can_link())
    point = F.transform("embedding", lambda x: F.when(x == 0, 0.0).otherwise(x.cast("double")))  # -0.0 is 0.0
    keyed = good.select("vec_id", "label", point.alias("point"))
    return keyed.select("vec_id", "label", "point", F.xxhash64("point").alias("k1"), F.xxhash64(F.lit(1), "point").alias("k2"))


def distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "k1", "k2").agg(F.any_value("point").alias("point"), F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


def directions(rows: DataFrame, sample: int = SAMPLE, most: int = DIRECTIONS):
    """For each length of vector, an orthonormal basis of its leading principal directions, from a bounded sample of points."""
    import numpy as np

    by_size: dict[int, list] = {}
    for r in rows.select("point").orderBy(F.xxhash64("point")).limit(sample).collect():
        by_size.setdefault(len(r.point), []).append(r.point)
    out = {}
    for size, found in by_size.items():
        x = np.array(found)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        out[size] = v[:most]
    return out


def place(rows: DataFrame, bases: dict, eps: float) -> DataFrame:
    """Adds size, cells (array<int>), spot (array<double>, the projections) and unit (binary, the scaled doubles)."""
    new = [("size", IntegerType()), ("cells", ArrayType(IntegerType())), ("spot", ArrayType(DoubleType())), ("unit", BinaryType())]
    schema = StructType([*rows.drop("point").schema.fields, *(StructField(*x) for x in new)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column("point")
            length = column.value_lengths().to_numpy(zero_copy_only=False)
            sizes, cells, spots, units = length.tolist(), [None] * len(length), [None] * len(length), [None] * len(length)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                spot = np.zeros((len(at), DIRECTIONS))
                if size in bases:
                    spot[:, : len(bases[size])] = x @ bases[size].T
                for i, s, c, u in zip(at, spot, np.floor(spot / eps).astype(np.int32), x.astype("<f8"), strict=True):
                    cells[i], spots[i], units[i] = c, s, u.tobytes()
            rest = [i for i, c in enumerate(batch.schema.names) if c != "point"]
            made = [pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(spots, pa.list_(pa.float64())), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *made], names=[*(batch.schema.names[i] for i in rest), "size", "cells", "spot", "unit"])

    return rows.mapInArrow(run, schema)


def _boxes(rows: DataFrame, *by: str) -> DataFrame:
    lows = [F.min(F.col("lo")[i]) for i in range(DIRECTIONS)]
    highs = [F.max(F.col("hi")[i]) for i in range(DIRECTIONS)]
    return rows.groupBy(*by).agg(F.array(*lows).alias("lo"), F.array(*highs).alias("hi"))


def close_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (x <= y) of blocks of the same label and vector size whose boxes are within eps, found from the root down.

    blocks: label, size, block (from 0 within these), lo, hi. A level has a row per interval of FAN**level blocks.
    """
    own = ["label", "size"]
    levels = [blocks]
    most = blocks.agg(F.max("block")).first()[0] or 0
    while most:
        most //= FAN
        up = levels[-1].withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        levels.append(cut(_boxes(up, *own, "block")))
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("xlo", "yhi", lambda a, b: a - b), F.zip_with("ylo", "xhi", lambda a, b: a - b),
            lambda a, b: F.pow(F.greatest(a, b, F.lit(0.0)), F.lit(2.0)),
        ),
        F.lit(0.0), lambda s, v: s + v,
    )
    pairs = levels[-1].select(*own, F.col("block").alias("x"), F.col("block").alias("y"))
    for level in reversed(levels[:-1]):
        for side in ("x", "y"):
            kids = level.select(*own, F.floor(F.col("block") / FAN).cast("long").alias(side), F.col("block").alias(f"_{side}"), F.col("lo").alias(f"{side}lo"), F.col("hi").alias(f"{side}hi"))
            pairs = pairs.join(kids, [*own, side])
        near = pairs.where((F.col("_x") <= F.col("_y")) & (gap <= eps * eps * (1 + 1e-9)))
        pairs = cut(near.select(*own, F.col("_x").alias("x"), F.col("_y").alias("y")))
    return pairs


def forest(hit):
    """Edges (a row of two places each) that span the components of a symmetric matrix of links, found breadth first.

    Each place is on the rim once, so the work is that of the matrix, whatever the number of links.
    """
    import numpy as np

    left, edges = hit.any(1), [np.empty((0, 2), int)]
    while left.any():
        rim = np.array([left.argmax()])
        left[rim] = False
        while len(rim):
            met = hit[rim] & left
            new = np.flatnonzero(met.any(0))
            edges.append(np.stack([rim[met[:, new].argmax(0)], new], 1))
            left[new] = False
            rim = new
    return np.concatenate(edges)


def block_links(pairs: DataFrame, filled: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """kind 0: id a has `n` links to others, counted with weights; kind 1: a and b are linked. a and b are numbers of points.

    filled: label, size, block, ids, weights, units. The square of pairs is cut into tiles of `tile` blocks by `tile`: a block travels
    once for each tile that it has a pair in, and a task's group is one tile, so 2 * tile blocks at most.
    """
    own = ["label", "size"]
    tiles = [F.floor(F.col(c) / tile).cast("long").alias(f"t{c}") for c in ("x", "y")]
    sides = pairs.select(*own, *tiles, F.explode(F.array("x", "y")).alias("block")).distinct()
    blocks = sides.join(filled.select(*own, "block", "ids", "weights", "units"), [*own, "block"])
    asked = pairs.select(F.col("label").alias("_label"), F.col("size").alias("_size"), *(t.alias(f"_{c}") for t, c in zip(tiles, "xy", strict=True)), "x", "y")

    def run(key, table, wanted):
        import numpy as np
        import pyarrow as pa

        held, out = {}, [[np.empty(0, np.int64)] for _ in range(4)]
        for k in range(table.num_rows):
            r = table.slice(k, 1).to_pylist()[0]
            held[r["block"]] = np.frombuffer(b"".join(r["units"]), "<f8").reshape(-1, key[1].as_py()), np.array(r["ids"]), np.array(r["weights"])
        for a, b in zip(wanted.column("x").to_pylist(), wanted.column("y").to_pylist(), strict=True):
            (x, xi, xw), (y, yi, yw) = held[a], held[b]
            hit = x @ y.T >= least
            same = a == b
            if same:
                np.fill_diagonal(hit, False)
            links = forest(hit if same else np.block([[np.zeros((len(x), len(x)), bool), hit], [hit.T, np.zeros((len(y), len(y)), bool)]]))
            names = xi if same else np.concatenate([xi, yi])
            counts = [(xi, hit @ yw)] + ([] if same else [(yi, hit.T @ xw)])
            for ids, n in counts:
                some = np.flatnonzero(n)
                for c, v in zip(out, (np.zeros(len(some), int), ids[some], ids[some], n[some]), strict=True):
                    c.append(v)
            for c, v in zip(out, (np.ones(len(links), int), names[links[:, 0]], names[links[:, 1]], np.zeros(len(links), int)), strict=True):
                c.append(v)
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["kind", "a", "b", "n"])

    by = [*own, "tx", "ty"]
    return blocks.groupBy(*by).cogroup(asked.groupBy("_label", "_size", "_x", "_y")).applyInArrow(run, "kind long, a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of vectors (vec_id, embedding, label).

    Vectors link if labels and lengths are equal and their cosine is at least `least`. A null label or vector, a zero vector
    and one with a null or non-finite component link with nothing. Rows that repeat a vec_id are vectors of their own
    in the counts, but share the least component of their id.
    """
    eps = (2 - 2 * least) ** 0.5
    rows = cut(distinct(points(vectors)))
    placed = cut(place(rows, directions(rows), eps))
    # the sequence: sorted by range over all partitions; a number that keeps the order comes from the sort itself
    order = ["label", "size", "cells", "first_id"]
    ordered = cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    # a block is a run of points of one partition, label and size; blocks of a label are numbered by a sum over partitions
    part = F.shiftright("id", 33)
    spread = ordered.withColumn("part", part)
    starts = spread.groupBy("label", "size", "part").agg(F.min("id").alias("start"), F.count("*").alias("_n"))
    ahead = Window.partitionBy("label", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum(F.ceil(F.col("_n") / block)).over(ahead), F.lit(0))).drop("_n")
    blocked = spread.join(starts, ["label", "size", "part"]).withColumn("block", (F.col("_before") + F.floor((F.col("id") - F.col("start")) / block)).cast("long"))
    filled = cut(
        blocked.groupBy("label", "size", "block").agg(F.collect_list(F.struct("id", "n", "unit", "spot")).alias("p"))
        .select("label", "size", "block", F.col("p.id").alias("ids"), F.col("p.n").alias("weights"), F.col("p.unit").alias("units"), F.col("p.spot").alias("spots"))
    )  # at most `block` points each
    spot = lambda i: F.transform("spots", lambda s: s[i])
    ends = [F.array(*[f(spot(i)) for i in range(DIRECTIONS)]) for f in (F.array_min, F.array_max)]
    boxes = cut(filled.select("label", "size", "block", ends[0].alias("lo"), ends[1].alias("hi")))
    found = cut(block_links(close_blocks(boxes, eps), filled, least))
    links = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    labels = components(found.where("kind = 1").select("a", "b"))
    named = ordered.select("id", "label", "k1", "k2", "first_id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_id = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_point = join_groups(named, least_id, ["component"], F.col("id")).join(links, "id", "left").select(
        "label", "k1", "k2", F.col("component_id").alias("_of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_n")
    )
    per_row = points(vectors).select("vec_id", "label", "k1", "k2").join(by_point, ["label", "k1", "k2"]).select("vec_id", "_of", "_n")
    alone = vectors.where(~F.coalesce(_can_link(), F.lit(False))).select("vec_id", F.col("vec_id").alias("_of"), F.lit(0).cast("long").alias("_n"))
    return per_row.union(alone).select("vec_id", F.col("_n").alias("n_links"), F.col("_of").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("_of")).alias("kept"))
