"""Hard negatives for anchors within score windows, by slots.

An anchor's positives are its best rows of the same label. Each positive allows the negatives whose score is in a window
below its own; windows of one anchor overlap. The windows' upper limits, in descending order, cut the scores into disjoint
slots, and a window is a run of slots from its own downwards. The best k of any window are thus among the best k of its
slots: tasks keep the best k of each slot and no more, their results are merged by slot, and each window takes the first k
of its slots in descending order. Its lower limit cuts the end of that list, since all that it drops is worse.

Rows are compared in blocks: anchors come in groups, and each block of rows meets each group once, in a task that streams the
blocks past the group. What a task holds is a group, a block, and the best k of each slot of the group's anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

BLOCK, GROUP = 512, 1024
#: Stands for a null vec_id, behind all others.
NO_ID = (1 << 63) - 1
LONG = 1 << 63
PACKED = "size int, ids binary, labels binary, units binary, single boolean"


def eligible(vectors: DataFrame) -> DataFrame:
    """vec_id, label (long) and embedding (doubles) of rows with a label and a vector of finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    point = F.transform("embedding", lambda x: x.cast("double"))
    return good.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), point.alias("embedding"))


def pack(batches: Iterator, scale: float, most: int) -> Iterator:
    """Blocks of rows of equal length: ids, labels and floor(scale * x), as bytes. 4 bytes a component hold it where that is exact."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        points = batch.column("embedding")
        length = points.value_lengths().to_numpy(zero_copy_only=False)
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("vec_id", "label"))
        out: list[list] = [[], [], [], [], []]
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            for k in range(0, len(at), most):
                own = at[k : k + most]
                x = np.floor(scale * points.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                single = bool(np.abs(x).max(initial=0) < 1 << 24)
                for column, value in zip(out, (int(size), ids[own].tobytes(), labels[own].tobytes(), x.astype("<f4" if single else "<f8").tobytes(), single), strict=True):
                    column.append(value)
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["size", "ids", "labels", "units", "single"])


def scores(anchors, rows):
    """Inner products, exactly: in doubles where all sums are below 2**53, else in Python's integers, cut to 64 bits."""
    import numpy as np

    bound = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, anchors.shape[1])
    if bound < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    found = whole(anchors) @ whole(rows).T
    return np.clip(found, -LONG, LONG - 1).astype(np.int64)


class Best:
    """The first k (score down, id up) of each key seen so far."""

    def __init__(self, keys: int, k: int):
        import numpy as np

        self.k, self.rows = k, [np.empty(0, np.int64) for _ in range(3)]
        self.least = np.full(keys, -LONG, np.int64)  # a key's k-th score, below which nothing counts

    def add(self, key, score, ids) -> None:
        import numpy as np

        some = score >= self.least[key]
        key, score, ids = (np.concatenate([a, b[some]]) for a, b in zip(self.rows, (key, score, ids), strict=True))
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        nth = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        self.least[key[nth == self.k - 1]] = score[nth == self.k - 1]
        self.rows = [c[nth < self.k] for c in (key, score, ids)]


def _matrix(record: dict):
    import numpy as np

    n = len(record["ids"]) // 8
    return np.frombuffer(record["units"], "<f4" if record["single"] else "<f8").reshape(n, record["size"]).astype(np.float64)


def _stream(groups: DataFrame, blocks: DataFrame, meet, columns: str) -> DataFrame:
    """Each group with all blocks of its length. meet(group) gives (see, close): see(block) takes each block, close() the result.

    A task's rows are sorted so that a group stands before the blocks that meet it: the group travels once a task, a block
    once a group.
    """
    spark = groups.sparkSession
    n_groups, width = groups.agg(F.max("g")).first()[0] or 0, partitions(spark)
    salts = max(1, -(-width // (n_groups + 1)))
    place = F.pmod(F.col("g") * salts + F.col("salt"), F.lit(width)).cast("int")
    none = F.lit(None).cast("binary").alias("limits")
    limits = "limits" if "limits" in groups.columns else none
    first = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("g", "salt", F.lit(0).alias("kind"), *_names(PACKED), limits)
    then = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups)))).withColumn("salt", F.pmod(F.xxhash64("ids", "g"), F.lit(salts)).cast("int"))
    then = then.select("g", "salt", F.lit(1).alias("kind"), *_names(PACKED), none)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, see, close = None, None, None
        result = lambda found: pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in found], names=columns.split())
        for batch in batches:
            for k in range(batch.num_rows):
                record = batch.slice(k, 1).to_pylist()[0]
                here = record["g"], record["salt"], record["size"]
                if record["kind"] == 0:
                    if close:
                        yield result(close())
                    at, (see, close) = here, meet(record)
                elif here == at:  # a block whose length no anchor has meets nothing
                    see(record)
        if close:
            yield result(close())

    met = first.unionByName(then).repartitionById(width, place).sortWithinPartitions("g", "salt", "size", "kind")
    return met.mapInArrow(run, ", ".join(f"{c} long" for c in columns.split()))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def _merged(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each key; Spark cuts each task's rows to k before they are dealt out."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label (integers) and embedding; is_anchor is a column of these three. A component x counts as floor(scale * x), a
    score is an inner product. An anchor's positives are its first `positives` other rows of the same label; for each of
    them, rank counts the first k rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score. Higher scores are first, ties by smaller vec_id.

    Rows with a null label or vector, or a component that is null or not finite, take no part. Vectors of different lengths
    aren't compared; empty ones score 0. A null vec_id is no anchor, but may be an answer, behind all ties. Rows that
    repeat count as often as they occur, but anchors that repeat wholly are answered once, and no row with the anchor's
    vec_id is its positive. A positive with a negative score has an empty window. Scores beyond 64 bits are cut to 64 bits. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= low < high:
        raise ValueError("a window goes from a lower to a higher share")
    rows = eligible(vectors)
    chosen = rows.where(is_anchor & (F.col("vec_id") != NO_ID)).distinct()
    n_groups = max(1, -(-chosen.count() // group))  # one number; groups are dealt by hash, so they have about `group` anchors
    dealt = chosen.withColumn("size", F.size("embedding")).withColumn("_bucket", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(n_groups)))

    def packed(key, table):
        import pyarrow as pa

        whole = table.combine_chunks().to_batches(max_chunksize=table.num_rows)
        record = pa.Table.from_batches(pack(whole, scale, table.num_rows))
        return record.add_column(0, "bucket", pa.array([key[0].as_py()], pa.int64()))

    made = cut(dealt.groupBy("_bucket", "size").applyInArrow(packed, f"bucket long, {PACKED}"))
    numbers = Window.partitionBy().orderBy("size", "bucket")  # over a row a group: a thousandth of the anchors
    names = made.select("size", "bucket").withColumn("g", F.row_number().over(numbers) - 1)
    groups = cut(made.join(names, ["size", "bucket"]).select("g", *_names(PACKED)))
    blocks = cut(rows.mapInArrow(lambda batches: pack(batches, scale, block), PACKED))

    def positives_of(record: dict):
        import numpy as np

        own = _matrix(record)
        ids, labels = (np.frombuffer(record[c], "<i8") for c in ("ids", "labels"))
        best = Best(len(ids), positives)

        def see(other: dict) -> None:
            theirs = _matrix(other)
            other_ids, other_labels = (np.frombuffer(other[c], "<i8") for c in ("ids", "labels"))
            for label in np.intersect1d(labels, other_labels):
                a, r = np.flatnonzero(labels == label), np.flatnonzero(other_labels == label)
                found = scores(own[a], theirs[r])
                x, y = np.nonzero((found >= best.least[a][:, None]) & (ids[a][:, None] != other_ids[r][None, :]))
                best.add(a[x], found[x, y], other_ids[r][y])

        def close() -> tuple:
            key, score, found = best.rows
            return (record["g"] << 32) + key, ids[key], score, found

        return see, close

    first = _merged(_stream(groups, blocks, positives_of, "a anchor_id score id"), ["a"], positives)
    part = lambda share, more: F.expr(f"{share} * (score div 100) + ({share} * (score % 100) + {more}) div 100")  # noqa: E731  stays within 64 bits
    asked = F.struct(F.col("_nth").alias("nth"), "score", "id", part(low, 99).alias("least"), part(high, 0).alias("most"))
    wanted = cut(first.groupBy("a", "anchor_id").agg(F.array_sort(F.collect_list(asked)).alias("asked")))  # at most `positives` entries
    limits = F.struct(F.expr("a & 4294967295").alias("i"), F.transform("asked", lambda p: F.struct(p["score"].alias("score"), p["least"].alias("least"), p["most"].alias("most"))).alias("p"))
    by_group = wanted.groupBy(F.shiftright("a", 32).cast("int").alias("g")).agg(F.to_json(F.collect_list(limits)).cast("binary").alias("limits"))
    limited = groups.join(by_group, "g")

    def negatives_of(record: dict):
        import json

        import numpy as np

        own = _matrix(record)
        ids, labels = (np.frombuffer(record[c], "<i8") for c in ("ids", "labels"))
        tops = np.full((len(ids), positives), -LONG, np.int64)
        floor = np.full(len(ids), LONG - 1, np.int64)
        for anchor in json.loads(record["limits"]):
            able = [p for p in anchor["p"] if p["score"] >= 0]
            for nth, p in enumerate(able):
                tops[anchor["i"], nth] = p["most"]
                floor[anchor["i"]] = min(floor[anchor["i"]], p["least"])
        best = Best(len(ids) * positives, k)

        def see(other: dict) -> None:
            theirs = _matrix(other)
            other_ids, other_labels = (np.frombuffer(other[c], "<i8") for c in ("ids", "labels"))
            found = scores(own, theirs)
            x, y = np.nonzero((found <= tops[:, :1]) & (found >= floor[:, None]) & (labels[:, None] != other_labels[None, :]))
            score = found[x, y]
            slot = (score[:, None] <= tops[x]).sum(1) - 1  # the last window that lets it in
            best.add(x * positives + slot, score, other_ids[y])

        def close() -> tuple:
            key, score, found = best.rows
            return (record["g"] << 32) + key // positives, key % positives, score, found

        return see, close

    slots = _merged(_stream(limited, blocks, negatives_of, "a slot score id"), ["a", "slot"], k)
    entry = F.struct("slot", (-F.col("score")).alias("down"), "id")
    kept = slots.groupBy("a").agg(F.array_sort(F.collect_list(entry)).alias("found"))  # at most positives * k entries
    met = kept.join(wanted, "a").select("anchor_id", "found", F.posexplode(F.filter("asked", lambda p: p["score"] >= 0)).alias("_i", "_p"))
    suffix = F.slice(F.filter("found", lambda e: e["slot"] >= F.col("_i")), 1, k)
    window = met.select("anchor_id", "_p", F.posexplode(F.filter(suffix, lambda e: -e["down"] >= F.col("_p.least"))).alias("_r", "_e"))
    known = lambda c: F.when(c != NO_ID, c)
    return window.select(
        "anchor_id", known(F.col("_p.id")).alias("positive_id"), (F.col("_r") + 1).cast("int").alias("rank"), known(F.col("_e.id")).alias("negative_id"),
        F.col("_p.score").alias("positive_score"), (-F.col("_e.down")).alias("negative_score"),
    )
