"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Documents with equal shingle sets are one class. One signature per class; classes without shingles link with nothing.
2. Bands of the signature put classes into buckets. In each bucket a leader, drawn by hash for each band anew, meets every
   member: a number of pairs in proportion to the members.
3. A pair's signatures are compared batch by batch. With m of n equal minima and a uniform prior, the similarity has a
   Beta(m + 1, n - m + 1) posterior; the pair is dropped once its chance of reaching the bound is below `miss`.
4. Survivors are verified on their full sets, which are made again from the texts of candidates alone.
5. Links give components. Buckets that still hold several components are compared in full across components, in square
   blocks, under 3 and 4; so no pair that shares a band is left out, and pairs inside a component cost nothing. Leaders
   stay away, having met all members under 2. Blocks go through once with sketches, which leaves the members that a pair
   survives for, and those go through again with their sets; a block returns the links that join its components, never
   its pairs.

At 0.85 a pair shares none of 24 bands of 6 with a chance of 1.2e-5; at 0.8 (5 words), none of 30 bands of 5 with 6e-6.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, cut, drop, join_groups
from .shingles import MinHash, mix, set_key, shingle_sets

BATCH, MISS = 24, 1e-7
#: Members of a block, and shingles in it: beyond either, a bucket is cut into more blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21


def fewest_equal(size: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(n, fewest equal minima) after each batch. P(similarity >= t | m of n) is the chance that Binomial(n + 1, t) <= m."""
    t, out = percent / 100, []
    for n in range(batch, size + 1, batch):
        m, chance = 0, 0.0
        while m <= n:
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def signatures(docs: DataFrame, words: int, bands: int, rows: int, sets: bool = False, carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles, class (binary, null without shingles) and sketch (the lowest bytes of the signature's minima) and
    bands (a digest of each band's minima), or the set itself if sets.

    The binary column named carry, if any, comes along.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, class binary, " + ("shingles array<long>" if sets else "sketch binary, bands array<long>") + (f", {carry} binary" if carry else "")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        minhash = MinHash(bands * rows)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in chunks(batches, "text", 1 << 20):
            found = shingle_sets(batch.column("text").to_pylist(), words)
            full = [i for i, s in enumerate(found) if len(s)]
            columns = [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([set_key(s) if len(s) else None for s in found], pa.binary())]
            if sets:
                columns.append(pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "shingles"])
                continue
            made: list = [None] * len(found)
            keys: list = [None] * len(found)
            if full:
                sig = minhash([found[i] for i in full])
                band = sig.reshape(len(full), bands, rows).astype(np.uint64)
                key = np.broadcast_to(salt, band.shape[:2])
                for j in range(rows):
                    key = mix(key ^ band[:, :, j])
                for i, s, k in zip(full, sig, key.view(np.int64), strict=True):
                    made[i], keys[i] = s.astype(np.uint8).tobytes(), k
            columns += [pa.array(made, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *([batch.column(carry)] if carry else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "sketch", "bands", *([carry] if carry else [])])

    return docs.select("doc_id", "text", *([carry] if carry else [])).mapInArrow(run, schema)


def likely(pairs: DataFrame, sigs: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of classes that the posterior doesn't rule out.

    Of the signatures, the sketches are compared: equal minima have equal lowest bytes, so no fewer are counted, and no pair
    goes that the minima themselves would keep.
    """
    bounds = fewest_equal(size, BATCH, percent, miss)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, size) for c in ("sa", "sb"))
            left, equal = np.arange(len(x)), np.zeros(len(x), int)
            for n, least in bounds:
                equal = equal + (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(1)
                keep = equal >= least
                left, equal = left[keep], equal[keep]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], names=["a", "b"])

    own = sigs.select("class", "sketch")
    met = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return met.mapInArrow(run, "a binary, b binary")


def full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """class and shingles of the classes in wanted, made from one text of each."""
    ids = classes.join(wanted, "class").select(F.col("class").alias("_class"), F.col("first_id").alias("_first"))
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_first"))).select("doc_id", "text")
    return cut(signatures(texts, words, 0, 0, sets=True).groupBy("class").agg(F.any_value("shingles").alias("shingles")))


def exact(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    sets = full_sets(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct(), docs, classes, words)
    met = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    both = F.size(F.array_intersect("xa", "xb"))
    found = cut(met.where(100 * both >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b"))
    drop(sets)
    return found


def crossing(buckets: DataFrame, docs: DataFrame, classes: DataFrame, labels: DataFrame, words: int, size: int, bands: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b), verified on full sets, that join different components of a bucket. A pair is met in its first common band only.

    A bucket of up to BLOCK members and BLOCK_SHINGLES shingles is one group. Of a larger one, the largest component is
    met by the others only, never by itself: both it and the others are dealt into blocks by hash, and each pair of blocks
    with one of the others is a group of its own; so the members of the largest travel once for each block of others, of which there are few
    once copies are joined. Components that a link joins count as one in the rest of the group, so a group returns fewer
    links than it has components.
    """
    bounds = fewest_equal(size, BATCH, percent, miss)

    def sides(pdf):
        """The two sides of a group, the numbers of their components, and the places in two that may link with a place in one."""
        import numpy as np

        i, j, band = (int(pdf[c].iat[0]) for c in ("_i", "_j", "band"))
        one = pdf if i == j else pdf[pdf["_block"] == i]
        two = pdf if i == j else pdf[pdf["_block"] == j]
        x, y = (np.frombuffer(b"".join(p["sketch"]), np.uint8).reshape(-1, size) for p in (one, two))
        bx, by = (np.array(p["bands"].tolist(), np.int64).reshape(-1, bands) for p in (one, two))
        codes = {c: k for k, c in enumerate(dict.fromkeys([*one["component"], *two["component"]]))}
        cx, cy = (np.array([codes[c] for c in p["component"]], int) for p in (one, two))

        def partners(r):
            left = np.flatnonzero(cy != cx[r])
            left = left[left > r] if i == j else left
            for n, least in bounds:
                left = left[(y[left, :n] == x[r, :n]).sum(1) >= least]
            return left[~(by[left, :band] == bx[r, :band]).any(1)]

        return i == j, one, two, cx, cy, partners

    def possible(pdf):
        import numpy as np
        import pandas as pd

        same, one, two, _, _, partners = sides(pdf)
        hits, met = np.zeros(len(one), bool), np.zeros(len(two), bool)
        for r in range(len(one)):
            left = partners(r)
            hits[r] |= len(left) > 0
            met[left] = True
        return one[hits | met] if same else pd.concat([one[hits], two[met]])

    def run(pdf):
        import numpy as np
        import pandas as pd

        _, one, two, cx, cy, partners = sides(pdf)
        ax, by, xs, ys, out = one["class"].to_numpy(), two["class"].to_numpy(), one["shingles"].to_numpy(), two["shingles"].to_numpy(), []
        sizes = np.array([len(v) for v in ys], int)
        for r in range(len(one)):
            left = partners(r)
            if not len(left):
                continue
            own, met = xs[r], np.concatenate(ys[left])  # sorted, without repeats
            found = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
            both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes[left]) - sizes[left])
            for b in left[100 * both >= percent * (len(own) + sizes[left] - both)]:
                if cy[b] != cx[r]:
                    out.append((ax[r], by[b]))
                    joined = cy[b]
                    cx[cx == joined], cy[cy == joined] = cx[r], cx[r]
        return pd.DataFrame(out, columns=["a", "b"])

    own = buckets.join(labels.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    each = own.join(classes.select("class", "n_shingles"), "class").groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sums = each.groupBy("band", "key").agg(F.count("*").alias("_of"), F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.max(F.struct("n", "s", "component")).alias("_main"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES))
    fits = (F.col("_n") <= BLOCK) & (F.col("_s") <= BLOCK_SHINGLES)
    main = F.when(fits, 0).otherwise(blocks(F.col("_main.n"), F.col("_main.s")))
    others = F.when(fits, 1).otherwise(blocks(F.col("_n") - F.col("_main.n"), F.col("_s") - F.col("_main.s")))
    mixed = sums.where("_of > 1").select("band", "key", F.col("_main.component").alias("_largest"), main.alias("_main"), others.alias("_others"))
    own = join_groups(own, mixed, ["band", "key"], F.xxhash64("class"))
    draw, largest = F.xxhash64("class"), (F.col("component") == F.col("_largest")) & (F.col("_main") > 0)
    own = own.withColumn("_block", F.when(largest, F.col("_others") + F.pmod(draw, F.col("_main"))).otherwise(F.pmod(draw, F.col("_others"))))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_others") - 1 + F.when(largest, 0).otherwise(F.col("_main")))))
    own = own.withColumn("_i", F.least("_block", "_o")).withColumn("_j", F.greatest("_block", "_o"))
    own = own.join(classes.select("class", "sketch", "bands"), "class")
    own = own.select("band", "key", "_i", "_j", "_block", "class", "component", "sketch", "bands")
    by = ["band", "key", "_i", "_j"]
    near = cut(own.groupBy(*by).applyInPandas(possible, own.schema))
    sets = full_sets(near.select("class").distinct(), docs, classes, words)
    whole = near.join(sets.select("class", F.array_sort("shingles").alias("shingles")), "class")
    found = cut(whole.groupBy(*by).applyInPandas(run, "a binary, b binary"))
    drop(near, sets)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, miss: float = MISS, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs.

    Components are of texts: rows that share a doc_id but not the text may be in different ones, and each is kept or not
    by its own. Null or blank texts have no shingles and are their own component. A null doc_id takes part in links but
    is never a component's least id unless no row of the component has one. A text of any length counts with all its shingles,
    8 bytes each, which are one value and one task's work.

    key names a binary column of docs that tells texts apart, and is put out too. With it, a component without any doc_id
    keeps the rows of its least key; without, it keeps all its rows.
    """
    size = bands * rows
    every = cut(signatures(docs, words, bands, rows, carry=key))
    extra = [F.min(key).alias("first_key")] if key else []
    some = every.where("class is not null")
    classes = cut(some.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"), *extra))
    spread = classes.select("class", F.posexplode("bands").alias("band", "key"))
    draw = F.struct(F.xxhash64("class", "band").alias("h"), F.col("class").alias("leader"))
    full = spread.groupBy("band", "key").agg(F.count("*").alias("_n"), F.min(draw)["leader"].alias("leader")).where("_n > 1")
    buckets = cut(join_groups(spread, full.drop("_n"), ["band", "key"], F.xxhash64("class")))
    pairs = buckets.where("leader <> class").select(F.least("leader", "class").alias("a"), F.greatest("leader", "class").alias("b")).distinct()
    candidates = cut(likely(pairs, classes, size, percent, miss))
    links = exact(candidates, docs, classes, words, percent)
    drop(candidates)
    labels = components(links)
    more = crossing(buckets.where("leader <> class").drop("leader"), docs, classes, labels, words, size, bands, percent, miss)
    drop(buckets)
    named = classes.select("class", "first_id").join(labels.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    if more.limit(1).count():  # links between components: a graph of components alone
        of = named.select("class", "component")
        between = more.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
        whole = components(between, "ca", "cb").toDF("component", "whole")
        named = named.join(whole, "component", "left").select("class", "first_id", F.coalesce("whole", "component").alias("component"))
    if key:
        named = named.join(classes.select("class", "first_key"), "class")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), *([F.min("first_key").alias("first_key")] if key else []))
    more_columns = ["first_key"] if key else []
    of = join_groups(named.select("component", "class"), least, ["component"], F.xxhash64("class")).select("class", "component_id", *more_columns)
    out = every.select("doc_id", "n_shingles", "class", *([key] if key else [])).join(of, "class", "left")
    kept = F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id"))
    if key:
        kept = kept & (F.col("component_id").isNotNull() | F.col("class").isNull() | (F.col(key) == F.col("first_key")))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept"), *([key] if key else []))
