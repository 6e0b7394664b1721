"""The prefix trie of conversations, with totals over subtrees, by time-forward processing.

A node is a distinct sequence of first turns. It is named by its depth and its smallest conversation: the nodes that a
conversation names are the end of its path, from the depth on at which no smaller one shares its turns.

Totals go from children to parents. A task sorts its shard's nodes by depth, deepest first; a node takes the messages that were
sent to it from a priority queue, adds them to its own values, and sends the sum on to its parent. The queue spills
to sorted runs. Shards are cut so that none is large, whatever turns conversations share:

- A node is light if at most MOST turns lie below it, counted for each conversation, which is a plain sum by node. Light nodes
  without a light parent are shard roots, and their subtrees are dealt out whole.
- The heavy nodes above them are cut into pieces: MOST levels of the nodes that one conversation names. A piece is a path.

Light shards are summed up first; their roots' totals go to heavy nodes. The pieces, a row each, are summed up as a tree in one
task, and each one's total goes to the node above it. Then the nodes inside the pieces are summed up.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import running
from .common import cut, join_groups

MOST = 1 << 14
#: Messages that a queue holds in memory, and those of a run on disk that are read at once.
HELD, READ = 200_000, 2_000


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, ord (from 0), t1, t2 (the 128-bit name of role and text), n_bytes (of the text): a row per turn.

    Turns go by `turn` (null first), then role, then the name of role and text; rows that repeat are turns of their own. A null
    role or text is empty; rows without a conv_id take no part. Texts of any length are read once and not passed on.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = F.struct("turn", "role", "t1", "t2", F.monotonically_increasing_id().alias("tie"))
    placed = running(rows.select("conv_id", order.alias("o"), "t1", "t2", "n_bytes"), ["conv_id"], "o", {"ord": F.lit(1)})
    return placed.select("conv_id", "ord", "t1", "t2", "n_bytes")


def branched(rows: DataFrame, family: int = 5, spans: int = 9) -> tuple[DataFrame, DataFrame]:
    """Paths that share beginnings: those of conversation c - c % family, up to turn crc32(c) % spans, then c's own from there.

    rows: as paths() gives them. Gives rows of the same form with the length of the conversation they are in, and conv_id and length
    of all conversations, with and without turns. The remainder of a negative c is that of SQL.
    """
    rows = cut(rows)
    own = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % spans)
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("_most"))
    head = F.least(F.coalesce("_most", F.lit(0)), F.col("h"))
    convs = own.join(base, "base", "left").withColumn("head", head)
    convs = cut(convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "head", "length"))
    first = rows.where(F.col("ord") < spans - 1).withColumnRenamed("conv_id", "base").join(convs, "base").where("ord < h")
    rest = rows.join(convs, "conv_id").where("ord >= h").withColumn("ord", F.col("head") + F.col("ord") - F.col("h"))
    columns = "conv_id", "ord", "t1", "t2", "n_bytes", "length"
    return first.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id", "length")


class Messages:
    """A priority queue of tuples, smallest first, that keeps `held` of them in memory and the rest in sorted runs.

    Runs are unnamed files in the task's own spill space, as those of Spark's sorts are: they end with the task, and a lost
    executor's tasks write theirs again.
    """

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.spilled = held, [], [], 0

    def send(self, message: tuple) -> None:
        import heapq
        import pickle
        import tempfile

        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for k in range(0, len(self.heap), READ):
                pickle.dump(self.heap[k : k + READ], run)
            run.seek(0)
            self.heap, self.spilled = [], self.spilled + 1
            self._enter(self._read(run), self.spilled)

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        import pickle

        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _enter(self, rest: Iterator[tuple], number: int) -> None:
        import heapq

        head = next(rest, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, rest))

    def take(self, key: tuple) -> Iterator[tuple]:
        """The messages that begin with key, which must be those that come first."""
        import heapq

        while True:
            inside = self.heap and self.heap[0][: len(key)] == key
            if self.runs and self.runs[0][0][: len(key)] == key and not (inside and self.heap[0] <= self.runs[0][0]):
                head, number, rest = heapq.heappop(self.runs)
                self._enter(rest, number)
                yield head
            elif inside:
                yield heapq.heappop(self.heap)
            else:
                return


def swept(rows: DataFrame, held: int = HELD) -> DataFrame:
    """rows with n_children, n_leaves and saved_tokens of all their subtree, as far as it is in the same partition.

    rows: depth, a, b (together a node's name), up_depth, up_a, up_b (its parent's), inside (the parent is in the partition), these
    three sums as far as they come from elsewhere, and any others; sorted by depth, deepest first, and a and b. A
    node without children is a leaf.
    """
    names = ["depth", "a", "b", "up_depth", "up_a", "up_b", "inside", "n_children", "n_leaves", "saved_tokens"]
    others = [c for c in rows.columns if c not in names]
    schema = StructType([rows.schema[c] for c in (*others, *names)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        queue = Messages(held)
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            sums = [[], [], []]
            for depth, a, b, up_depth, up_a, up_b, inside, children, leaves, saved in zip(*columns.values(), strict=True):
                for message in queue.take((-depth, a, b)):
                    children, leaves, saved = children + 1, leaves + message[4], saved + message[5]
                if not children:
                    leaves = 1
                if inside:
                    queue.send((-up_depth, up_a, up_b, len(sums[0]), leaves, saved))
                for column, value in zip(sums, (children, leaves, saved), strict=True):
                    column.append(value)
            made = dict(zip(names[-3:], (pa.array(c, pa.int64()) for c in sums), strict=True))
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in schema.names], names=schema.names)
        if queue.heap or queue.runs:
            raise ValueError("a message has no receiver in its shard")

    return rows.mapInArrow(run, schema)


def digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of ends (conv_id, depth, member): members ascending, joined by commas.

    A digest takes its members in order, so a node's are read by one task, which holds a batch of them.
    """

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        made = lambda done: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["conv_id", "depth", "ends_sha256"])
        at, digest = None, None
        for batch in batches:
            conv, depth, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "depth", "member"))
            edges = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1
            done = []
            for i, j in zip([0, *edges], [*edges, len(conv)], strict=True):
                if i == j:
                    continue
                said = ",".join(map(str, member[i:j].tolist())).encode()
                if at == (conv[i], depth[i]):
                    digest.update(b"," + said)
                    continue
                if at:
                    done.append((*at, digest.hexdigest()))
                at, digest = (conv[i], depth[i]), sha256(said)
            if done:
                yield made(done)
        if at:
            yield made([(*at, digest.hexdigest())])

    dealt = ends.select("conv_id", "depth", "member").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return dealt.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, lengths: DataFrame, most: int = MOST, held: int = HELD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node.

    rows: conv_id, ord, t1, t2, n_bytes, length; lengths: conv_id, length, a row per conversation, with and without turns.
    A conversation without turns is a member of the root. Without conversations there are no nodes. A prefix is known by a
    128-bit sum over its turns and their places.
    """
    whole = lambda c: c.cast("decimal(20,0)")  # noqa: E731  sums of up to 10**18 of them stay exact
    turns = rows.select("conv_id", (F.col("ord") + 1).alias("depth"), "length", "n_bytes", whole(F.xxhash64("ord", "t1", "t2")).alias("s1"), whole(F.xxhash64("t2", "ord", "t1")).alias("s2"))
    summed = running(turns, ["conv_id"], "depth", {"p1": F.col("s1"), "p2": F.col("s2")})
    name = lambda c: c.cast("decimal(38,0)")
    named = cut(summed.select("conv_id", "depth", "length", "n_bytes", *(name(F.col(f"p{i}")).alias(f"p{i}") for i in (1, 2)), *(name(F.col(f"p{i}") + F.col(f"s{i}")).alias(f"k{i}") for i in (1, 2))))
    below = F.sum(F.col("length") - F.col("depth")).alias("below")
    found = cut(
        named.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), below)
    )
    # the root is heavy, whatever it weighs
    root = cut(lengths.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0"))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent"), (F.col("below") > most).alias("up_heavy"))
    above = above.unionByName(root.select(F.lit(1).cast("long").alias("depth"), name(F.lit(0)).alias("p1"), name(F.lit(0)).alias("p2"), F.col("owner").alias("parent"), F.lit(True).alias("up_heavy")))
    linked = join_groups(found, above, ["depth", "p1", "p2"], F.col("owner"))
    # where each path meets its first light node: the root of the shard that all below belongs to
    met = cut(join_groups(named.select("conv_id", "depth", "length", "k1", "k2"), found.select("depth", "k1", "k2", "owner", "below"), ["depth", "k1", "k2"], F.col("conv_id")).select("conv_id", "depth", "length", "owner", "below"))
    tops = met.where(F.col("below") <= most).groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("top_depth"), F.min_by("owner", "depth").alias("top"))
    value = (F.col("n_convs") - 1) * F.col("n_bytes")
    sums = lambda saved: (F.lit(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    placed = linked.join(tops, "owner", "left").select(
        "depth", F.col("owner").alias("a"), zero.alias("b"), (F.col("depth") - 1).alias("up_depth"), F.col("parent").alias("up_a"), zero.alias("up_b"), (~F.col("up_heavy")).alias("inside"),
        *sums(value), "n_convs", (F.col("below") > most).alias("heavy"), "top", "top_depth",
    )
    nodes = cut(placed)
    light = nodes.where("not heavy").repartition("top", "top_depth").sortWithinPartitions(F.desc("depth"), "a")
    done = cut(swept(light.drop("heavy", "top", "top_depth"), held))

    # pieces of paths of heavy nodes, with what light shards sent to them
    totals = ("n_children", "n_leaves", "saved_tokens")
    add = lambda come: come.groupBy(F.col("up_a").alias("a"), F.col("up_depth").alias("depth")).agg(F.count("*").alias("_c"), *(F.sum(c).alias(f"_{c}") for c in totals[1:]))
    with_sent = lambda own, sent: own.join(sent, ["a", "depth"], "left").select(
        *(c for c in own.columns if c not in totals), *((F.col(c) + F.coalesce(F.col("_c" if c == "n_children" else f"_{c}"), F.lit(0))).alias(c) for c in totals)
    )
    top = root.select(
        zero.alias("depth"), F.col("owner").alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("up_depth"), F.lit(None).cast("long").alias("up_a"), zero.alias("up_b"), F.lit(False).alias("inside"),
        *sums(F.lit(0)), "n_convs",
    )
    heavy = nodes.where("heavy").drop("heavy", "top", "top_depth").unionByName(top)
    heavy = with_sent(heavy, add(done.where("not inside"))).withColumn("b", F.expr(f"depth div {most}"))
    heavy = cut(heavy.withColumn("up_b", F.expr(f"up_depth div {most}")).withColumn("inside", F.coalesce((F.col("up_a") == F.col("a")) & (F.col("up_b") == F.col("b")), F.lit(False))))
    pieces = heavy.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.min_by(F.struct("up_depth", "up_a", "up_b"), "depth").alias("up"), *(F.sum(c).alias(c) for c in totals[1:]))
    pieces = cut(pieces.withColumn("n_children", F.lit(1).cast("long")))  # a heavy node has turns below, so a piece is no leaf
    to = pieces.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("depth").alias("_to"))
    tree = pieces.select("depth", "a", "b", F.col("up.up_depth").alias("at_depth"), F.col("up.up_a").alias("up_a"), F.col("up.up_b").alias("up_b"), *totals)
    tree = tree.join(to, ["up_a", "up_b"], "left").withColumn("up_depth", F.col("_to")).withColumn("inside", F.col("_to").isNotNull()).drop("_to")
    summed_pieces = cut(swept(tree.repartition(1).sortWithinPartitions(F.desc("depth"), "a", "b"), held))  # a row for MOST turns or more
    sent = add(summed_pieces.where("inside").select("up_a", F.col("at_depth").alias("up_depth"), *totals))
    paths_up = with_sent(heavy, sent).repartition("a", "b").sortWithinPartitions(F.desc("depth"), "a", "b")
    every = done.select("a", "depth", "up_a", "n_convs", *totals).unionByName(swept(paths_up, held).select("a", "depth", "up_a", "n_convs", *totals))

    ends = met.where("depth = length").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    turnless = lengths.where("length = 0").select(F.col("conv_id").alias("member")).join(F.broadcast(root.select(F.col("owner").alias("conv_id"))))  # one row
    ends = ends.unionByName(turnless.select("conv_id", zero.alias("depth"), "member"))
    result = every.withColumnsRenamed({"a": "conv_id", "up_a": "parent_conv_id"}).join(digests(ends), ["conv_id", "depth"], "left")
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", *totals, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
