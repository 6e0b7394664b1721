"""Prefix trie, hard negatives and sharding against plain versions, with nulls, ties, repeats, hot groups and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("rillflow.llm")
from rillflow.llm import negatives, sharding, trie  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, depth string, a string, top string, tie string"


def plain_trie(paths):
    """A row per node of {conv: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        own = members[node]
        below = [out[k] for k in kids[node]]
        saved = ((len(own) - 1) * len(node[-1][1].encode()) if node else 0) + sum(b[6] for b in below)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(own), len(node), parent, len(own), len(below), sum(b[5] for b in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def conversations():
    draw = random.Random(3)
    rows = []
    for c in range(-6, 60):
        if c in (20, 21, 35):
            continue
        for k in range(draw.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, k if draw.random() < 0.9 else None, draw.choice(["user", "assistant", None]), draw.choice(["x", "yé", "", None])))
    rows += [(100 + c, k, "user", f"copy {k}") for c in range(40) for k in range(6)]  # copies
    rows += [(200, k, "user", "same") for k in range(400)] + [(200, 7, "user", "same")] * 30  # a hot conversation with repeated rows
    rows += [(201, k, "user", "same") for k in range(300)] + [(None, 1, "user", "lost"), (None, None, None, None)]
    draw.shuffle(rows)
    return rows


def expected_paths(rows):
    """Ties go by role, then by the rest; here tied rows of a role have equal texts or are told apart by the caller's order."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    return turns


@pytest.mark.parametrize("most,held", [(3, 2), (40, 5), (trie.MOST, trie.HELD)])
def test_trie_matches_a_plain_one(spark, most, held):
    rows = conversations()
    table = spark.createDataFrame([(*r, "d", "a", "t", "i") for r in rows], TURNS).repartition(5)
    placed = trie.paths(table)
    # the order that paths() gives tied turns is read from it; all else is plain
    names = {(r.t1, r.t2): (r.role, r.text) for r in table.select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct().select(
        "role", "text", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2")).collect()}
    own = defaultdict(dict)
    for r in placed.collect():
        own[r.conv_id][r.ord] = names[r.t1, r.t2]
    sorted_turns = expected_paths(rows)
    assert set(own) == set(sorted_turns)
    for c, path in own.items():
        assert sorted(path) == list(range(len(path)))
        assert Counter(path.values()) == Counter((role, text) for _, role, text in sorted_turns[c])
        keys = {t: [k for k in sorted_turns[c] if k[0] == t] for t in {k[0] for k in sorted_turns[c]}}
        at = 0
        for t in sorted(keys):  # each group of tied turns stands together, in order of roles
            span = [path[i] for i in range(at, at + len(keys[t]))]
            assert Counter(span) == Counter(k[1:] for k in keys[t]) and [r for r, _ in span] == sorted(r for r, _ in span)
            at += len(span)
    paths = {}
    for c, path in own.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        paths[c] = [own[base][i] for i in range(min(h, len(own.get(base, {}))))] + [path[i] for i in range(h, len(path))]
    got = trie.prefix_trie(*trie.branched(placed), most=most, held=held).collect()
    assert sorted(tuple(r) for r in got) == plain_trie(paths) and any(not p for p in paths.values())


def test_trie_of_no_conversations_and_of_one(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(*trie.branched(trie.paths(none))).count() == 0
    one = spark.createDataFrame([(0, 0, "user", "é" * 200_000, "", "", "", "")], TURNS)
    assert [r.depth for r in trie.prefix_trie(*trie.branched(trie.paths(one), spans=1)).orderBy("depth").collect()] == [0, 1]


def test_queue_spills_and_keeps_order():
    draw = random.Random(1)
    queue, sent = trie.Messages(50), []
    for k in range(2000):
        sent.append((draw.randrange(40), draw.randrange(5), 0, k))
        queue.send(sent[-1])
    assert queue.spilled > 10 and len(queue.heap) <= 50
    got = [m for key in sorted({m[:2] for m in sent}) for m in queue.take(key)]
    assert got == sorted(sent) and not queue.heap and not queue.runs


# --- hard negatives
VECTORS = "vec_id long, embedding array<float>, label int, g int, size int, ids string, score long"


def vectors():
    draw = random.Random(6)
    out = []
    for i in range(400):
        center = i % 4
        out.append((i, [draw.gauss(center == j, 0.4) for j in range(6)], None if i % 37 == 5 else i % 3))
    out += [(400 + i, list(out[1][1]), 1) for i in range(30)]  # equal vectors: ties
    out += [(500, [0.0] * 6, 0), (501, None, 0), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (503, [math.nan] * 6, 0), (504, [math.inf] * 6, 0), (600, [1.0, 2.0], 0), (601, [0.5, 2.0], 0), (602, [0.4, 1.0], 1), (700, [], 0), (701, [], 0), (702, [], 1)]
    out += [(None, list(out[0][1]), 0), (None, list(out[0][1]), 1), (100, *out[100][1:]), (7, *out[7][1:]), (7, *out[7][1:])]
    out += [(800, [3e38] * 6, 0), (801, [1e30] * 6, 0), (802, [-3e38, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (803, [2.0**30] * 6, 1)]
    draw.shuffle(out)
    return out


def plain_negatives(rows, positives=5, k=10):
    good = [(NO if i is None else i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, lab in sorted({(i, tuple(v), lab) for i, v, lab in good if i != NO and i % 100 == 0}):
        cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scored = [(-cut(sum(x * y for x, y in zip(v, w, strict=True))), i, other) for i, w, other in good if len(w) == len(v)]
        chosen = sorted(s[:2] for s in scored if s[2] == lab and s[1] != a)[:positives]
        for p, i in chosen:
            inside = sorted(s[:2] for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p)[:k]
            out += [(a, None if i == NO else i, r + 1, None if j == NO else j, -p, -s) for r, (s, j) in enumerate(inside)]
    return out


NO = negatives.NO_ID


@pytest.mark.parametrize("block,group", [(7, 2), (512, 1024)])
def test_negatives_match_all_pairs(spark, block, group):
    rows = vectors()
    table = spark.createDataFrame([(*r, 0, 0, "i", 0) for r in rows], VECTORS).repartition(4)
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, block=block, group=group).collect()
    order = lambda found: sorted(found, key=str)
    assert order(tuple(r) for r in got) == order(plain_negatives(rows)) and len(got) > 150
    assert {r.anchor_id for r in got} >= {0, 100, 200, 300, 600, 700}
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(table, F.lit(True), low=50, high=50)


# --- sharding
DOCS = "doc_id long, text string, row string, shard string, slot string, _part string, own string"


def texts():
    draw = random.Random(9)
    out = [(i, draw.choice(["a", "bé", "", None, "w " * draw.randrange(50)])) for i in range(900)]
    return out + [(1, "same")] * 500 + [(None, None)] * 5 + [(5000, "long " * 100_000)]


def check_shards(got, rows, shards):
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_exact_and_repeatable(spark, tmp_path):
    rows = texts()
    table = spark.createDataFrame([(*r, "r", "s", "l", "p", "o") for r in rows], DOCS)
    table.repartition(6).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    place = lambda found: sorted((str(r.row), r["shard"], r.slot) for r in found)
    first = sharding.shuffle(stored, 7, seed=3, part=100, cell=16).collect()
    check_shards(first, rows, 7)
    assert place(sharding.shuffle(stored, 7, seed=3, part=100, cell=16).collect()) == place(first) != place(sharding.shuffle(stored, 7, seed=4, part=100, cell=16).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # other tasks, the same places
    try:
        assert place(sharding.shuffle(stored, 7, seed=3, part=100, cell=16).collect()) == place(first)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    check_shards(sharding.shuffle(table, 24).collect(), rows, 24)  # rows of no file
    some = [r for r in rows if r[0] != 1]
    check_shards(sharding.shuffle(stored.where("doc_id is distinct from 1"), 5).collect(), some, 5)  # a part of a file's rows
    check_shards(sharding.shuffle(stored.limit(3), 24).collect(), [(r.row.doc_id, r.row.text) for r in sharding.shuffle(stored.limit(3), 1).collect()], 24)
    assert sharding.shuffle(stored.limit(0), 24).count() == 0 == sharding.shuffle(table.limit(0), 3).count()
    sharding.write_shards(sharding.shuffle(stored, 7, seed=3, part=100, cell=16), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert place(back.collect()) == place(first)


def test_matrix_rows_have_the_right_law():
    """Margins are exact, and a row's counts follow the hypergeometric law, drawn by numpy or here."""
    ends, cells = np.cumsum([5, 9, 4, 6]), [8, 8, 8]
    for below in (10**9, 2):
        rows = [[sharding.matrix_row(p, ends, cells, seed, below) for p in range(4)] for seed in range(1500)]
        assert all((np.sum(m, 0) == cells).all() and [int(r.sum()) for r in m] == [5, 9, 4, 6] for m in rows)
        for part, n in ((1, 9), (3, 6)):
            seen = Counter(int(m[part][2]) for m in rows)
            law = {k: math.comb(8, k) * math.comb(16, n - k) / math.comb(24, n) for k in range(n + 1)}
            assert all(abs(seen[k] / 1500 - law.get(k, 0)) < 0.055 for k in range(n + 1))
    rng = np.random.default_rng(0)
    drawn = [sharding.large(rng, 10**10, 3 * 10**10, 10**6) for _ in range(300)]
    assert abs(np.mean(drawn) - 250_000) < 100 and 330 < np.std(drawn) < 540
    assert sharding.large(rng, 5, 0, 3) == 3 and sharding.large(rng, 0, 7, 3) == 0 and sharding.large(rng, 4, 4, 8) == 4


def test_all_orders_are_as_likely(spark, tmp_path):
    """Four rows, in two parts, over two shards of two: each of the 24 orders comes up about as often."""
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "in"))
    stored, seen = spark.read.parquet(str(tmp_path / "in")), Counter()
    for seed in range(40):
        seen[tuple(r.row.id for r in sorted(sharding.shuffle(stored, 2, seed=seed, part=2, cell=1).collect(), key=lambda r: (r["shard"], r.slot)))] += 1
    assert len(seen) >= 14 and max(seen.values()) <= 9
