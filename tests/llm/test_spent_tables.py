"""Operators drop the tables that they made on the way, and their results don't read them."""

import os
import random

import pytest

pytest.importorskip("rillflow.llm")
from rillflow.llm import lines, minhash  # noqa: E402
from rillflow.llm.common import components, parted  # noqa: E402


def _tables(spark):
    root = spark.sparkContext.getCheckpointDir()
    root = root.removeprefix("file:") if root else None
    return {name for name in os.listdir(root)} if root and os.path.isdir(root) else set()


def _texts():
    run = "\n".join(f"line number {i} of a run" for i in range(9))
    return [(i, f"own start {i}\n{run}\nown end {i} {'x' * i}") for i in range(40)] + [(100, None), (101, ""), (102, "alone")]


def test_line_dedup_keeps_its_runs_alone(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string")
    before = _tables(spark)
    found = lines.repeated_lines(docs)
    assert len(_tables(spark) - before) == 1
    once, twice = (sorted((r.doc_id, r.kept_text) for r in found.collect()) for _ in range(2))
    assert once == twice
    assert sum("a run" in (text or "") for _, text in once) == 1


def _shuffled(spark):
    """Bytes of all shuffles so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    doubles, none = context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, doubles, none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_runs_are_not_shuffled(spark, tmp_path):
    draw = random.Random(8)
    alone = [(1000 + i, "\n".join(draw.randbytes(400).hex() for _ in range(20))) for i in range(300)]
    spark.createDataFrame(_texts() + alone, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        found = {r.doc_id: r.kept_text for r in lines.repeated_lines(docs).collect()}
        sent = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert all(found[i] == text for i, text in alone) and len(found) == len(alone) + len(_texts())
    assert sent < sum(len(text) for _, text in alone) / 5


def test_a_full_filter_loses_no_key(spark):
    rows = spark.createDataFrame([(i,) for i in range(2000)] + [(None,)], "key long")
    keys = rows.where("key % 5 = 0 or key is null")
    for words, most in ((1 << 18, 410), (4, 2000)):
        may, without = (sorted(r.key if r.key is not None else -1 for r in part.collect()) for part in parted(rows, keys, "key", words))
        assert set(range(0, 2000, 5)) <= set(may) and len(may) <= most + 1
        assert sorted(may + without) == list(range(-1, 2000))


def test_near_duplicates_can_be_read_again(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[:-1] + [f"z{i}"])) for i in range(30)] + [(50, "quite another text of few words"), (51, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    before = _tables(spark)
    found = minhash.near_duplicates(docs)
    assert len(_tables(spark) - before) <= 6  # sets, sketches and labels that the result is made of
    once, twice = (sorted((r.doc_id, r.component_id, r.kept) for r in found.collect()) for _ in range(2))
    assert once == twice
    assert [r[1] for r in once] == [0] * 30 + [50, 51]


def test_components_keep_their_labels_alone(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(100, 101)], "a long, b long")
    before = _tables(spark)
    found = components(edges)
    assert len(_tables(spark) - before) == 1
    assert {r.component for r in found.collect()} == {0, 100} and found.count() == 9
