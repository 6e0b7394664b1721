"""Tables of the shared folder: what is computed once, and what goes when it's spent."""

import os

from rillflow.scratch import drop, stored


def _folders(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {name for name in os.listdir(root) if name.startswith("table-")}


def test_dropped_tables_leave_the_folder_and_others_stay(spark):
    first = stored(spark.range(10).toDF("a"))
    before = _folders(spark)
    second = stored(first.selectExpr("a * 2 as b"))
    made = _folders(spark) - before
    assert len(made) == 1
    drop(first)
    assert made <= _folders(spark) and len(_folders(spark)) == len(before)
    assert sorted(r.b for r in second.collect()) == list(range(0, 20, 2))  # needs nothing of the first


def test_drop_leaves_frames_alone_that_it_did_not_store(spark):
    plain, table = spark.range(3), stored(spark.range(3))
    filtered = table.where("id > 0")
    drop(plain, filtered)
    assert filtered.count() == 2
    drop(table)
    drop(table)  # a second time does nothing


def test_a_table_without_rows(spark):
    empty = stored(spark.range(3).where("id > 5"))
    assert empty.count() == 0 and empty.columns == ["id"]
    drop(empty)
