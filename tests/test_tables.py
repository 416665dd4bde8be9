"""Tables between steps: sizes from the write, broadcasts within a bound, clean-up."""

import os
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pagewright import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sizes_come_from_the_write(spark):
    df = spark.createDataFrame([(1, "é" * 50, [1, 2], [("a", 1)]), (2, None, None, None)], "k long, t string, a array<int>, s array<struct<x:string,y:int>>")
    out = tables.saved(df)
    assert tables.rows_of(out) == 2 and 2 * tables.ROW_BYTES + 100 < out._pagewright[1] < 500
    assert sorted(r.k for r in out.collect()) == [1, 2]
    empty = tables.saved(df.limit(0))
    assert tables.rows_of(empty) == 0 and tables.is_small(empty) and empty.count() == 0
    assert not tables.is_small(tables.saved(df, sized=False))


def test_only_small_sides_are_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = spark.range(100).withColumnRenamed("id", "k"), tables.saved(spark.range(50).withColumnRenamed("id", "k"))
        assert "BroadcastHashJoin" in plan_of(left.join(tables.small_side(right), "k"))
        assert "BroadcastHashJoin" not in plan_of(left.join(tables.small_side(right, limit=100), "k"))
        # What was not written is measured.
        assert "BroadcastHashJoin" not in plan_of(left.join(tables.small_side(right.where("k > 1"), limit=100), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_workspace_leaves_what_it_is_told_to(spark):
    with tables.workspace(spark) as keep:
        gone, kept = tables.saved(spark.range(3)), tables.saved(spark.range(4).select(F.col("id") * 2))
        keep.append(kept)
    assert not os.path.exists(gone._pagewright[2]) and os.path.exists(kept._pagewright[2]) and kept.count() == 4
    assert tables.drop_saved(spark) >= 1 and not os.path.exists(kept._pagewright[2])


def test_workspaces_of_two_threads_leave_each_other_alone(spark):
    opened, done = threading.Event(), threading.Event()
    seen = {}

    def other():
        opened.wait(60)
        with tables.workspace(spark) as keep:
            seen["table"] = tables.saved(spark.range(5))
            keep.append(seen["table"])
        seen["loose"] = tables.saved(spark.range(6))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with tables.workspace(spark):
        mine = tables.saved(spark.range(7))
        opened.set()
        done.wait(120)
        assert mine.count() == 7
    thread.join()
    assert seen["table"].count() == 5 and seen["loose"].count() == 6 and not os.path.exists(mine._pagewright[2])
    tables.drop_saved(spark)


def test_an_error_leaves_no_table(spark):
    with pytest.raises(KeyError), tables.workspace(spark) as keep:
        keep.append(tables.saved(spark.range(3)))
        with tables.workspace(spark) as inner:
            inner.append(tables.saved(spark.range(4)))
        raise KeyError("x")
    assert not any(os.path.exists(df._pagewright[2]) for df in (*keep, *inner)) and tables.drop_saved(spark) == 0


def test_few_rows_make_few_files(spark):
    out = tables.saved(spark.range(1000, numPartitions=8), rows=1000)
    assert out.rdd.getNumPartitions() == 1
    tables.drop_saved(spark)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: None)
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            tables.scratch_dir(session(master))
    assert os.path.isdir(tables.scratch_dir(session("local[2]")))
