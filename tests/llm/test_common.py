"""Where intermediate tables stand, and when they go."""

import os

from trellisway.llm.common import materialize, new_path, remove_tables, scratch, small_lists, written


def local(path):
    return path.removeprefix("file://")


def test_tables_go_with_their_scope(spark):
    rows = spark.range(5)
    path = new_path(spark, "stays")
    with scratch(spark):
        inner = materialize(rows, "goes").inputFiles()[0]
        kept = written(rows, path)
        assert os.path.exists(local(inner))
    assert not os.path.exists(local(inner)) and kept.count() == 5
    assert spark.sparkContext.applicationId in path
    remove_tables(spark)
    assert not os.path.exists(local(path))


def test_lists_are_broadcast_by_size(spark):
    df = spark.createDataFrame([(1, [1] * 100), (2, [])], "id long, xs array<int>")
    plan = lambda d: spark.range(3).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small_lists(df, "xs", 4, 560)) and "strategy=broadcast" not in plan(small_lists(df, "xs", 4, 559))
