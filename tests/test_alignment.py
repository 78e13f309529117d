"""Alignment of tables with differing keys."""

import pytest

from tillroll.operators.alignment import align


def test_keys_missing_on_each_side_and_null_keys(spark):
    a = spark.createDataFrame([(1, 10.0), (2, None), (None, 3.0)], "id long, x double")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "id long, y string")
    c = spark.createDataFrame([(None, [1, 2]), (4, None)], "id long, z array<int>")
    rows = align({"A": a, "B": b, "C": c}, "id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows.columns == ["id", "x", "y", "z", "InA", "InB", "InC"]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        (1, 10.0, None, None, True, False, False), (2, None, "b", None, True, True, False), (3, None, "c", None, False, True, False),
        (4, None, None, None, False, False, True), (None, 3.0, None, [1, 2], True, False, True)], key=str)


def test_duplicate_keys_and_shared_columns_are_refused(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "id long, x int")
    b = spark.createDataFrame([(1, 1)], "id long, y int")
    with pytest.raises(Exception, match="A has a key twice: 1"):
        align({"A": a, "B": b}, "id").collect()
    with pytest.raises(ValueError, match="column x"):
        align({"A": a, "B": b.withColumnRenamed("y", "x")}, "id")


def test_empty_frames(spark):
    a = spark.createDataFrame([], "id long, x int")
    b = spark.createDataFrame([(1, 1)], "id long, y int")
    assert [tuple(r) for r in align({"A": a, "B": b}, "id").collect()] == [(1, None, 1, False, True)]
