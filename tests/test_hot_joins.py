"""Joins with values that hold most rows, dealt apart or told to every task."""

import pytest

from canopyspark import shared


@pytest.mark.parametrize("by", [None, ["v"]])
def test_hot_values_join_whole(spark, by):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(600)] + [(None, -1)], "k long, v long")
    told = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "k long, t string")
    joined = shared.join_each(rows, told, ["k"], by=by)
    assert sorted(map(tuple, joined.select("k", "v", "t").collect())) == sorted(map(tuple, rows.join(told, "k").select("k", "v", "t").collect()))
    assert shared.hot_keys(rows, ["k"]).count() == 1
