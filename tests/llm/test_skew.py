"""Joins with a key that holds much of the rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriesmill.llm.skew import hot_keys, join_hot


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(spark, how):
    keys = [7] * 60 + [8] * 30 + list(range(100, 110)) + [None] * 3
    left = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    # 8 and 101 are missing on the right; a null value stays null.
    values = {7: "a", 100: None, **{k: str(k) for k in range(102, 110)}}
    right = spark.createDataFrame(list(values.items()), "k int, v string")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = Counter(map(tuple, join_hot(left, right, "k", counts, how, slices=8).select("id", "k", "v").collect()))
    assert got == Counter((i, k, values.get(k)) for i, k in enumerate(keys) if how == "left" or k in values)
    hot = {r.k: r["_slices"] for r in hot_keys(counts, "k", 8).collect()}
    assert hot == {7: 5, 8: 3}


def test_join_hot_of_nothing(spark):
    left, right = spark.createDataFrame([], "id int, k int"), spark.createDataFrame([], "k int, v string")
    assert join_hot(left, right, "k", left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))).count() == 0
