"""Numbers and running sums of rows, with keys that are cut into ranges."""

import random

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import ranks


@pytest.mark.parametrize("least_rows", [5, 40, 10_000])
def test_row_numbers_and_sums(spark, least_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)]), i, i % 7) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t int, seq int, v bigint").repartition(6)
    got = {r["seq"]: (r["n"], r["s"]) for r in ranks.running_sums(ranks.row_numbers(df, ["k"], ["t", "seq"], "n", 64, least_rows), ["k"], ["t", "seq"], "v", "s", 64, least_rows).collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        mine, total = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 0
        for n, r in enumerate(mine, 1):
            total += r[3]
            assert got[r[2]] == (n, total)


def test_ranges_are_parts_of_a_frequent_key(spark):
    df = spark.range(4000).select((F.col("id") % 10 == 0).cast("int").alias("k"), "id")
    sizes = ranks.with_ranges(df, ["k"], ["id"], 64, 100)[0].groupBy("k", "_range").count().collect()
    assert max(r["count"] for r in sizes if r["k"] == 0) < 600 and len(sizes) > 20


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, t int")
    assert ranks.row_numbers(df, ["k"], ["t"], "n").collect() == []
