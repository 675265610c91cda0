"""Reads of metrics on small observation tables."""

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import numbers
from seriesmill.functions.labels import LabelDomain
from seriesmill.operators import aggregate, sampling, temporality

SCHEMA = "op string, value_l bigint, value_d double, ts int, seq bigint, producer string, window int, label string"


def obs(spark, values, op="add", double=False, windows=None, labels=None):
    rows = [(op[i] if isinstance(op, list) else op, None if double else v, float(v) if double else None, 0, i, "p", windows[i] if windows else 1, labels[i] if labels else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    return df.first().asDict()


def test_counter(spark):
    assert one(aggregate.counter_sum(obs(spark, [1, 1, 1])))["sum"] == 3
    assert one(aggregate.counter_sum(obs(spark, [])))["sum"] == 0
    assert one(aggregate.counter_sum(obs(spark, [5, -9])))["sum"] == -4


def test_counter_swap(spark):
    got = {r.window: r.sum for r in aggregate.counter_swap(obs(spark, [40, 60, 7], windows=[1, 1, 2]), F.col("window")).collect()}
    assert got == {1: 100, 2: 7}


def test_counter_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        aggregate.counter_sum(obs(spark, [2**63 - 1, 1])).collect()


def test_gauges(spark):
    assert one(aggregate.gauge_last(obs(spark, [44331.8, -273.15], "set", True), initial=0.0))["value"] == -273.15
    assert one(aggregate.gauge_last(obs(spark, [], "set", True), initial=1.5))["value"] == 1.5


@pytest.mark.parametrize(
    "values, kw, want",
    [([3, 7, 5], {}, 7), ([-3], {"max_initial": -10}, -3), ([], {"max_initial": -10}, -10), ([], {}, 0)],
)
def test_max_gauge(spark, values, kw, want):
    assert one(aggregate.extrema(obs(spark, values), **kw))["max"] == want


def test_min_gauge(spark):
    assert one(aggregate.extrema(obs(spark, [])))["min"] == 2**63 - 1
    assert one(aggregate.extrema(obs(spark, [8, 3, 5])))["min"] == 3


def test_extrema_of_doubles(spark):
    got = one(aggregate.extrema(obs(spark, [-3.25, -8.0], double=True), value="value_d", max_initial=-10.0))
    assert got["max"] == -3.25 and got["min"] == -8.0
    assert one(aggregate.extrema(obs(spark, [float("nan")], double=True), value="value_d", max_initial=1.0)) == {"max": 1.0, "min": float("inf")}


def test_extrema_reset_by_window(spark):
    windows = spark.createDataFrame([(1,), (2,), (3,)], "window int")
    got = {r.window: r.max for r in aggregate.extrema_reset(obs(spark, [9, 4, 2], windows=[1, 1, 2]), windows, "window").collect()}
    assert got == {1: 9, 2: 2, 3: 0}


def test_set_and_add(spark):
    ops = ["set", "add", "add", "set", "add"]
    assert one(aggregate.set_add_fold(obs(spark, [10, 3, -1], ops[:3])))["value"] == 12
    assert one(aggregate.set_add_fold(obs(spark, [10, 3, -1, 4, 2], ops)))["value"] == 6
    rows = obs(spark, [10, 3, 5], ["set", "add", "add"], labels=["a", "a", "b"]).withColumn("labels", F.create_map(F.lit("k"), "label"))
    got = {r.labels["k"]: r.value for r in aggregate.set_add_fold(rows, ["labels"]).collect()}
    assert got == {"a": 13, "b": 5}


def test_histogram(spark):
    bounds = (10, 100, 1000)
    hist = aggregate.histogram(obs(spark, [5, 50, 500, 5000]), bounds)
    assert one(hist) == {"counts": [1, 1, 1, 1], "count": 4, "sum": 5555}
    assert [(r.le, r.cumulative) for r in aggregate.histogram_cumulative(hist, bounds).orderBy("idx").collect()] == [(10, 1), (100, 2), (1000, 3), (None, 4)]
    edge = aggregate.histogram(obs(spark, [10, 100]), (10, 100))
    assert [r.cumulative for r in aggregate.histogram_cumulative(edge, (10, 100)).orderBy("idx").collect()] == [1, 2, 2]


def test_histogram_bounds_in_the_order_given(spark):
    assert one(aggregate.histogram(obs(spark, [5, 50]), (100, 10)))["counts"] == [2, 0, 0]


def exp(spark, values):
    return aggregate.exponential_stats(aggregate.exponential_histogram(obs(spark, values)))


def test_exponential_histogram(spark):
    got = one(exp(spark, [1, 2, 3, 100]))
    assert got["positive"] == {0: 1, 1: 2, 6: 1} and (got["count"], got["sum"], got["zero_count"]) == (4, 106, 0)
    got = one(exp(spark, [0, 0, 42]))
    assert (got["count"], got["sum"], got["zero_count"], got["min"]) == (3, 42, 2, 0)
    got = one(exp(spark, [100]))
    assert (got["min"], got["max"], got["mean"]) == (64, 127, 100.0)
    got = one(exp(spark, []))
    assert got["count"] == 0 and got["min"] is None and got["max"] is None and got["mean"] is None


def test_largest_bucket(spark):
    got = one(exp(spark, [2**63 - 1]))
    assert got["positive"] == {62: 1} and got["max"] == 2**63 - 1


def test_negative_values_are_refused(spark):
    with pytest.raises(Exception, match="no negative"):
        exp(spark, [-1]).collect()


def test_bucket_index(spark):
    values = [1, 2, 3, 4, 5, 7, 255, 256, 1024, 2**48 - 1, 2**53 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select(numbers.bucket_index(F.col("v"))).collect()
    assert [r[0] for r in rows] == [0, 1, 1, 2, 2, 2, 7, 8, 10, 47, 52]


def test_samples_zero_first(spark):
    rows = aggregate.exponential_samples(aggregate.exponential_histogram(obs(spark, [0, 1, 100, 200]))).orderBy("pos").collect()
    assert [(r.midpoint, r.n) for r in rows] == [(0, 1), (1, 1), (96, 1), (192, 1)]


def test_compact_buckets(spark):
    rows = spark.createDataFrame([({6: 1, 8: 2},), ({},)], "m map<int,bigint>").select(numbers.compact_buckets(F.col("m")).alias("c")).collect()
    assert [(r.c.offset, r.c.counts) for r in rows] == [(6, [1, 0, 2]), (0, [])]


def test_timer(spark):
    calls = sampling.stride_sample(obs(spark, [10, 20], "elapsed"), 1)
    got = one(aggregate.timer(calls))
    assert (got["calls"], got["sample_count"], got["sample_sum"], got["sample_avg"]) == (2, 2, 30, 15.0)
    got = one(aggregate.timer(sampling.stride_sample(obs(spark, [10] * 8, "elapsed"), 4)))
    assert (got["calls"], got["sample_count"]) == (8, 2)
    labeled = aggregate.timer(sampling.stride_sample(obs(spark, [15, 25, 35], "elapsed", labels=["A", "B", "A"]), 1), by=["label"])
    assert {r.label: (r.calls, r.sample_sum) for r in labeled.collect()} == {"A": (2, 50), "B": (1, 25)}


def test_stride_mask():
    assert [sampling.stride_mask(s) for s in (0, 1, 2, 3, 4, 5, 8)] == [0, 0, 1, 3, 3, 7, 7]


def test_occupancy_shift(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.26, 0.5, 0.75, 0.76)], "o double").select(sampling.shift_of(F.col("o"))).collect()
    assert [r[0] for r in rows] == [0, 0, 5, 5, 6, 7]


def test_closed_domain(spark):
    domain = LabelDomain("method", ("get", "post", "put"))
    sums = aggregate.counter_sum(obs(spark, [1, 1, 5], labels=["get", "get", "post"]), ["label"])
    got = aggregate.complete(sums, domain, "label", {"sum": F.lit(0).cast("bigint")}).orderBy("idx").collect()
    assert [(r.label, r.sum) for r in got] == [("get", 2), ("post", 5), ("put", 0)]
    assert domain.from_index(99) == "put"


def test_delta_policies(spark):
    totals = spark.createDataFrame([("s", i, c) for i, c in enumerate([10, 4, 9])], "series string, at int, c bigint")
    deltas = {p: [r.c_delta for r in temporality.delta(totals, ["c"], p, ["series"], "at").orderBy("at").collect()] for p in ("signed", "reset", "saturate")}
    assert deltas == {"signed": [10, -6, 5], "reset": [10, 4, 5], "saturate": [10, 5]}


def test_delta_by_kind(spark):
    totals = spark.createDataFrame([("s", 1, 2), ("s", 2, 5)], "series string, at int, c bigint")
    assert [r.c for r in temporality.export(totals, "counter", ["c"], ["series"], "at", temporality.DELTA).orderBy("at").collect()] == [2, 3]
    assert [r.c for r in temporality.export(totals, "gauge", ["c"], ["series"], "at", temporality.DELTA).orderBy("at").collect()] == [2, 5]


def test_distribution_delta_lines(spark):
    from seriesmill.operators import exposition

    rows = [("s", 1, {2: 1, 3: 1}, 0), ("s", 2, {2: 1, 3: 1}, 0), ("s", 3, {2: 1, 3: 1, 6: 1}, 1)]
    totals = spark.createDataFrame(rows, "series string, at int, positive map<int,bigint>, zero_count bigint")
    lines = exposition.with_midpoints(temporality.bucket_deltas(totals, ["series"], "at"))
    got = [(r.at, r.midpoint, r.n) for r in lines.orderBy("at", "pos").collect()]
    assert got == [(1, 6, 1), (1, 12, 1), (3, 96, 1), (3, 0, 1)]
