"""Label sets, caps with overflow, eviction."""

import time
from enum import Enum

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from seriesmill.functions.labels import LabelDomain, domain_of, from_pairs, prometheus_labels, snake_case, snake_case_column
from seriesmill.operators import aggregate, cardinality
from seriesmill.operators.cardinality import OVERFLOW_KEY
from seriesmill.plans import counted

SCHEMA = "metric string, labels map<string,string>, value_l bigint, ts int, seq bigint, cycle bigint"


def obs(spark, rows):
    """Rows of (labels, value, cycle)."""
    return spark.createDataFrame([("m", labels, v, c, i, c) for i, (labels, v, c) in enumerate(rows)], SCHEMA)


def test_key_order_does_not_matter(spark):
    rows = obs(spark, [({"org_id": "42", "endpoint_uuid": "abc"}, 1, 0), ({"endpoint_uuid": "abc", "org_id": "42"}, 2, 0)])
    series = aggregate.snapshot(rows, aggregate.counter_sum)
    assert [r["sum"] for r in series.collect()] == [3]
    assert aggregate.point_read(series, F.col("labels"), {"endpoint_uuid": "abc", "org_id": "42"}, {"sum": F.lit(0).cast("bigint")}).first()["sum"] == 3
    assert aggregate.point_read(series, F.col("labels"), {"org_id": "1"}, {"sum": F.lit(0).cast("bigint")}).first()["sum"] == 0


@pytest.mark.parametrize("policy", ["EXCEPTION", "LAST_WIN"])
def test_last_of_a_repeated_key_wins(spark, policy):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
    try:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("b", "0"), ("a", "1"), ("a", "2"))])
        assert spark.range(1).select(from_pairs(pairs).alias("m")).first().m == {"a": "2", "b": "0"}
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def test_escaping(spark):
    m = F.create_map(F.lit("k"), F.lit('a"b\\c\nd'))
    assert spark.range(1).select(prometheus_labels(m)).first()[0] == 'k="a\\"b\\\\c\\nd"'
    assert spark.range(1).select(prometheus_labels(m, True)).first()[0] == 'k="a"b\\c\nd"'


def test_snake_case(spark):
    names = {"NotFound": "not_found", "InternalServerError": "internal_server_error", "BadRequest": "bad_request", "Success2xx": "success2xx"}
    assert {n: snake_case(n) for n in names} == names
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", snake_case_column(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == names


def test_domain_of_an_enum():
    class Status(Enum):
        NotFound = 0
        Unknown = 1

    assert domain_of(Status, "status", {"Unknown": "other"}).values == ("not_found", "other")
    with pytest.raises(ValueError):
        LabelDomain("x", ())
    with pytest.raises(ValueError):
        LabelDomain("", ("a",))


def ids(*numbers):
    return [({"org_id": str(n)}, v, 0) for n, v in numbers]


def test_cap(spark):
    rows = obs(spark, ids((1, 1), (2, 1), (3, 1)))
    series = aggregate.counter_sum(cardinality.cap_series(rows, 2), ["labels"])
    got = {tuple(r.labels.items()): r["sum"] for r in series.collect()}
    assert got == {(("org_id", "1"),): 1, (("org_id", "2"),): 1, ((OVERFLOW_KEY, "true"),): 1}
    stats = cardinality.overflow_stats(rows, 2).first()
    assert (stats.overflow_records, stats.overflow_series, stats.cardinality) == (1, 1, 3)
    assert aggregate.sum_all(series).first().sum_all == 3


def test_cap_of_one_and_none(spark):
    rows = obs(spark, ids((1, 1), (2, 2)))
    got = aggregate.counter_sum(cardinality.cap_series(rows, 1), ["labels"]).where(cardinality.is_overflow(F.col("labels"))).first()
    assert got["sum"] == 2
    assert cardinality.cap_series(rows, 0).where("redirected").count() == 0


def test_eviction(spark):
    a, b = {"id": "a"}, {"id": "b"}
    rows = obs(spark, [(a, 1, 0), (b, 1, 2), (a, 1, 3)])
    keyed = rows.withColumn("id", F.col("labels")["id"])
    g = cardinality.generations(keyed, "cycle", 1, ["id"])
    live = cardinality.live_generations(g, 3, 1, ["id"], "cycle", [F.sum("value_l").alias("sum")])
    assert sorted((r.id, r.generation, r["sum"], r.evicted) for r in live.collect()) == [("a", 0, 1, True), ("a", 1, 1, False), ("b", 0, 1, False)]


def test_active_series_stay(spark):
    rows = obs(spark, [({"id": "act"}, 1, 0), ({"id": "stale"}, 1, 0), ({"id": "act"}, 1, 1)]).withColumn("id", F.col("labels")["id"])
    live = cardinality.live_generations(cardinality.generations(rows, "cycle", 1, ["id"]), 2, 1, ["id"], "cycle", [F.sum("value_l").alias("sum")])
    assert {r.id: (r["sum"], r.evicted) for r in live.collect()} == {"act": (2, False), "stale": (1, True)}


def test_pinned_series_stay(spark):
    rows = obs(spark, [({"id": "a"}, 1, 0), ({"id": "a"}, 1, 9)]).withColumn("id", F.col("labels")["id"]).withColumn("pin", F.lit(True))
    assert cardinality.generations(rows, "cycle", 1, ["id"], "pin").select(F.max("generation")).first()[0] == 0


def fold(rows, cap, idle):
    """The sequential definition of cap and eviction together."""
    live, born, out, clock = {}, {}, [], None
    for key, cycle in rows:
        if cycle != clock:
            live = {k: t for k, t in live.items() if cycle - t <= idle}
            clock = cycle
        admit = key in live or len(live) < cap
        if admit and key not in live:
            born[key] = born.get(key, -1) + 1
        live[key if admit else "over"] = cycle
        out.append((key, cycle, born.get(key, 0), not admit))
    return sorted(set(out))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.integers(0, 12)), min_size=1, max_size=25), st.integers(1, 3), st.integers(0, 3))
def test_cap_and_evict_is_the_fold(spark, touches, cap, idle):
    # One touch of a label set in a cycle: later ones of it change nothing.
    touches = list(dict.fromkeys(sorted(touches, key=lambda x: x[1])))
    rows = obs(spark, [({"id": k}, 1, c) for k, c in touches])
    got = cardinality.cap_and_evict(rows, "cycle", cap, idle).collect()
    assert sorted((r.labels["id"], r.cycle, r.generation, r.redirected) for r in got) == fold(touches, cap, idle)


def test_cap_and_evict_folds_only_the_first_touches(spark, monkeypatch):
    """Of 300 series a cycle, no more than one above the cap reaches the one task; the result is that of the whole fold."""
    cap, idle, met = 3, 1, spark.sparkContext.accumulator(0)
    touches = [(f"s{(17 * i + 5 * c) % 900}", c) for c in (0, 1, 2, 5, 6, 9) for i in range(300)]
    rows = obs(spark, [({"id": k}, 1, c) for k, c in touches])
    whole = type(rows).mapInArrow

    def counted_fold(df, f, schema):
        def g(batches):
            def seen():
                for b in batches:
                    met.add(b.num_rows)
                    yield b

            return f(seen())

        return whole(df, g, schema)

    monkeypatch.setattr(type(rows), "mapInArrow", counted_fold)
    got = cardinality.cap_and_evict(rows, "cycle", cap, idle).collect()
    assert sorted((r.labels["id"], r.cycle, r.generation, r.redirected) for r in got) == fold(touches, cap, idle)
    assert 0 < met.value <= 6 * (cap + 1)


def test_counts_without_a_second_scan(spark):
    """Observed counts of the capped rows are those of overflow_stats."""
    rows = obs(spark, [({"id": str(i % 7)}, 1, i) for i in range(50)])
    seen = Observation("cap")
    out = counted.counted(cardinality.cap_series(rows, 3), seen, counted.overflow_counts()).collect()
    stats = cardinality.overflow_stats(rows, 3).first()
    assert seen.get == {"overflow_records": stats.overflow_records, "records": 50} and sum(r.redirected for r in out) == stats.overflow_records


def test_counts_of_a_stream(spark, tmp_path):
    rows = obs(spark, [({"id": str(i % 7)}, 1, i) for i in range(50)]).withColumn("recorded", F.col("seq") % 3 == 0).withColumn("parent_span_id", F.lit(None).cast("string"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    counters = counted.StreamCounters()
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        q = counted.counted(stream, "spans", counted.span_counts()).where("recorded").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        end = time.time() + 20
        while counters.totals["spans"]["recorded_count"] < 17 and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals["spans"] == {"recorded_count": 17, "sampled_out_count": 33, "len": 17}
