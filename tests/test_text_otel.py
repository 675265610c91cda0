"""Text lines, OTel rows, OTLP JSON, metric sets."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesmill.functions.labels import LabelDomain
from seriesmill.functions.numbers import compact_float_text, cumulative_to_buckets, float_text, sql_float_text
from seriesmill.operators import aggregate, exposition, otel
from seriesmill.plans.metric_set import MetricSet, MetricSpec
from seriesmill.sources.observations import OBSERVATION

R = otel.Resource("svc", 1_000_000_000)


def obs(spark, rows):
    """Rows of (metric, op, labels, value)."""
    data = [(m, op, labels, v if isinstance(v, int) else None, float(v), None, None, i, "p") for i, (m, op, labels, v) in enumerate(rows)]
    return spark.createDataFrame(data, OBSERVATION)


def lines(df):
    return [r.line for r in exposition.ordered(df).collect()]


def test_float_texts(spark):
    values = {42.0: ("42.0", "42"), 0.75: ("0.75", "0.75"), 1e16: ("1e16", "1e16"), 1e15: ("1000000000000000.0", "1000000000000000"), 1.5e-7: ("1.5e-7", "1.5e-7"), 0.00001: ("0.00001", "0.00001"), -273.15: ("-273.15", "-273.15"), 1e7: ("10000000.0", "10000000"), float("inf"): ("inf", "inf"), float("-inf"): ("-inf", "-inf")}
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v")), compact_float_text(F.col("v"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == values
    row = spark.sql("select double('NaN') n, double('-0.0') z").select(float_text(F.col("n")), compact_float_text(F.col("n")), float_text(F.col("z")), compact_float_text(F.col("z"))).first()
    assert tuple(row) == ("NaN", "NaN", "-0.0", "0")


def test_cumulative_to_buckets_saturates(spark):
    assert spark.range(1).select(cumulative_to_buckets(F.array(*[F.lit(x) for x in (1, 3, 2)]))).first()[0] == [1, 2, 0]


def test_prometheus_histogram_of_a_series(spark):
    o = obs(spark, [("h", "observe", {"endpoint": "ep1"}, 50), ("h", "observe", {"endpoint": "ep1"}, 150)])
    series = aggregate.histogram(o, (100,), ["labels"])
    assert lines(exposition.prometheus_histogram(series, "h", (100,), "help", "labels")) == [
        "# HELP h help", "# TYPE h histogram", 'h_bucket{endpoint="ep1",le="100"} 1', 'h_bucket{endpoint="ep1",le="+Inf"} 2', 'h_sum{endpoint="ep1"} 200', 'h_count{endpoint="ep1"} 2',
    ]


def test_empty_dynamic_metric(spark):
    series = aggregate.counter_sum(obs(spark, []), ["labels"])
    assert lines(exposition.prometheus_counter(series, "c", help_="h", labels="labels")) == ["# HELP c h", "# TYPE c counter"]
    assert otel.metric_json(series, "sum", "c", 1, labels="labels").count() == 0
    assert otel.sum_rows(series, R, "c", labels="labels").count() == 0


def test_lines_without_labels(spark):
    series = aggregate.counter_sum(obs(spark, [("c", "add", {}, 1)]), ["labels"])
    assert lines(exposition.prometheus_counter(series, "c", labels="labels"))[-1] == "c{} 1"
    assert lines(exposition.dogstatsd_counter(series, "c", labels="labels")) == ["c:1|c|#"]
    plain = aggregate.counter_sum(obs(spark, [("c", "add", {}, 100)]))
    assert lines(exposition.dogstatsd_counter(plain, "test.counter", tags={"env": "prod", "host": "web01"})) == ["test.counter:100|c|#env:prod,host:web01"]
    assert lines(exposition.prometheus_counter(plain, "c"))[-1] == "c 100"


def test_dogstatsd_distribution(spark):
    def of(values):
        e = aggregate.exponential_histogram(obs(spark, [("d", "observe", {}, v) for v in values]))
        return lines(exposition.dogstatsd_distribution(aggregate.exponential_samples(e), "latency"))

    assert of([100, 200, 300]) == ["latency:96|d", "latency:192|d", "latency:384|d"]
    assert of([100, 100, 100]) == ["latency:96|d|@0.3333333333333333"]
    assert of([0, 1]) == ["latency:0|d", "latency:1|d"]


def test_rates_of_many_samples_as_sql_has_them(spark):
    """Rates below 1e-4, and doubles that the JVM before 19 writes with other digits."""
    counts = [1, 2, 10_000, 10_001, 15_654, 1_471_200, *range(3_000_001, 3_004_000)]
    samples = spark.createDataFrame([(i, 12, n) for i, n in enumerate(counts)], "pos int, midpoint bigint, n bigint")
    want = duckdb.execute("SELECT 's:12|d' || CASE WHEN n > 1 THEN '|@' || (1.0::DOUBLE / n)::VARCHAR ELSE '' END FROM (SELECT unnest(?) AS n)", [counts]).fetchall()
    assert lines(exposition.dogstatsd_distribution(samples, "s", rate_text=sql_float_text)) == [w for (w,) in want]


def test_a_metric_of_many_series_is_cut_over_documents(spark, monkeypatch):
    monkeypatch.setattr(otel, "POINTS", 10)
    series = aggregate.counter_sum(obs(spark, [("c", "add", {"id": str(i)}, i) for i in range(100)]), ["labels"])
    docs = [json.loads(r.json)["sum"]["dataPoints"] for r in otel.metric_json(series, "sum", "c", 1, labels="labels").collect()]
    assert 5 <= len(docs) <= 10 and max(map(len, docs)) < 40
    assert sorted(int(p["asInt"]) for d in docs for p in d) == list(range(100))


def test_datagrams(spark):
    texts = [f"line{i:03d}" for i in range(50)] + ["x" * 200]
    packed = exposition.pack_datagrams(spark.createDataFrame([(t,) for t in texts], "line string").coalesce(1), 64).collect()
    assert all(len(r.payload.encode()) <= 64 and r.payload.endswith("\n") for r in packed)
    assert "".join(r.payload for r in sorted(packed, key=lambda r: r.datagram)) == "".join(t + "\n" for t in texts[:-1])


def test_otlp_histograms(spark):
    series = aggregate.histogram(obs(spark, [("h", "observe", {}, v) for v in (5, 50, 500)]), (10, 100))
    m = json.loads(otel.metric_json(series, "histogram", "h", 1_000_000_000, bounds=(10, 100)).first().json)
    p = m["histogram"]["dataPoints"][0]
    assert (p["bucketCounts"], p["explicitBounds"], p["sum"], p["timeUnixNano"]) == (["1", "1", "1"], [10.0, 100.0], 555.0, "1000000000")
    e = aggregate.exponential_stats(aggregate.exponential_histogram(obs(spark, [("d", "observe", {}, v) for v in (100, 200, 300)])))
    p = json.loads(otel.metric_json(e, "exponential", "d", 1).first().json)["exponentialHistogram"]["dataPoints"][0]
    assert (p["count"], p["sum"], p["scale"], p["zeroCount"], p["positive"]) == ("3", 600.0, 0, "0", {"offset": 6, "bucketCounts": ["1", "1", "1"]})


def test_rows_from_otlp(spark):
    def attr(k, v):
        return [{"key": k, "value": {"stringValue": v}}]

    metrics = [
        {"name": "requests_total", "sum": {"isMonotonic": True, "aggregationTemporality": 2, "dataPoints": [{"attributes": attr("route", "/api"), "asInt": "42", "timeUnixNano": "7"}]}},
        {"name": "cpu_usage", "gauge": {"dataPoints": [{"attributes": [*attr("host", "x"), *attr("host", "node1"), {"key": "n", "value": {"intValue": "3"}}, {"key": "a", "value": {"arrayValue": {}}}], "asDouble": 0.75}]}},
        {"name": "request_latency", "histogram": {"dataPoints": [{"attributes": attr("endpoint", "/api"), "count": "5", "sum": 123.0, "bucketCounts": ["1", "2", "2"], "explicitBounds": [10, 100]}]}},
        {"name": "response_size", "exponentialHistogram": {"dataPoints": [{"attributes": attr("method", "GET"), "count": "3", "sum": 600.0, "scale": 0, "zeroCount": "0", "positive": {"offset": 6, "bucketCounts": ["1", "1", "1"]}, "negative": {"offset": -2, "bucketCounts": ["2", "1"]}, "min": -32, "max": 256}]}},
        {"name": "ignored", "summary": {"dataPoints": [{}]}},
    ]
    t = otel.rows_from_otlp(spark.createDataFrame([(json.dumps(m),) for m in metrics], "json string"), R)
    assert {r.table: r.n for r in otel.total_rows(t).collect()} == dict.fromkeys(t, 1)
    s = t[otel.SUM].first()
    assert (s.MetricName, s.Value, s.Attributes, s.IsMonotonic, s.TimeUnixNano, s.ServiceName) == ("requests_total", 42.0, {"route": "/api"}, True, 7, "svc")
    assert t[otel.GAUGE].first().Attributes == {"host": "node1", "n": "3"} and t[otel.GAUGE].first().Value == 0.75
    h = t[otel.HISTOGRAM].first()
    assert (h.Count, h.Sum, h.BucketCounts, h.ExplicitBounds) == (5, 123.0, [1, 2, 2], [10.0, 100.0])
    e = t[otel.EXP_HISTOGRAM].first()
    assert (e.PositiveOffset, e.PositiveBucketCounts, e.NegativeOffset, e.NegativeBucketCounts, e.Min, e.Max) == (6, [1, 1, 1], -2, [2, 1], -32.0, 256.0)


def test_identifiers():
    assert otel.qualified_table("a`b", "t") == "`a``b`.`t`"


METHODS = LabelDomain("method", ("get", "post", "put"))
SPECS = [
    MetricSpec("hits", "counter", "Hits", domain=METHODS),
    MetricSpec("depth", "gauge", domain=METHODS),
    MetricSpec("size", "histogram", bounds=(100, 1000), domain=METHODS),
    MetricSpec("temp", "gauge_f64"),
    MetricSpec("peak", "max_gauge"),
    MetricSpec("low", "min_gauge_f64"),
    MetricSpec("conns", "gauge_i64", dynamic=True),
    MetricSpec("lat", "distribution", dynamic=True, max_series=1),
    MetricSpec("call", "timer", bounds=(10,), stride=1),
]


def stream(spark):
    get, post = {"method": "get"}, {"method": "post"}
    rows = [("hits", "add", get, 1), ("hits", "add", get, 1), ("hits", "add", post, 5), ("depth", "set", get, 10), ("depth", "set", post, 20), ("depth", "set", get, 15)]
    rows += [("size", "observe", get, v) for v in (50, 500, 5000)] + [("size", "observe", post, 200)]
    rows += [("temp", "set", {}, 44331.8), ("temp", "set", {}, -273.15), ("peak", "observe", {}, 3), ("peak", "observe", {}, 7), ("low", "observe", {}, 3.25)]
    rows += [("conns", "set", {"a": "1"}, 10), ("conns", "add", {"a": "1"}, 3), ("lat", "observe", {"e": "1"}, 100), ("lat", "observe", {"e": "2"}, 0), ("call", "elapsed", {}, 7), ("call", "elapsed", {}, 20)]
    return obs(spark, rows)


def in_order(df):
    return [r.line for r in df.orderBy("metric_order", F.col("series").asc_nulls_first(), "pos").collect()]


def test_metric_set_prometheus(spark):
    got = in_order(MetricSet(SPECS, "app").export_prometheus(stream(spark)))
    want = """# HELP app_hits Hits|# TYPE app_hits counter|app_hits{method="get"} 2|app_hits{method="post"} 5|app_hits{method="put"} 0
# HELP app_depth depth|# TYPE app_depth gauge|app_depth{method="get"} 15|app_depth{method="post"} 20|app_depth{method="put"} 0"""
    assert got[:10] == want.replace("\n", "|").split("|")
    assert 'app_size_bucket{method="get",le="100"} 1' in got and 'app_size_count{method="put"} 0' in got and 'app_size_sum{method="get"} 5550' in got
    assert "app_temp -273.15" in got and "app_peak 7" in got and "app_low 3.25" in got and 'app_conns{a="1"} 13' in got
    assert 'app_lat_sum{e="1"} 100' in got and 'app_lat_count{__ft_overflow="true"} 1' in got
    assert "app_call_calls 2" in got and "# HELP app_call_samples call sampled latency in nanoseconds" in got
    assert got[-4:] == ['app_call_samples_bucket{le="10"} 1', 'app_call_samples_bucket{le="+Inf"} 2', "app_call_samples_sum 27", "app_call_samples_count 2"]


def test_metric_set_dogstatsd(spark):
    got = in_order(MetricSet(SPECS, "app").export_dogstatsd(stream(spark), {"env": "x"}))
    for line in ("app.hits:2|c|#method:get,env:x", "app.size.count:3|c|#method:get,env:x", "app.temp:-273.15|g|#env:x", "app.conns:13|g|#a:1,env:x", "app.lat:96|d|#e:1,env:x", "app.lat:0|d|#__ft_overflow:true,env:x", "app.call.calls:2|c|#env:x", "app.call.samples.sum:27|c|#env:x"):
        assert line in got


def test_metric_set_delta_has_zero_lines(spark):
    o = obs(spark, [("c", "add", {"k": "1"}, 5), ("c", "add", {"k": "2"}, 1), ("c", "add", {"k": "1"}, 3)]).withColumn("w", F.element_at(F.array(F.lit(1), F.lit(1), F.lit(3)), (F.col("seq") + 1).cast("int")).cast("bigint"))
    got = MetricSet([MetricSpec("c", "counter", dynamic=True)]).export_dogstatsd_delta(o, "w").collect()
    assert sorted((r.w, r.line) for r in got) == [(1, "c:1|c|#k:2"), (1, "c:5|c|#k:1"), (2, "c:0|c|#k:1"), (2, "c:0|c|#k:2"), (3, "c:0|c|#k:2"), (3, "c:3|c|#k:1")]


def test_metric_set_delta_of_a_domain(spark):
    o = obs(spark, [("hits", "add", {"method": "get"}, 5), ("hits", "add", {"method": "put"}, 1)]).withColumn("w", F.col("seq") + 1)
    got = MetricSet(SPECS[:1]).export_dogstatsd_delta(o, "w").collect()
    assert sorted((r.w, r.line) for r in got) == [(1, "hits:0|c|#method:post"), (1, "hits:0|c|#method:put"), (1, "hits:5|c|#method:get"), (2, "hits:0|c|#method:get"), (2, "hits:0|c|#method:post"), (2, "hits:1|c|#method:put")]


def test_metric_set_tables_and_otlp(spark):
    m = MetricSet(SPECS, "app")
    tables = m.export_clickhouse(stream(spark), R)
    assert {r.table: r.n for r in otel.total_rows(tables).collect()} == {otel.SUM: 4, otel.GAUGE: 7, otel.HISTOGRAM: 4, otel.EXP_HISTOGRAM: 2}
    names = {json.loads(r.json)["name"] for r in m.export_otlp(stream(spark), R).collect()}
    assert names == {"app_hits", "app_depth", "app_size", "app_temp", "app_peak", "app_low", "app_conns", "app_lat", "app_call.calls", "app_call.samples"}
    request = json.loads(otel.export_request(m.export_otlp(stream(spark), R), R).first().json)
    assert len(request["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]) == 10
    assert m.overflow_warnings(stream(spark)).collect()[0].metric == "lat"


def test_metric_set_reads_observations_once(spark):
    """Every row passes once, whatever the number of metrics and exports."""
    seen, m = spark.sparkContext.accumulator(0), MetricSet(SPECS, "app")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    o = stream(spark)
    n, counted = o.count(), o.mapInArrow(count, o.schema)
    m.export_prometheus(counted).collect()
    assert seen.value == n
    m.export_dogstatsd(counted).collect()
    {t: rows.count() for t, rows in m.export_clickhouse(counted, R).items()}
    assert seen.value == n
    m.release()


def test_timers_of_a_producer_are_one_sequence(spark):
    """Two timers called in turn at stride 2: all samples are of one; a timer outside the set counts, too."""
    calls = [(t, "elapsed", {}, 5) for _ in range(8) for t in ("a", "b")]
    both = MetricSet([MetricSpec("a", "timer", stride=2), MetricSpec("b", "timer", stride=2)])
    assert [s.sample_count for s in (both.series(obs(spark, calls), spec).first() for spec in both.specs)] == [0, 8]
    alone = MetricSet([MetricSpec("b", "timer", stride=2)])
    got = alone.series(obs(spark, calls), alone.specs[0]).first()
    assert (got.calls, got.sample_count, got.sample_sum) == (8, 8, 40)


def test_requests_of_bounded_size(spark):
    """A metric of many series and small ones beside it: every point once, no request above the limit."""
    rows = [("many", "add", {"id": str(i), "text": "é" * (i % 40)}, i) for i in range(3000)] + [("few", "add", {"k": "v"}, 7), ("level", "set", {}, 3)]
    m = MetricSet([MetricSpec("many", "counter", dynamic=True, max_series=0), MetricSpec("few", "counter", dynamic=True), MetricSpec("level", "gauge")])
    got = m.export_otlp_requests(obs(spark, rows), R, 20_000).collect()
    assert max(len(r.json.encode()) for r in got) <= 20_000 and 20 < len(got) < 90
    seen = []
    for r in got:
        metrics = json.loads(r.json)["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]
        points = [(x["name"], next((a["value"]["stringValue"] for a in p["attributes"] if a["key"] == "id"), None), p["asInt"]) for x in metrics for p in (x.get("sum") or x["gauge"])["dataPoints"]]
        assert len(points) == r.n_points
        seen += points
    assert sorted(seen, key=str) == sorted([*(("many", str(i), str(i)) for i in range(3000)), ("few", None, "7"), ("level", None, "3")], key=str)
    with pytest.raises(ValueError):
        m.export_otlp_requests(obs(spark, rows), R, 300)
    m.release()


def test_own_projection(spark):
    m = MetricSet(SPECS, "app")
    m.register("max_gauge", lambda s, spec, name: s.select(F.concat(F.lit(name + "="), F.col("value").cast("string")).alias("line")))
    assert [r.line for r in m.project(stream(spark)).collect()] == ["app_peak=7"]
