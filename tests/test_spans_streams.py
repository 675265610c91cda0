"""Spans, streams and sinks."""

import json
import os
import random
import socket
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import trace_ids
from seriesmill.operators import aggregate, otel, run_stats, spans, temporality
from seriesmill.sources import observations as source
from seriesmill.sources.rounds import kept
from seriesmill.streaming import sinks, state, windows

TRACE, SPAN = "4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7"


@pytest.mark.parametrize(
    "header, good",
    [(f"00-{TRACE}-{SPAN}-01", True), (f"00-{TRACE.upper()}-{SPAN}-00-more", True), (f"01-{TRACE}-{SPAN}-01", False), (f"00x{TRACE}-{SPAN}-01", False), (f"00-{'0' * 32}-{SPAN}-01", False), (f"00-{TRACE}-{'0' * 16}-01", False), (f"00-{TRACE}-{SPAN}", False), ("", False), (None, False)],
)
def test_traceparent(spark, header, good):
    df = spark.createDataFrame([(header,)], "h string").select(trace_ids.parse_traceparent(F.col("h")).alias("p"))
    df = df.select("p", trace_ids.to_traceparent(F.col("p.trace_id"), F.col("p.span_id")).alias("back"))
    row = df.first()
    assert row.back == (f"00-{TRACE}-{SPAN}-01" if good else "")


def test_ids(spark):
    row = spark.range(1).select(trace_ids.parse_id(F.lit("ABCDEF0123456789"), 16), trace_ids.parse_id(F.lit("xyz"), 16), trace_ids.random_trace_id(), trace_ids.random_span_id()).first()
    assert row[0] == "abcdef0123456789" and row[1] is None and len(row[2]) == 32 and len(row[3]) == 16


def tree(spark):
    rows = spark.createDataFrame([(1, None), (2, f"00-{TRACE}-{SPAN}-00"), (3, "bad")], "id int, header string")
    roots = spans.root_spans(rows, ["id"], F.lit("root"), F.lit(10), F.lit(30), "server", F.col("header"))
    children = spans.child_spans(spark.createDataFrame([(1, 1), (1, 2), (9, 1)], "id int, n int"), roots, "id", ["id", "n"], F.lit("child"), F.lit(12), F.lit(20), "client")
    return roots, children


def test_roots_and_children(spark):
    roots, children = tree(spark)
    r = {x.id: x for x in roots.collect()}
    assert r[2].trace_id == TRACE and r[2].parent_span_id == SPAN and r[1].parent_span_id is None and r[3].parent_span_id is None
    kids = children.collect()
    assert len(kids) == 2 and all(k.trace_id == r[1].trace_id and k.parent_span_id == r[1].span_id for k in kids)
    columns = ["trace_id", "span_id", "parent_span_id", "name"]
    depths = spans.tree_depths(roots.select(*columns).unionByName(children.select(*columns))).groupBy("depth").count().collect()
    assert {d.depth: d["count"] for d in depths} == {0: 3, 1: 2}
    assert spans.edges(roots.select(*columns).unionByName(children.select(*columns))).count() == 2


def test_deep_tree(spark):
    n = 20
    chain = spark.createDataFrame([("t", str(i), str(i - 1) if i else None) for i in range(n)], "trace_id string, span_id string, parent_span_id string")
    got = {r.span_id: (r.depth, r.root_span_id) for r in spans.tree_depths(chain).collect()}
    assert got == {str(i): (i, "0") for i in range(n)}


def test_two_levels_take_one_round(spark, monkeypatch):
    """Roots, children and orphans are settled by one join; ids that are no hexadecimal, or look alike in it, stay apart."""
    rounds = []
    monkeypatch.setattr(spans, "kept", lambda df, name: rounds.append(name) or kept(df, name))
    ids = [("6162", "ff", None), ("6162", "FF", "ff"), ("ab", "ff", "FF"), ("ab", "x", None), ("ab", "f", "x"), ("ab", "0f", "x")]
    df = spark.createDataFrame(ids, "trace_id string, span_id string, parent_span_id string")
    got = {(r.trace_id, r.span_id): (r.depth, r.root_span_id) for r in spans.tree_depths(df).collect()}
    assert got == {("6162", "ff"): (0, "ff"), ("6162", "FF"): (1, "ff"), ("ab", "ff"): (0, "ff"), ("ab", "x"): (0, "x"), ("ab", "f"): (1, "x"), ("ab", "0f"): (1, "x")}
    assert len(rounds) == 1


def test_depths_of_random_forests_with_cycles(spark):
    """A chain of a thousand, cycles with branches, orphans and a span that is its own parent."""
    rng = random.Random(1)
    parents = {("chain", f"c{i}"): f"c{i - 1}" if i else None for i in range(1000)}
    for trace in range(6):
        ids = [f"s{i}" for i in range(150)]
        parents |= {(f"t{trace}", s): rng.choice([None, "gone", *rng.choices(ids, k=10)]) for s in ids}
    parents["self", "x"] = "x"
    want = {}
    for trace, span in parents:
        seen, at = [span], span
        while (up := parents[trace, at]) and (trace, up) in parents and up not in seen:
            seen.append(at := up)
        cyclic = up in seen
        want[trace, span] = (None, None) if cyclic else (len(seen) - 1, at)
    df = spark.createDataFrame([(t, s, p) for (t, s), p in parents.items()], "trace_id string, span_id string, parent_span_id string").repartition(4)
    assert {(r.trace_id, r.span_id): (r.depth, r.root_span_id) for r in spans.tree_depths(df).collect()} == want
    assert spans.tree_depths(df.limit(0)).collect() == []


def test_current_span_of_any_length(spark):
    rng = random.Random(2)
    made = [(rng.choice("pq"), "t", f"s{i}", (a := rng.randint(-500, 1 << 40)), a + rng.choice([0, 1, 7, 1 << 20, 1 << 38, (1 << 40) - 1])) for i in range(120)]
    at = [(rng.choice("pqr"), t) for t in [*(rng.randint(-600, 1 << 41) for _ in range(200)), *(m[3] for m in made), *(m[4] for m in made)]]
    s = spark.createDataFrame(made, "producer string, trace_id string, span_id string, start_unix_nano bigint, end_unix_nano bigint")
    logs = spark.createDataFrame([(i, *a) for i, a in enumerate(at)], "i int, producer string, time_unix_nano bigint")
    want = {i: max(((m[3], m[2]) for m in made if m[0] == p and m[3] <= t <= m[4]), default=(None, None))[1] for i, (p, t) in enumerate(at)}
    assert {r.i: r.span_id for r in spans.current_spans(logs, s).collect()} == want
    assert spans.current_spans(logs, s.limit(0)).where("span_id is not null").count() == 0


def test_attributes_events_and_otlp(spark):
    roots, _ = tree(spark)
    s = roots.where("id = 1").withColumn("attributes", spans.set_attribute(F.col("attributes"), "k", F.lit("a"), "string"))
    s = s.withColumn("attributes", spans.set_attribute(F.col("attributes"), "k", F.lit(7), "int"))
    s = s.withColumn("events", spans.add_event(F.col("events"), F.lit("e"), F.lit(15))).withColumn("status", spans.status("error", F.lit("boom")))
    got = json.loads(spans.to_otlp(s).first().json)
    assert [a["value"] for a in got["attributes"]] == [{"stringValue": "a"}, {"intValue": "7"}]
    assert got["parentSpanId"] == "" and got["kind"] == 2 and got["status"] == {"code": 2, "message": "boom"} and got["events"][0]["name"] == "e"
    assert "status" not in json.loads(spans.to_otlp(roots.where("id = 1")).first().json)
    assert spans.duration(s).first().duration_nanos == 20
    requests = spans.trace_requests(spans.to_otlp(roots), "svc", batch=2).collect()
    assert sum(r.n for r in requests) == 3 and all(r.n <= 2 and json.loads(r.json) for r in requests)


def test_sampled_out_roots_have_no_children(spark):
    roots, children = tree(spark)
    columns = ["trace_id", "span_id", "parent_span_id", "recorded"]
    marked = roots.withColumn("recorded", F.col("id") != 1).select(*columns).unionByName(children.withColumn("recorded", F.lit(True)).select(*columns))
    assert spans.keep_recorded(marked).count() == 2
    c = spans.counters(roots.where("id <> 2").withColumn("recorded", F.col("id") != 1)).first()
    assert (c.recorded_count, c.sampled_out_count, c.dropped_count) == (1, 1, 0)


def test_current_span_is_the_innermost(spark):
    s = spark.createDataFrame([("p", "t", "outer", 0, 10_000_000_000), ("p", "t", "inner", 2_000_000_000, 3_000_000_000)], "producer string, trace_id string, span_id string, start_unix_nano bigint, end_unix_nano bigint")
    logs = spark.createDataFrame([("p", 2_500_000_000), ("p", 5_000_000_000), ("q", 5_000_000_000)], "producer string, time_unix_nano bigint")
    assert sorted((r.producer, r.time_unix_nano, r.span_id) for r in spans.current_spans(logs, s).collect() if r.span_id) == [("p", 2_500_000_000, "inner"), ("p", 5_000_000_000, "outer")]
    assert spans.current_spans(logs, s).count() == 3


def rows(spark):
    start = datetime(2024, 1, 1)
    data = [("m", "add", {"u": str(i % 3)}, i, float(i), start + timedelta(hours=i), None, i, "p") for i in range(60)]
    return spark.createDataFrame(data, source.OBSERVATION)


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_files(spark, tmp_path, format):
    source.write(rows(spark), str(tmp_path / "o"), format)
    back = source.read(spark, str(tmp_path / "o"), format)
    assert back.count() == 60 and {tuple(sorted(r.labels.items())) for r in back.collect()} == {(("u", str(i)),) for i in range(3)}


def collected(stream, tmp_path, mode):
    out = []
    q = sinks.start(stream, lambda df, epoch: out.extend(df.collect()), str(tmp_path / "ckpt"), mode=mode)
    q.awaitTermination(120)
    assert q.exception() is None
    return out


def test_stream_windows_equal_batch(spark, tmp_path):
    rows(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = source.read_stream(spark, str(tmp_path / "in"), max_files=1)
    got = collected(windows.counters(stream, "1 day", "30 days"), tmp_path, "update")
    last = {}
    for r in got:
        key = (r.window_start, str(r.series))
        last[key] = max(last.get(key, 0), r["sum"])
    want = {(r.window_start, str(r.series)): r["sum"] for r in windows.counters(rows(spark), "1 day", "1 day").collect()}
    assert last == want
    assert windows.histograms(rows(spark), (10,), "1 day", "1 day").count() == 9 and windows.exponential(rows(spark), "1 day", "1 day").count() > 0
    assert windows.gauges(rows(spark), "1 day", "1 day").count() == 9 and windows.extrema(rows(spark), "1 day", "1 day").count() == 9


def test_stream_running_totals(spark, tmp_path):
    rows(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    got = collected(state.running_totals(source.read_stream(spark, str(tmp_path / "in"), max_files=1)), tmp_path, "update")
    assert sum(r.delta for r in got) == sum(range(60))
    assert sorted(max(r.total for r in got if r.series == s) for s in {r.series for r in got}) == sorted(sum(range(k, 60, 3)) for k in range(3))


def test_stream_cap_and_evict(spark, tmp_path):
    rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = source.read_stream(spark, str(tmp_path / "in"))
    got = collected(state.cap_and_evict(stream, max_series=2, max_staleness=1000, sweep_seconds=3600), tmp_path, "append")
    assert len(got) == 60 and sum(r.redirected for r in got) == 20 and sum(r.value_l for r in got) == sum(range(60))


def in_turn(spark, batches, schema, path):
    """A file for each batch, read one after the other."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        for f in Path(path).glob("part-*"):
            if f.stat().st_mtime > 1e9 + 1000:
                os.utime(f, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def progress(stream, tmp_path):
    """All rows of a stream, and the state rows after each micro-batch."""
    out = []
    q = sinks.start(stream, lambda df, epoch: out.extend(df.collect()), str(tmp_path / "ckpt"), mode="append")
    q.awaitTermination(240)
    assert q.exception() is None
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_stream_deltas_equal_batch(spark, tmp_path):
    """Counters, histograms, timers and distributions with falls, gaps and series that vanish; state goes with them."""
    rng, start = random.Random(5), datetime(2024, 1, 1)
    schema = "metric string, labels map<string,string>, kind string, ts timestamp, totals array<bigint>"
    batches, totals = [], {}
    for step in range(12):
        batch = []
        for k in range(10):
            if rng.random() < 0.8 and (k < 6 or step < 3):  # the last four are not exported after the third step
                kind = ("counter", "histogram", "timer", "distribution")[k % 4]
                now = [max(0, t + rng.choice([0, 0, 3, -2])) for t in totals.get(k, [5, 0, 2])]
                totals[k] = now
                batch.append((f"m{k % 4}", {"u": str(k)}, kind, start + timedelta(minutes=step), now))
        batches.append(batch)
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    batch = temporality.array_deltas(state.series_text(everything), ttl_seconds=120)
    want = sorted((r.metric, r.series, r.kind, r.ts, r.deltas) for r in batch.collect())
    got, held = progress(state.deltas(in_turn(spark, batches, schema, str(tmp_path / "in")), "1 second", 120), tmp_path)
    assert sorted((r.metric, r.series, r.kind, r.ts, r.deltas) for r in got) == want
    assert max(held) > 6 and held[-1] < max(held)


def test_idle_metric_is_swept_by_the_watermark(spark, tmp_path):
    """Series of a metric without further rows are evicted, and nothing is kept of them."""
    start = datetime(2024, 1, 1)
    row = lambda metric, series, minute, seq: (metric, "add", {"u": series}, 1, 1.0, start + timedelta(minutes=minute), None, seq, "p")
    batches = [[row("idle", f"s{i}", 0, i) for i in range(5)] + [row("busy", f"b{0}-{i}", 0, 10 + i) for i in range(3)]]
    batches += [[row("busy", f"b{m}-{i}", m, 100 * m + i) for i in range(3)] for m in range(1, 12)]
    stream = in_turn(spark, batches, source.OBSERVATION, str(tmp_path / "in"))
    got, held = progress(state.cap_and_evict(stream, max_series=100, max_staleness=2, sweep_seconds=60, watermark="1 second"), tmp_path)
    swept = [r for r in got if r.series is None]
    assert [(r.metric, r.evicted) for r in swept if r.metric == "idle"] == [("idle", 5)]
    assert sum(r.series is not None for r in got) == 5 + 3 * 12
    # New series in every batch: what is kept are those of the last cycles.
    assert max(held) <= 5 + 3 * 5 and held[-1] <= 3 * 5


def test_table_sink_and_retention(spark, tmp_path):
    series = aggregate.counter_sum(rows(spark), ["labels"])
    batch = {otel.SUM: otel.sum_rows(series, otel.Resource("s", 1_704_067_200_000_000_000), "m", labels="labels")}
    config = sinks.TableConfig(str(tmp_path / "t"))
    for _ in range(2):  # the same batch again leaves its rows once
        sinks.write_tables(batch, config, epoch=1)
    table = spark.read.parquet(str(tmp_path / "t" / otel.SUM))
    assert table.count() == 3 and str(table.first().date) == "2024-01-01"
    assert sinks.expired(table, "2024-03-01").count() == 1 and sinks.expired(table, "2024-01-15").count() == 0


def test_ddl_is_valid(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS otel_ddl")
    for name, ddl in sinks.table_ddl("otel_ddl").items():
        spark.sql(ddl)
        spark.sql(f"DROP TABLE otel_ddl.{name}")
    spark.sql("DROP DATABASE otel_ddl")


def test_datagrams_are_sent(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(20)
        sinks.send_datagrams(spark.createDataFrame([("a:1|c",), ("b:2|c",)], "line string").coalesce(1), sinks.DogStatsDConfig(port=s.getsockname()[1]))
        assert s.recv(9000) == b"a:1|c\nb:2|c\n"


def test_backoff_and_bodies():
    assert [sinks.backoff_seconds(n, 0.0) for n in (1, 2, 10)] == [10.0, 20.0, 300.0]
    assert [sinks.backoff_seconds(n, 0.5, False, True) for n in (1, 2)] == [5.0, 10.0]
    assert sinks.backoff_seconds(10, 1.0) == 375.0
    assert "Content-Encoding" in sinks.http_body("x" * 1024)[1] and "Content-Encoding" not in sinks.http_body("x" * 1023)[1]
    tries = []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert sinks.retrying(fails, sleep=lambda s: None) == "done" and len(tries) == 3


def test_run_statistics(spark):
    runs = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0)], "mode string, v double")
    got = {r.mode: r for r in run_stats.summarize(runs, ["mode"], "v").collect()}
    assert got["a"].trimmed_mean == 3.0 and got["b"].trimmed_mean == 5.0 and got["b"].cv_pct == 0.0 and got["a"].runs == 5
    kv = run_stats.parse_runs(spark.createDataFrame([("elapsed=12",), ("noise",)], "value string")).collect()
    assert [(r.key, r.value) for r in kv] == [("elapsed", "12")]
    lines = ["     1,000      cpu_core/cycles/u        #    3.2 GHz   (83.1%)", "   500   instructions:u", " 1.000  cycles", "  12.5 msec task-clock   # 0.9 CPUs", "  <not counted>  branches", "x", "", "  7,5a  cache-misses"]
    perf = run_stats.parse_perf(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.event: r.total for r in perf.collect()} == {"cycles": 1001.0, "instructions": 500.0, "task-clock": 12.5}
    rates = run_stats.event_rates(perf).first()
    assert rates.instructions_per_cycle == 500 / 1001 and rates.cache_misses_pct == rates.branch_misses_pct == 0.0


@pytest.mark.parametrize("profile", ["uniform", "hotspot", "churn"])
def test_access_profiles(spark, profile):
    def label(i, t, n=10):
        return {"uniform": (i + t) % n, "hotspot": (i + t) % n if i % 16 == 0 else (i + t) % min(8, n), "churn": (17 * i + 131 * t) % n}[profile]

    got = source.access_profile(spark, profile, 40, 10, 2).collect()
    assert len(got) == 80 and all(r.label == label(r.i, r.thread) for r in got)
