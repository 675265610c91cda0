"""OTLP in Protocol Buffers, read back by the protobuf library from the published schema's field numbers."""

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import protobuf as pb
from seriesmill.operators import otel, otlp_proto, spans
from seriesmill.streaming import sinks
from seriesmill.plans.metric_set import MetricSet, MetricSpec

descriptor_pb2 = pytest.importorskip("google.protobuf.descriptor_pb2")

# Messages of the schema with (field, number, type, repeated); a type is a message's name or a scalar's.
SCHEMA = {
    "Any": [("string_value", 1, "string", 0)], "KeyValue": [("key", 1, "string", 0), ("value", 2, "Any", 0)], "Resource": [("attributes", 1, "KeyValue", 1)], "Scope": [("name", 1, "string", 0)],
    "Number": [("time", 3, "fixed64", 0), ("as_double", 4, "double", 0), ("as_int", 6, "sfixed64", 0), ("attributes", 7, "KeyValue", 1)],
    "Hist": [("time", 3, "fixed64", 0), ("count", 4, "fixed64", 0), ("sum", 5, "double", 0), ("bucket_counts", 6, "fixed64", 1), ("explicit_bounds", 7, "double", 1), ("attributes", 9, "KeyValue", 1)],
    "Buckets": [("offset", 1, "sint32", 0), ("bucket_counts", 2, "uint64", 1)],
    "Exp": [("attributes", 1, "KeyValue", 1), ("time", 3, "fixed64", 0), ("count", 4, "fixed64", 0), ("sum", 5, "double", 0), ("zero_count", 7, "fixed64", 0), ("positive", 8, "Buckets", 0), ("min", 12, "double", 0), ("max", 13, "double", 0)],
    "Gauge": [("points", 1, "Number", 1)], "Sum": [("points", 1, "Number", 1), ("temporality", 2, "uint64", 0), ("monotonic", 3, "bool", 0)], "Histogram": [("points", 1, "Hist", 1), ("temporality", 2, "uint64", 0)], "Exponential": [("points", 1, "Exp", 1), ("temporality", 2, "uint64", 0)],
    "Metric": [("name", 1, "string", 0), ("description", 2, "string", 0), ("gauge", 5, "Gauge", 0), ("sum", 7, "Sum", 0), ("histogram", 9, "Histogram", 0), ("exponential", 10, "Exponential", 0)],
    "AnyValue": [("string_value", 1, "string", 0), ("bool_value", 2, "bool", 0), ("int_value", 3, "int64", 0), ("double_value", 4, "double", 0)], "Pair": [("key", 1, "string", 0), ("value", 2, "AnyValue", 0)],
    "Event": [("time", 1, "fixed64", 0), ("name", 2, "string", 0), ("attributes", 3, "Pair", 1)], "Status": [("message", 2, "string", 0), ("code", 3, "uint64", 0)],
    "Span": [("trace_id", 1, "bytes", 0), ("span_id", 2, "bytes", 0), ("parent", 4, "bytes", 0), ("name", 5, "string", 0), ("kind", 6, "uint64", 0), ("start", 7, "fixed64", 0), ("end", 8, "fixed64", 0), ("attributes", 9, "Pair", 1), ("events", 11, "Event", 1), ("status", 15, "Status", 0)],
    "ScopeSpans": [("scope", 1, "Scope", 0), ("spans", 2, "Span", 1)], "ResourceSpans": [("resource", 1, "Resource", 0), ("scopes", 2, "ScopeSpans", 1)], "Traces": [("resources", 1, "ResourceSpans", 1)],
    "ScopeMetrics": [("scope", 1, "Scope", 0), ("metrics", 2, "Metric", 1)], "ResourceMetrics": [("resource", 1, "Resource", 0), ("scopes", 2, "ScopeMetrics", 1)], "Request": [("resources", 1, "ResourceMetrics", 1)],
}


@pytest.fixture(scope="module")
def classes():
    from google.protobuf import descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    for name, fields in SCHEMA.items():
        m = file.message_type.add(name=name)
        for field, number, kind, many in fields:
            f = m.field.add(name=field, number=number, label=kinds.LABEL_REPEATED if many else kinds.LABEL_OPTIONAL)
            if kind in SCHEMA:
                f.type, f.type_name = kinds.TYPE_MESSAGE, f".t.{kind}"
            else:
                f.type = getattr(kinds, f"TYPE_{kind.upper()}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return lambda name: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"t.{name}"))


def test_scalars(spark):
    """Bytes of numbers, by hand."""
    df = spark.createDataFrame([(0,), (1,), (127,), (128,), (300,), ((1 << 63) - 1,)], "v bigint").select("v", pb.varint(F.col("v")).alias("b"))
    want = {0: b"\0", 1: b"\1", 127: b"\x7f", 128: b"\x80\x01", 300: b"\xac\x02", (1 << 63) - 1: b"\xff" * 8 + b"\x7f"}
    assert {r.v: bytes(r.b) for r in df.collect()} == want
    one = spark.range(1).select(pb.fixed64(F.lit(-2)).alias("f"), pb.fixed64(pb.double_bits(F.lit(1.5))).alias("d"), pb.text(5, F.lit("é")).alias("t"), pb.zigzag(F.lit(-3)).alias("z"), pb.unsigned(3, F.lit(0)).alias("u")).first()
    assert (bytes(one.f), bytes(one.d), bytes(one.t), one.z, bytes(one.u)) == (b"\xfe" + b"\xff" * 7, bytes.fromhex("000000000000f83f"), b"\x2a\x02\xc3\xa9", 5, b"")


def test_requests_are_read_back(spark, classes):
    specs = [MetricSpec("hits", "counter", "Hits", dynamic=True, max_series=0), MetricSpec("temp", "gauge_f64"), MetricSpec("depth", "gauge"), MetricSpec("size", "histogram", bounds=(10, 100)), MetricSpec("lat", "distribution", dynamic=True), MetricSpec("call", "timer", bounds=(10,))]
    from test_text_otel import obs

    rows = [("hits", "add", {"id": str(i), "é": "日" * (i % 5)}, i - 5) for i in range(400)] + [("temp", "set", {}, -273.15), ("depth", "set", {}, -7)]
    rows += [("size", "record", {}, v) for v in (1, 50, 5000, 10)] + [("lat", "record", {"e": "x"}, v) for v in (0, 1, 5, 1000)] + [("call", "elapsed", {}, v) for v in (3, 30)]
    m = MetricSet(specs, "app")
    got = m.export_otlp_protobuf(obs(spark, rows), otel.Resource("svc", 1_700_000_000_000_000_001, attributes={"env": "t"}), 5000).collect()
    assert len(got) > 3 and max(len(r.body) for r in got) <= 5000
    read, n = {}, 0
    for r in got:
        request = classes("Request").FromString(bytes(r.body))
        assert {a.key: a.value.string_value for a in request.resources[0].resource.attributes} == {"service.name": "svc", "env": "t"} and request.resources[0].scopes[0].scope.name == "seriesmill"
        for metric in request.resources[0].scopes[0].metrics:
            data = next(getattr(metric, k) for k in ("gauge", "sum", "histogram", "exponential") if metric.HasField(k))
            n += len(data.points)
            read.setdefault(metric.name, []).extend(data.points)
            assert metric.HasField("gauge") or data.temporality == 2
    assert n == sum(r.n_points for r in got)
    assert {tuple(sorted((a.key, a.value.string_value) for a in p.attributes)): p.as_int for p in read["app_hits"]} == {(("id", str(i)), ("é", "日" * (i % 5))): i - 5 for i in range(400)}
    assert all(p.time == 1_700_000_000_000_000_001 for ps in read.values() for p in ps)
    assert [p.as_double for p in read["app_temp"]] == [-273.15] and [p.as_int for p in read["app_depth"]] == [-7]
    h, e = read["app_size"][0], read["app_lat"][0]
    assert (h.count, h.sum, list(h.bucket_counts), list(h.explicit_bounds)) == (4, 5061.0, [2, 1, 1], [10.0, 100.0])
    assert (e.count, e.sum, e.zero_count, e.positive.offset, list(e.positive.bucket_counts), e.min, e.max) == (4, 1006.0, 1, 0, [1, 0, 1, 0, 0, 0, 0, 0, 0, 1], 0.0, 1023.0)
    assert read["app_call.calls"][0].as_int == 2 and list(read["app_call.samples"][0].bucket_counts) == [1, 1]
    m.release()


def test_spans_are_read_back_and_posted(spark, classes):
    """Every kind of value, events and states; bodies reach a server whole, compressed where they are long."""
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    base = spark.range(30).withColumn("k", F.col("id").cast("string"))
    rows = spans.root_spans(base, ["k"], F.concat(F.lit("n"), "k"), F.col("id") + 5, F.col("id") + 9, "server")
    attributes = F.col("attributes")
    for key, value, kind in (("s", F.lit("é"), "string"), ("i", -F.col("id"), "int"), ("d", F.lit(0.5), "double"), ("b", F.col("id") % 2 == 0, "bool")):
        attributes = spans.set_attribute(attributes, key, value, kind)
    rows = rows.withColumn("attributes", attributes).withColumn("events", spans.add_event(F.col("events"), F.lit("e"), F.lit(15))).withColumn("status", spans.status("error", F.lit("boom")))
    requests = otlp_proto.span_requests(rows, otel.Resource("svc", 1), batch=12)
    assert sorted(r.n for r in requests.collect()) == [6, 12, 12]
    bodies = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            raw = self.rfile.read(int(self.headers["Content-Length"]))
            bodies.append(gzip.decompress(raw) if self.headers["Content-Encoding"] == "gzip" else raw)
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        sinks.post_protobuf(requests, f"http://127.0.0.1:{server.server_port}/v1/traces", {})
    finally:
        server.shutdown()
    got = [s for b in bodies for s in classes("Traces").FromString(b).resources[0].scopes[0].spans]
    assert len(got) == 30 and len(bodies) == 3
    want = {bytes.fromhex(r.span_id): r for r in rows.collect()}
    for s in got:
        r = want[s.span_id]
        assert (s.trace_id.hex(), s.parent, s.name, s.kind, s.start, s.end) == (r.trace_id, b"", "n" + r.k, 2, r.id + 5, r.id + 9)
        assert [(a.key, getattr(a.value, a.value.ListFields()[0][0].name) if a.value.ListFields() else None) for a in s.attributes] == [("s", "é"), ("i", -r.id or None), ("d", 0.5), ("b", True if r.id % 2 == 0 else None)]
        assert (s.events[0].time, s.events[0].name, s.status.code, s.status.message) == (15, "e", 2, "boom")
