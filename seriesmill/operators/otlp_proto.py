"""Series and spans as OTLP in Protocol Buffers: the bodies of export requests, of bounded size.

Field numbers are those of the published OTLP schema (opentelemetry-proto 1.x).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import numbers
from seriesmill.functions import protobuf as pb
from seriesmill.functions.labels import series_key
from seriesmill.operators.otel import CUMULATIVE, REQUEST_BYTES, Resource
from seriesmill.operators.ranks import row_numbers, running_sums
from seriesmill.operators.spans import ATTRIBUTES, EVENTS, KINDS, STATUS_CODES

# The fields of a metric that hold its data, by kind.
GAUGE, SUM, HISTOGRAM, EXPONENTIAL = 5, 7, 9, 10
_FIELDS = {"gauge": GAUGE, "sum": SUM, "histogram": HISTOGRAM, "exponential": EXPONENTIAL}
#: Bytes of a tag and a length at most, around a message below 2 GB.
_FRAME = 7


def _key_value(key: Column, value: Column) -> Column:
    return F.concat(pb.text(1, key), pb.message(2, pb.message(1, value)))


def _attributes(field: int, labels: Column | None) -> Column:
    if labels is None:
        return pb.none()
    return pb.repeated(field, F.transform(series_key(labels), lambda e: _key_value(e["key"], e["value"])))


def _resource(resource: Resource) -> Column:
    pairs = F.array(*[_key_value(F.lit(k), F.lit(v)) for k, v in sorted(resource.all_attributes().items())])
    return pb.repeated(1, pairs)


def points(series: DataFrame, kind: str, name: str, time_unix_nano: int, value: str = "sum", bounds: Sequence[int] = (), description: str | None = None, labels: str | None = None) -> DataFrame:
    """``(name, head, field, point, tail)``: a series' point as a message, a row each, with what the metric has around it.

    ``kind``: sum, gauge, histogram or exponential (of ``aggregate.exponential_stats``), as in ``otel.metric_points``.
    """
    at, own = pb.fixed(3, F.lit(time_unix_nano)), F.col(labels) if labels else None
    if kind in ("sum", "gauge"):
        is_double = dict(series.dtypes)[value] in ("double", "float")
        number = pb.double(4, F.col(value)) if is_double else pb.oneof_fixed(6, F.col(value))
        point = F.concat(at, number, _attributes(7, own))
    elif kind == "histogram":
        explicit = F.array(*[F.lit(float(b)) for b in bounds])
        point = F.concat(at, pb.fixed(4, F.col("count")), pb.double(5, F.col("sum")), pb.packed(6, F.col("counts"), pb.fixed64), pb.packed(7, explicit, lambda d: pb.fixed64(pb.double_bits(d))), _attributes(9, own))
    else:
        c = numbers.compact_buckets(F.col("positive"))
        side = F.concat(pb.unsigned(1, pb.zigzag(c["offset"])), pb.packed(2, c["counts"], pb.varint))
        point = F.concat(_attributes(1, own), at, pb.fixed(4, F.col("count")), pb.double(5, F.col("sum")), pb.fixed(7, F.col("zero_count")), pb.message(8, side), pb.double(12, F.col("min")), pb.double(13, F.col("max")))
    tail = {"gauge": pb.none(), "sum": pb.unsigned(2, F.lit(CUMULATIVE))}.get(kind, pb.unsigned(2, F.lit(CUMULATIVE)))
    head = F.concat(pb.text(1, F.lit(name)), pb.text(2, F.lit(description or name)))
    return series.select(F.lit(name).alias("name"), head.alias("head"), F.lit(_FIELDS[kind]).alias("field"), point.alias("point"), tail.alias("tail"))


def _metric(field: Column, head: Column, data: Column) -> Column:
    out = F.lit(None).cast("binary")
    for number in _FIELDS.values():
        out = F.when(field == number, pb.message(number, data)).otherwise(out)
    return F.concat(head, out)


def metric_requests(all_points: DataFrame, resource: Resource, limit: int = REQUEST_BYTES) -> DataFrame:
    """``(request, n_points, body)``: export requests of at most ``limit`` bytes that hold every point of ``points`` once.

    Cut as ``otel.bounded_requests``: by prefix sums of bytes over ranges.
    """
    frame = F.octet_length("head") + F.octet_length("tail") + 2 * _FRAME
    rows = all_points.withColumn("_bytes", (F.octet_length("point") + _FRAME).cast("bigint"))
    first = rows.groupBy("name").agg(F.min("point").alias("point"), F.lit(True).alias("_first"))
    rows = rows.join(F.broadcast(first), ["name", "point"], "left").withColumn("_bytes", F.col("_bytes") + F.when(F.col("_first"), frame).otherwise(0)).drop("_first")
    around = F.octet_length(_resource(resource)) + len(resource.scope.encode()) + 6 * _FRAME
    most = rows.agg(F.coalesce(F.max("_bytes"), F.lit(0)), F.coalesce(F.max(frame), F.lit(0)), F.coalesce(F.max(around), F.lit(0))).first()
    room = limit - sum(most)
    if room <= 0:
        raise ValueError(f"a point and its metric do not fit a request of {limit} bytes")
    rows = running_sums(rows.withColumn("_all", F.lit(0)), ["_all"], ["name", "point"], "_bytes", "_to")
    rows = rows.withColumn("request", F.floor((F.col("_to") - F.col("_bytes")) / room).cast("bigint"))
    per = rows.groupBy("request", "name", "head", "field", "tail").agg(F.array_sort(F.collect_list("point")).alias("points"), F.count(F.lit(1)).alias("n"))
    metric = _metric(F.col("field"), F.col("head"), F.concat(pb.repeated(1, F.col("points")), F.col("tail")))
    body = per.select("request", "n", F.struct("name", metric.alias("metric")).alias("m")).groupBy("request").agg(F.sum("n").alias("n_points"), F.array_sort(F.collect_list("m")).alias("ms"))
    scope = F.concat(pb.message(1, pb.text(1, F.lit(resource.scope))), pb.repeated(2, F.transform("ms", lambda m: m["metric"])))
    return body.select("request", "n_points", pb.message(1, F.concat(pb.message(1, _resource(resource)), pb.message(2, scope))).alias("body"))


# Spans


def _value(v: Column) -> Column:
    """A span's typed value; a member of a oneof is written at its default, too."""
    kind = v["type"]
    number = F.concat(F.lit(bytearray([3 << 3])), pb.varint(v["i"]))
    flag = F.concat(F.lit(bytearray([2 << 3])), F.when(v["b"], F.lit(bytearray([1]))).otherwise(F.lit(bytearray([0]))))
    return F.when(kind == "int", number).when(kind == "double", pb.double(4, v["d"])).when(kind == "bool", flag).otherwise(pb.message(1, v["s"]))


def _pairs(field: int, attributes: Column) -> Column:
    return pb.repeated(field, F.transform(F.coalesce(attributes, F.array().cast(ATTRIBUTES)), lambda a: F.concat(pb.text(1, a["key"]), pb.message(2, _value(a["value"])))))


def span_messages(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, span)``: each span as a message; a root has no parent, an unset status is absent."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind")), F.lit(1))
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_CODES.items() for x in kv]), F.col("status.code"))
    status = F.when(code > 0, pb.message(15, F.concat(F.when(code == 2, pb.text(2, F.col("status.message"))).otherwise(pb.none()), pb.unsigned(3, code)))).otherwise(pb.none())
    events = F.transform(F.coalesce("events", F.array().cast(EVENTS)), lambda e: F.concat(pb.fixed(1, e["time_unix_nano"]), pb.text(2, e["name"]), _pairs(3, e["attributes"])))
    span = F.concat(
        pb.message(1, F.unhex("trace_id")), pb.message(2, F.unhex("span_id")), pb.text(4, F.unhex("parent_span_id")), pb.text(5, F.col("name")), pb.unsigned(6, kind),
        pb.fixed(7, F.col("start_unix_nano")), pb.fixed(8, F.col("end_unix_nano")), _pairs(9, F.col("attributes")), pb.repeated(11, events), status,
    )
    return spans.select("trace_id", "span_id", span.alias("span"))


def span_requests(spans: DataFrame, resource: Resource, batch: int = 512) -> DataFrame:
    """``(request, n, body)``: export requests of ``batch`` spans each, the last one of the rest; none is dropped."""
    rows = row_numbers(span_messages(spans).withColumn("_all", F.lit(0)), ["_all"], ["trace_id", "span_id"], "_n")
    rows = rows.withColumn("request", F.floor((F.col("_n") - 1) / batch))
    per = rows.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("span")).alias("spans"))
    scope = F.concat(pb.message(1, pb.text(1, F.lit(resource.scope))), pb.repeated(2, F.col("spans")))
    return per.select("request", "n", pb.message(1, F.concat(pb.message(1, _resource(resource)), pb.message(2, scope))).alias("body"))
