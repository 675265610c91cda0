"""Series as OpenTelemetry-shaped rows in four tables, and OTLP JSON there and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import numbers
from seriesmill.functions.labels import from_pairs
from seriesmill.operators.ranks import running_sums

CUMULATIVE = 2
SUM, GAUGE, HISTOGRAM, EXP_HISTOGRAM = "otel_metrics_sum", "otel_metrics_gauge", "otel_metrics_histogram", "otel_metrics_exponential_histogram"
_MAP = "map<string,string>"
#: Bytes of an export request, before compression.
REQUEST_BYTES = 4 << 20
#: Points of a metric in one JSON document, about; a metric of more series is cut over several.
POINTS = 10_000


@dataclass(frozen=True)
class Resource:
    """What all rows of an export share; the time is one literal for the export."""

    service: str
    time_unix_nano: int
    scope: str = "seriesmill"
    attributes: dict[str, str] = field(default_factory=dict)

    def with_attribute(self, key: str, value: str) -> Resource:
        return Resource(self.service, self.time_unix_nano, self.scope, {**self.attributes, key: value})

    def all_attributes(self) -> dict[str, str]:
        return {"service.name": self.service, **self.attributes}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]).cast(_MAP)


def nano_time(nanos: Column) -> Column:
    """A timestamp of epoch nanoseconds, to the microsecond."""
    return F.timestamp_micros(F.floor(nanos / 1000).cast("bigint"))


def _common(resource: Resource, name: Column, description: Column, unit: Column, labels: Column, start: Column, time: Column) -> list[Column]:
    text = lambda v, n: F.lit(v).alias(n)
    return [
        _literal_map(resource.all_attributes()).alias("ResourceAttributes"), text("", "ResourceSchemaUrl"), text(resource.service, "ServiceName"),
        text(resource.scope, "ScopeName"), text("", "ScopeVersion"), F.create_map().cast(_MAP).alias("ScopeAttributes"),
        F.lit(0).cast("bigint").alias("ScopeDroppedAttrCount"), text("", "ScopeSchemaUrl"), name.alias("MetricName"), description.alias("MetricDescription"),
        unit.alias("MetricUnit"), labels.alias("Attributes"), start.cast("bigint").alias("StartTimeUnixNano"), time.cast("bigint").alias("TimeUnixNano"),
        nano_time(start.cast("bigint")).alias("StartTimeUnix"), nano_time(time.cast("bigint")).alias("TimeUnix"), F.lit(0).cast("bigint").alias("Flags"),
    ]


def _rows(series: DataFrame, resource: Resource, name: str, description: str | None, labels: str | None, columns: Sequence[Column]) -> DataFrame:
    attributes = F.coalesce(F.col(labels), F.create_map().cast(_MAP)) if labels else F.create_map().cast(_MAP)
    common = _common(resource, F.lit(name), F.lit(description or name), F.lit(""), attributes, F.lit(0), F.lit(resource.time_unix_nano))
    return series.select(*common, *columns)


def sum_rows(series: DataFrame, resource: Resource, name: str, value: str = "sum", description: str | None = None, labels: str | None = None) -> DataFrame:
    """Cumulative and not monotonic: counters are signed.  Values above 2**53 lose precision."""
    return _rows(series, resource, name, description, labels, [F.col(value).cast("double").alias("Value"), F.lit(CUMULATIVE).alias("AggregationTemporality"), F.lit(False).alias("IsMonotonic")])


def gauge_rows(series: DataFrame, resource: Resource, name: str, value: str = "value", description: str | None = None, labels: str | None = None) -> DataFrame:
    return _rows(series, resource, name, description, labels, [F.col(value).cast("double").alias("Value")])


def histogram_rows(series: DataFrame, resource: Resource, name: str, bounds: Sequence[int], description: str | None = None, labels: str | None = None) -> DataFrame:
    """Counts per bucket, bounds as doubles without the infinite one; Min and Max are 0."""
    explicit = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    columns = [F.col("count").alias("Count"), F.col("sum").cast("double").alias("Sum"), F.col("counts").alias("BucketCounts"), explicit.alias("ExplicitBounds"), F.lit(0.0).alias("Min"), F.lit(0.0).alias("Max"), F.lit(CUMULATIVE).alias("AggregationTemporality")]
    return _rows(series, resource, name, description, labels, columns)


def exponential_rows(exp_stats: DataFrame, resource: Resource, name: str, description: str | None = None, labels: str | None = None) -> DataFrame:
    """Scale 0; takes the columns of ``aggregate.exponential_stats``."""
    compact = numbers.compact_buckets(F.col("positive"))
    none = F.array().cast("array<bigint>")
    columns = [
        F.col("count").alias("Count"), F.col("sum").cast("double").alias("Sum"), F.lit(0).alias("Scale"), F.col("zero_count").alias("ZeroCount"),
        compact["offset"].alias("PositiveOffset"), compact["counts"].alias("PositiveBucketCounts"), F.lit(0).alias("NegativeOffset"), none.alias("NegativeBucketCounts"),
        F.coalesce(F.col("min").cast("double"), F.lit(0.0)).alias("Min"), F.coalesce(F.col("max").cast("double"), F.lit(0.0)).alias("Max"), F.lit(CUMULATIVE).alias("AggregationTemporality"),
    ]
    return _rows(exp_stats, resource, name, description, labels, columns)


def timer_rows(series: DataFrame, resource: Resource, name: str, bounds: Sequence[int], description: str | None = None, labels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``_calls`` for the sum table and ``_samples`` for the histogram table, one description."""
    samples = series.withColumnsRenamed({"sample_sum": "sum", "sample_count": "count"})
    return sum_rows(series, resource, name + "_calls", "calls", description or name, labels), histogram_rows(samples, resource, name + "_samples", bounds, description or name, labels)


def label_attributes(label: str) -> Column:
    """The attribute map of a closed label domain's column."""
    return F.create_map(F.lit(label), F.col(label)).cast(_MAP)


# OTLP as JSON

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_NUMBER = f"array<struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,asInt:string,asDouble:double>>"
_HIST = f"array<struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,min:double,max:double>>"
_SIDE = "struct<offset:int,bucketCounts:array<string>>"
_EXP = f"array<struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,positive:{_SIDE},negative:{_SIDE},min:double,max:double>>"
METRIC = f"struct<name:string,description:string,unit:string,sum:struct<dataPoints:{_NUMBER},aggregationTemporality:int,isMonotonic:boolean>,gauge:struct<dataPoints:{_NUMBER}>,histogram:struct<dataPoints:{_HIST},aggregationTemporality:int>,exponentialHistogram:struct<dataPoints:{_EXP},aggregationTemporality:int>>"


def attributes_json(labels: Column) -> Column:
    """A label map as OTLP attributes, keys in byte order."""
    value = lambda v: F.struct(v.alias("stringValue"))
    return F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value")))


def attrs_to_map(attributes: Column) -> Column:
    """OTLP attributes as strings: values that are no scalar are left out, and the last of
    a repeated key wins."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], numbers.compact_float_text(v["doubleValue"]), v["boolValue"].cast("string"))
    plain = F.filter(F.transform(attributes, lambda a: F.struct(a["key"].alias("k"), text(a["value"]).alias("v"))), lambda a: a["v"].isNotNull())
    return F.coalesce(from_pairs(F.transform(plain, lambda a: F.struct(a["k"].alias("key"), a["v"].alias("value")))), F.create_map().cast(_MAP))


def _point(labels: str | None, time: int, *columns: Column) -> Column:
    attributes = attributes_json(F.col(labels)) if labels else attributes_json(F.create_map().cast(_MAP))
    return F.struct(attributes.alias("attributes"), F.lit(str(time)).alias("timeUnixNano"), *columns)


def _point_of(series: DataFrame, kind: str, time: int, value: str, bounds: Sequence[int], labels: str | None) -> tuple[Column, str, str]:
    """A series' point, the field of its metric that holds points, and what follows them there."""
    text = lambda c: c.cast("string")
    texts = lambda c: F.transform(c, lambda x: x.cast("string"))
    temporality = f',"aggregationTemporality":{CUMULATIVE}'
    if kind in ("sum", "gauge"):
        double = dict(series.dtypes)[value] in ("double", "float")
        point = _point(labels, time, F.col(value).alias("asDouble") if double else text(F.col(value)).alias("asInt"))
        return point, kind, temporality + ',"isMonotonic":false' if kind == "sum" else ""
    if kind == "histogram":
        explicit = F.array(*[F.lit(float(b)) for b in bounds])
        return _point(labels, time, text(F.col("count")).alias("count"), F.col("sum").cast("double").alias("sum"), texts(F.col("counts")).alias("bucketCounts"), explicit.alias("explicitBounds")), "histogram", temporality
    if kind == "exponential":
        c = numbers.compact_buckets(F.col("positive"))
        side = F.struct(c["offset"].alias("offset"), texts(c["counts"]).alias("bucketCounts"))
        point = _point(labels, time, text(F.col("count")).alias("count"), F.col("sum").cast("double").alias("sum"), F.lit(0).alias("scale"), text(F.col("zero_count")).alias("zeroCount"), side.alias("positive"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))
        return point, "exponentialHistogram", temporality
    raise ValueError(f"no such kind: {kind}")


def metric_points(series: DataFrame, kind: str, name: str, time_unix_nano: int, value: str = "sum", bounds: Sequence[int] = (), description: str | None = None, labels: str | None = None) -> DataFrame:
    """``(name, head, point, tail)``: a series' point as OTLP JSON, a row each, with the metric around it.

    Longs are strings, as OTLP's JSON has them.  ``kind``: sum, gauge, histogram or exponential (of ``aggregate.exponential_stats``).
    """
    point, field_, tail = _point_of(series, kind, time_unix_nano, value, bounds, labels)
    head = F.to_json(F.struct(F.lit(name).alias("name"), F.lit(description or name).alias("description"), F.lit("").alias("unit")))
    head = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(f',"{field_}":{{"dataPoints":['))
    return series.select(F.lit(name).alias("name"), head.alias("head"), F.to_json(point).alias("point"), F.lit(f"]{tail}}}}}").alias("tail"))


def _metrics_of(points: DataFrame, *by: str) -> DataFrame:
    """``(*by, name, json)``: the points of each metric joined, in the order of their text."""
    joined = F.array_join(F.array_sort(F.collect_list("point")), ",")
    return points.groupBy(*by, "name", "head", "tail").agg(joined.alias("points")).select(*by, "name", F.concat("head", "points", "tail").alias("json"))


def metric_json(series: DataFrame, kind: str, name: str, time_unix_nano: int, value: str = "sum", bounds: Sequence[int] = (), description: str | None = None, labels: str | None = None) -> DataFrame:
    """Rows ``json`` with an OTLP metric that together hold all its points; none if there is no series.

    A metric of at most ``POINTS`` series is one document.  The points of a larger one are dealt by their hash over documents
    of about that many, each with the metric around them, so no row or task holds them all.
    """
    points = metric_points(series, kind, name, time_unix_nano, value, bounds, description, labels)
    pieces = points.agg(F.ceil(F.count(F.lit(1)) / POINTS).alias("_pieces"))
    dealt = points.crossJoin(F.broadcast(pieces)).withColumn("_piece", F.pmod(F.xxhash64("point"), F.col("_pieces")))
    return _metrics_of(dealt, "_piece").select("json")


def _envelope(resource: Resource) -> tuple[Column, Column]:
    """What stands before and after the metrics of a request."""
    attributes = F.to_json(F.struct(attributes_json(_literal_map(resource.all_attributes())).alias("attributes")))
    return F.concat(F.lit('{"resourceMetrics":[{"resource":'), attributes, F.lit(f',"scopeMetrics":[{{"scope":{{"name":"{resource.scope}"}},"metrics":[')), F.lit("]}]}]}")


def bounded_requests(points: DataFrame, resource: Resource, limit: int = REQUEST_BYTES) -> DataFrame:
    """``(request, n_points, json)``: export requests of at most ``limit`` bytes that together hold every point of ``metric_points`` once.

    Points are taken in the order of metric and text, and a request begins where the running total of bytes passes the next
    multiple of what fits; the totals are prefix sums over ranges, so no task sees all points and a metric of any number
    of series is cut over requests.  A point that does not fit by itself is an error.
    """
    before, after = _envelope(resource)
    size = F.octet_length("point") + 1
    # A metric's name and field are written again in every request that has points of it.
    rows = points.withColumn("_bytes", size.cast("bigint"))
    frame = F.octet_length("head") + F.octet_length("tail") + 1
    first = rows.groupBy("name").agg(F.min("point").alias("point"), F.lit(True).alias("_first"))
    rows = rows.join(F.broadcast(first), ["name", "point"], "left").withColumn("_bytes", F.col("_bytes") + F.when(F.col("_first"), frame).otherwise(0)).drop("_first")
    most = rows.agg(F.coalesce(F.max("_bytes"), F.lit(0)), F.coalesce(F.max(frame), F.lit(0)), F.max(F.octet_length(before)) + F.max(F.octet_length(after))).first()
    room = limit - most[0] - most[1] - (most[2] or 0)
    if room <= 0:
        raise ValueError(f"a point and its metric do not fit a request of {limit} bytes")
    rows = running_sums(rows.withColumn("_all", F.lit(0)), ["_all"], ["name", "point"], "_bytes", "_to")
    rows = rows.withColumn("request", F.floor((F.col("_to") - F.col("_bytes")) / room).cast("bigint"))
    per = _metrics_of(rows, "request")
    counts = rows.groupBy("request").agg(F.count(F.lit(1)).alias("n_points"))
    body = per.groupBy("request").agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("m"))
    return body.join(counts, "request").select("request", "n_points", F.concat(before, F.col("m"), after).alias("json"))


def export_request(metrics: DataFrame, resource: Resource) -> DataFrame:
    """One row ``json``: the export request that wraps all metrics of ``metric_json``."""
    before, after = _envelope(resource)
    joined = metrics.agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("m"))
    return joined.select(F.concat(before, F.col("m"), after).alias("json"))


def rows_from_otlp(metrics: DataFrame, resource: Resource, json: str = "json") -> dict[str, DataFrame]:
    """The four tables of OTLP metrics in JSON, a metric each row; other kinds are ignored.

    Exponential histograms keep both of their sides.
    """
    m = metrics.select(F.from_json(json, METRIC).alias("m"))
    long = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    longs = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("bigint")), F.array().cast("array<bigint>"))
    real = lambda c: F.coalesce(c, F.lit(0.0))

    def rows(kind: str, columns) -> DataFrame:
        p = m.where(f"m.{kind} is not null").select("m", F.explode(f"m.{kind}.dataPoints").alias("p"))
        common = _common(resource, F.col("m.name"), F.coalesce("m.description", F.lit("")), F.coalesce("m.unit", F.lit("")), attrs_to_map(F.col("p.attributes")), long(F.col("p.startTimeUnixNano")), long(F.col("p.timeUnixNano")))
        return p.select(*common, *columns)

    temporality = lambda kind: F.coalesce(f"m.{kind}.aggregationTemporality", F.lit(0)).alias("AggregationTemporality")
    value = numbers.number_value(F.col("p.asInt"), F.col("p.asDouble")).alias("Value")
    low, high = real(F.col("p.min")).alias("Min"), real(F.col("p.max")).alias("Max")
    count, total = long(F.col("p.count")).alias("Count"), real(F.col("p.sum")).alias("Sum")
    side = lambda s, n: [F.coalesce(f"p.{s}.offset", F.lit(0)).alias(n + "Offset"), longs(F.col(f"p.{s}.bucketCounts")).alias(n + "BucketCounts")]
    return {
        SUM: rows("sum", [value, temporality("sum"), F.coalesce("m.sum.isMonotonic", F.lit(False)).alias("IsMonotonic")]),
        GAUGE: rows("gauge", [value]),
        HISTOGRAM: rows("histogram", [count, total, longs(F.col("p.bucketCounts")).alias("BucketCounts"), F.coalesce("p.explicitBounds", F.array().cast("array<double>")).alias("ExplicitBounds"), low, high, temporality("histogram")]),
        EXP_HISTOGRAM: rows("exponentialHistogram", [count, total, F.coalesce("p.scale", F.lit(0)).alias("Scale"), long(F.col("p.zeroCount")).alias("ZeroCount"), *side("positive", "Positive"), *side("negative", "Negative"), low, high, temporality("exponentialHistogram")]),
    }


def total_rows(batch: dict[str, DataFrame]) -> DataFrame:
    """``(table, n)`` for each table of a batch."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in batch.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def qualified_table(database: str, table: str) -> str:
    return f"{quote_ident(database)}.{quote_ident(table)}"
