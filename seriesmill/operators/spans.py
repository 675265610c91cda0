"""Spans as rows: building them, their trees, and OTLP JSON.

A span row has ``trace_id, span_id, parent_span_id, name, kind, start_unix_nano,
end_unix_nano, status struct<code,message>, attributes array<struct<key,value>>,
events array<struct<name,time_unix_nano,attributes>>``; a value is a struct of its
type and one field for each type.  Attributes are a list: repeats are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import trace_ids
from seriesmill.sources.rounds import kept

VALUE = "struct<type:string,s:string,i:bigint,d:double,b:boolean>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
EVENTS = f"array<struct<name:string,time_unix_nano:bigint,attributes:{ATTRIBUTES}>>"
STATUS = "struct<code:string,message:string>"
SPAN = f"trace_id string, span_id string, parent_span_id string, name string, kind string, start_unix_nano bigint, end_unix_nano bigint, status {STATUS}, attributes {ATTRIBUTES}, events {EVENTS}"

#: OTLP's numbers of span kinds and status codes.
KINDS = {"internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
STATUS_CODES = {"unset": 0, "ok": 1, "error": 2}


def value_of(column: Column, kind: str) -> Column:
    """A typed value: kind is string, int, double, bool or uuid (exported as a string)."""
    slot = {"string": "s", "uuid": "s", "int": "i", "double": "d", "bool": "b"}[kind]
    types = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
    return F.struct(F.lit(kind).alias("type"), *[(column.cast(t) if n == slot else F.lit(None).cast(t)).alias(n) for n, t in types.items()]).cast(VALUE)


def attribute(key: str, column: Column, kind: str) -> Column:
    return F.struct(F.lit(key).alias("key"), value_of(column, kind).alias("value"))


def set_attribute(attributes: Column, key: str, column: Column, kind: str) -> Column:
    """The list with one more attribute; an earlier one of the same key stays."""
    return F.concat(F.coalesce(attributes, F.array().cast(ATTRIBUTES)), F.array(attribute(key, column, kind)))


def add_event(events: Column, name: Column, time_unix_nano: Column, attributes: Column | None = None) -> Column:
    event = F.struct(name.alias("name"), time_unix_nano.cast("bigint").alias("time_unix_nano"), (F.array() if attributes is None else attributes).cast(ATTRIBUTES).alias("attributes"))
    return F.concat(F.coalesce(events, F.array().cast(EVENTS)), F.array(event))


def status(code: Column | str, message: Column | None = None) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(code.alias("code"), F.coalesce(message if message is not None else F.lit(""), F.lit("")).alias("message"))


def root_spans(rows: DataFrame, key: list[str], name: Column, start: Column, end: Column, kind: str = "internal", traceparent: Column | None = None) -> DataFrame:
    """Adds span columns for root spans: ids derived from ``key``, so a rerun agrees.

    A valid ``traceparent`` is adopted: its trace, and its span as the parent; an invalid or
    null one leaves a root.
    """
    remote = trace_ids.parse_traceparent(traceparent) if traceparent is not None else F.lit(None).cast("struct<trace_id:string,span_id:string,flags:string>")
    cols = [F.col(k) for k in key]
    return rows.withColumn("_remote", remote).select(
        "*",
        F.coalesce(F.col("_remote")["trace_id"], trace_ids.derived_trace_id(*cols)).alias("trace_id"),
        trace_ids.derived_span_id(*cols).alias("span_id"), F.col("_remote")["span_id"].alias("parent_span_id"), name.alias("name"), F.lit(kind).alias("kind"),
        start.cast("bigint").alias("start_unix_nano"), end.cast("bigint").alias("end_unix_nano"), status("unset").alias("status"),
        F.array().cast(ATTRIBUTES).alias("attributes"), F.array().cast(EVENTS).alias("events"),
    ).drop("_remote")


def child_spans(rows: DataFrame, parents: DataFrame, on: str, key: list[str], name: Column, start: Column, end: Column, kind: str = "internal") -> DataFrame:
    """Spans of ``rows`` under the parent with the same ``on``: its trace, and it as the parent.

    Rows without a recorded parent have no span.
    """
    up = parents.select(F.col(on), F.col("trace_id"), F.col("span_id").alias("parent_span_id"))
    return rows.join(up, on).select(
        "*", trace_ids.derived_span_id(*[F.col(k) for k in key]).alias("span_id"), name.alias("name"), F.lit(kind).alias("kind"),
        start.cast("bigint").alias("start_unix_nano"), end.cast("bigint").alias("end_unix_nano"), status("unset").alias("status"),
        F.array().cast(ATTRIBUTES).alias("attributes"), F.array().cast(EVENTS).alias("events"),
    )


def duration(spans: DataFrame) -> DataFrame:
    """Adds ``duration_nanos``, 0 if the clock went back."""
    return spans.withColumn("duration_nanos", F.greatest(F.col("end_unix_nano") - F.col("start_unix_nano"), F.lit(0)))


def with_traceparent(spans: DataFrame) -> DataFrame:
    return spans.withColumn("traceparent", trace_ids.to_traceparent(F.col("trace_id"), F.col("span_id")))


def edges(spans: DataFrame) -> DataFrame:
    """``(trace_id, parent_span_id, parent_name, span_id, name)`` of every child whose parent is there."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("parent_name"))
    return spans.where("parent_span_id is not null").join(parents, ["trace_id", "parent_span_id"]).select("trace_id", "parent_span_id", "parent_name", "span_id", "name")


def _packed(id_: Column) -> Column:
    """An id as bytes, half as many where it is lower-case hexadecimal; different ids differ."""
    raw = F.unhex(id_)
    return F.when(F.lower(F.hex(raw)) == id_, F.concat(F.lit(b"\1"), raw)).otherwise(F.concat(F.lit(b"\0"), id_.cast("binary")))


def _unpacked(bytes_: Column) -> Column:
    rest = F.substring(bytes_, 2, 2**31 - 1)
    return F.when(F.substring(bytes_, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def tree_depths(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, depth, root_span_id)`` of every span, whose ids occur once in a trace.

    Roots, and orphans of missing parents, have depth 0.  Spans on a cycle of parents, or below one, have
    no depth and no root.  Ids travel as bytes.  The first round looks at the parent, and whether that names one itself,
    which settles two levels.  Each round after it, a pointer skips as far again as it has come, and a
    span whose pointer has passed its root is done; so there are as many rounds as the depth has binary digits,
    over fewer spans each, every one written.  Pointers that are still under way after more steps than the largest
    trace has spans are on a cycle.
    """
    ids = spans.select(_packed(F.col("trace_id")).alias("trace_id"), _packed(F.col("span_id")).alias("span_id"), _packed(F.col("parent_span_id")).alias("p"))
    known = ids.select("trace_id", F.col("span_id").alias("p"), F.col("p").isNotNull().alias("below"))
    ptr = ids.join(known, ["trace_id", "p"], "left")
    # ``up``: how far the pointer has come, null once it has passed the root; ``top``: the root then, null for the span itself.
    there, parent = F.col("below").isNotNull(), F.col("p")
    ptr = kept(ptr.select("trace_id", "span_id", F.when(F.col("below"), parent).alias("up"), F.when(there, 1).otherwise(0).alias("depth"), F.when(there, parent).alias("top")), "spans")
    done, under_way, reach = [ptr.where("up is null")], ptr.where("up is not null"), 1
    most = None
    while not under_way.isEmpty():
        if reach >= 64 and most is None:
            most = spans.groupBy("trace_id").count().agg(F.max("count")).first()[0]
        if most is not None and reach > most:
            done.append(under_way.select("trace_id", "span_id", "up", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("binary").alias("top")))
            break
        everyone = reduce(DataFrame.unionByName, [*done, under_way])
        far = everyone.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.coalesce("top", "span_id").alias("t2"))
        step = under_way.join(far, ["trace_id", "up"]).select("trace_id", "span_id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("t2").alias("top"))
        step, reach = kept(step, "spans"), 2 * reach
        done.append(step.where("up is null"))
        under_way = step.where("up is not null")
    root = F.when(F.col("depth").isNotNull(), _unpacked(F.coalesce("top", "span_id")))
    return reduce(DataFrame.unionByName, done).select(_unpacked(F.col("trace_id")).alias("trace_id"), _unpacked(F.col("span_id")).alias("span_id"), "depth", root.alias("root_span_id"))


def current_spans(logs: DataFrame, spans: DataFrame, producer: str = "producer", at: str = "time_unix_nano") -> DataFrame:
    """Each log row with the innermost span open on its producer at its time, or nulls.

    A span lies in one or two cells of the least power of two that is no shorter than it, whatever its length; a
    log row is looked for in its cell of each size in use, at most 63.  So it is an equality join on producer, size and
    cell, then the latest start that fits.
    """
    size = lambda nanos: F.when(nanos > 0, F.length(F.bin(nanos))).otherwise(0)
    cell = lambda t, bits: F.call_function("shiftright", t, bits.cast("int"))
    start, end = F.col("start_unix_nano"), F.col("end_unix_nano")
    s = spans.where(end >= start).select(F.col(producer).alias("_p"), "trace_id", "span_id", start, end, size(end - start).cast("int").alias("_size"))
    sizes = sorted(r[0] for r in s.select("_size").distinct().collect())
    s = s.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(start, F.col("_size")), cell(end, F.col("_size"))))))
    l = logs.withColumn("_row", F.monotonically_increasing_id())
    looked = l.select("_row", F.col(producer).alias("_p"), F.col(at).alias("_at"), F.explode(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")).alias("_size"))
    found = looked.withColumn("_cell", cell(F.col("_at"), F.col("_size"))).join(s, ["_p", "_size", "_cell"]).where(F.col("_at").between(start, end))
    best = found.groupBy("_row").agg(F.max_by(F.struct("trace_id", "span_id"), F.struct("start_unix_nano", "span_id")).alias("_c"))
    return l.join(best, "_row", "left").select(*logs.columns, F.col("_c.trace_id").alias("trace_id"), F.col("_c.span_id").alias("span_id"))


def counters(spans: DataFrame, recorded: str = "recorded") -> DataFrame:
    """``recorded_count`` and ``sampled_out_count`` of roots, and the rows kept; nothing is dropped."""
    root = F.col("parent_span_id").isNull()
    return spans.agg(F.count_if(root & F.col(recorded)).alias("recorded_count"), F.count_if(root & ~F.col(recorded)).alias("sampled_out_count"), F.lit(0).cast("bigint").alias("dropped_count"), F.count_if(F.col(recorded)).alias("len"))


def keep_recorded(spans: DataFrame, recorded: str = "recorded") -> DataFrame:
    """Spans of recorded roots: a child of a root that was sampled out is none either.

    Only roots are sampled; a trace whose root is not here is kept.
    """
    out = spans.where(F.col("parent_span_id").isNull() & ~F.col(recorded)).select("trace_id").distinct()
    return spans.join(out, "trace_id", "left_anti")


def _attributes_json(attributes: Column) -> Column:
    def value(v):
        return F.struct(v["s"].alias("stringValue"), v["i"].cast("string").alias("intValue"), v["d"].alias("doubleValue"), v["b"].alias("boolValue"))

    return F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value")))


def to_otlp(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, json)``: a root's parent is empty, an unset status absent."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind")), F.lit(1))
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_CODES.items() for x in kv]), F.col("status.code"))
    shown = F.when(code > 0, F.struct(code.alias("code"), F.when(code == 2, F.col("status.message")).otherwise("").alias("message")))
    events = F.transform("events", lambda e: F.struct(e["time_unix_nano"].cast("string").alias("timeUnixNano"), e["name"].alias("name"), _attributes_json(e["attributes"]).alias("attributes")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), F.col("name").alias("name"), kind.alias("kind"),
        F.col("start_unix_nano").cast("string").alias("startTimeUnixNano"), F.col("end_unix_nano").cast("string").alias("endTimeUnixNano"),
        _attributes_json(F.col("attributes")).alias("attributes"), events.alias("events"), shown.alias("status"),
    )
    return spans.select("trace_id", "span_id", F.to_json(span).alias("json"))


def trace_requests(otlp: DataFrame, service: str, scope: str = "seriesmill", batch: int = 512) -> DataFrame:
    """``(batch, n, json)``: export requests of at most ``batch`` spans.  None is dropped.

    Spans are dealt by a hash into batches of about that size, split where one is larger.
    """
    n = max(1, -(-otlp.count() // batch))
    rows = otlp.withColumn("_b", F.pmod(F.xxhash64("trace_id", "span_id"), F.lit(n)))
    from pyspark.sql.window import Window

    part = F.floor((F.row_number().over(Window.partitionBy("_b").orderBy("trace_id", "span_id")) - 1) / batch)
    grouped = rows.withColumn("_s", part).groupBy("_b", "_s").agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("j"), F.count(F.lit(1)).alias("n"))
    head = f'{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":"{service}"}}}}]}},"scopeSpans":[{{"scope":{{"name":"{scope}"}},"spans":['
    return grouped.select(F.concat_ws("-", "_b", "_s").alias("batch"), "n", F.concat(F.lit(head), F.col("j"), F.lit("]}]}]}")).alias("json"))
