"""Named queries over the test tables, and the SQL that each must agree with.

``events`` are the observations: one counter increment each, ``value`` a gauge, and
its whole part what histograms and distributions record; ``(ts, event_id)`` is the
order.  ``orders`` are root spans and ``lineitem`` their children.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.functions import numbers, trace_ids
from seriesmill.functions.labels import LabelDomain, fingerprint, from_pairs, label_map, prometheus_labels, series_key, snake_case_column
from seriesmill.operators import aggregate, cardinality, exposition, otel, otlp_proto, run_stats, sampling, spans, temporality
from seriesmill.plans import translate
from seriesmill.plans.metric_set import MetricSet, MetricSpec
from seriesmill.session import configure
from seriesmill.sources.observations import observations, with_profile

BOUNDS = (10, 50, 100, 500)
TYPES = LabelDomain("event_type", ("view", "click", "signup", "purchase", "refund", "error"))
RESOURCE = otel.Resource("shop", 1_700_000_000_000_000_000, attributes={"env": "test"})
CAP, IDLE_HOURS = 20, 6

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(configure(spark), sf_dir))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


class Tables:
    """The tables of a folder, and the events as observations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def whole(self) -> DataFrame:
        """Events with ``v``, the whole part of the value, and their day and hour."""
        seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
        return self.events.withColumns({"v": F.floor("value").cast("bigint"), "one": F.lit(1).cast("bigint"), "day": F.date_format("ts", "yyyy-MM-dd"), "hour": F.floor(seconds / 3600).cast("bigint"), "labels": label_map(event_type="event_type", user_id="user_id")})

    def obs(self, metric: str = "events", op: str = "add", value: str = "one") -> DataFrame:
        """``events`` as stored observations: label sets of user and type."""
        e = self.whole()
        return observations(e, metric, op, labels=F.col("labels"), value_l=F.col(value), value_d=F.col("value"), seq="event_id", producer=F.col("user_id"))


# Aggregations

_DAY = "strftime(ts, '%Y-%m-%d')"
#: The types, and a member that no event has.
WIDE = LabelDomain("event_type", (*TYPES.values, "none"))
_WIDE = "d AS (SELECT CAST(i AS INTEGER) AS idx, event_type FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(WIDE.values)) + ") AS x(i, event_type))"
_DOMAIN = "d AS (SELECT CAST(i AS INTEGER) AS idx, event_type FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(TYPES.values)) + ") AS x(i, event_type))"


@query('SELECT CAST(count(*) AS BIGINT) AS "sum" FROM events')
def counter_sum(t: Tables) -> DataFrame:
    return aggregate.counter_sum(t.obs())


@query("SELECT strftime(ts, '%Y-%m-%d') AS \"window\", CAST(count(*) AS BIGINT) AS \"sum\" FROM events GROUP BY 1")
def counter_swap_by_day(t: Tables) -> DataFrame:
    return aggregate.counter_swap(t.obs(), F.date_format("ts", "yyyy-MM-dd"))


@query(
    f"""WITH {_DOMAIN} SELECT d.idx, d.event_type, CAST(count(e.event_id) AS BIGINT) AS "sum"
    FROM d LEFT JOIN events e ON e.event_type = d.event_type GROUP BY 1, 2"""
)
def labeled_counter_complete(t: Tables) -> DataFrame:
    sums = aggregate.counter_sum(t.whole(), ["event_type"], "one")
    return aggregate.complete(sums, TYPES, "event_type", {"sum": F.lit(0).cast("bigint")})


@query(
    f"""WITH {_WIDE}, e AS (SELECT event_id, event_type, {_DAY} AS "window" FROM events), w AS (SELECT DISTINCT "window" FROM e)
    SELECT w."window", d.idx, d.event_type, CAST(count(e.event_id) AS BIGINT) AS "sum" FROM w CROSS JOIN d LEFT JOIN e ON e.event_type = d.event_type AND e."window" = w."window" GROUP BY 1, 2, 3"""
)
def labeled_counter_swap(t: Tables) -> DataFrame:
    sums = aggregate.counter_swap(t.whole(), F.col("day"), ["event_type"], "one")
    return aggregate.complete(sums, WIDE, "event_type", {"sum": F.lit(0).cast("bigint")}, ["window"])


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind, CAST(count(*) AS BIGINT) AS \"sum\" FROM events GROUP BY 1")
def labeled_counter_last_variant(t: Tables) -> DataFrame:
    """Values outside a domain count as its last member."""
    rows = aggregate.into_domain(t.whole().withColumn("kind", F.col("event_type")), LabelDomain("kind", ("view", "click", "other")), "kind")
    return aggregate.counter_sum(rows, ["kind"], "one")


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS \"value\" FROM events GROUP BY 1")
def gauge_last(t: Tables) -> DataFrame:
    return aggregate.gauge_last(t.events, ["event_type"], "value", ("ts", "event_id"), 0.0)


@query(f"WITH {_WIDE} SELECT d.idx, d.event_type, coalesce(arg_max(e.value, (e.ts, e.event_id)), 0.0) AS \"value\" FROM d LEFT JOIN events e ON e.event_type = d.event_type GROUP BY 1, 2")
def labeled_gauge_complete(t: Tables) -> DataFrame:
    last = aggregate.gauge_last(t.events, ["event_type"], "value", ("ts", "event_id"), 0.0)
    return aggregate.complete(last, WIDE, "event_type", {"value": F.lit(0.0)})


_FOLD = """WITH e AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS v, event_id % 7 = 0 AS is_set FROM events),
    s AS (SELECT *, max(CASE WHEN is_set THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS last_set FROM e)
    SELECT user_id, CAST(sum(CASE WHEN last_set IS NULL OR (ts, event_id) >= last_set THEN v ELSE 0 END) AS BIGINT) AS "value" FROM s GROUP BY 1"""


@query(_FOLD)
def gauge_set_add_fold(t: Tables) -> DataFrame:
    rows = t.whole().withColumn("op", F.when(F.col("event_id") % 7 == 0, "set").otherwise("add"))
    return aggregate.set_add_fold(rows, ["user_id"], value="v", order=("ts", "event_id"))


@query("SELECT event_type, greatest(CAST(480 AS BIGINT), max(CAST(floor(value) AS BIGINT))) AS \"max\", least(CAST(2 AS BIGINT), min(CAST(floor(value) AS BIGINT))) AS \"min\" FROM events GROUP BY 1")
def extrema_with_initial(t: Tables) -> DataFrame:
    return aggregate.extrema(t.whole(), ["event_type"], "v", max_initial=480, min_initial=2)


@query(
    """WITH w AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS d)),
    e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(floor(value) AS BIGINT) AS v FROM events)
    SELECT w.day, CAST(greatest(0, coalesce(max(e.v), 0)) AS BIGINT) AS "max", CAST(coalesce(min(e.v), 9223372036854775807) AS BIGINT) AS "min" FROM w LEFT JOIN e ON e.day = w.day GROUP BY 1"""
)
def extrema_window_reset(t: Tables) -> DataFrame:
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-30").cast("date"), F.lit("2024-02-02").cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return aggregate.extrema_reset(t.whole(), days, "day", value="v")


@query("SELECT event_type, greatest(0.0::DOUBLE, max(value)) AS \"max\", min(value) AS \"min\" FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def extrema_without_nan(t: Tables) -> DataFrame:
    rows = t.events.withColumn("value", F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value")))
    return aggregate.extrema(rows, ["event_type"], "value", max_initial=0.0)


_CUM = """SELECT event_type, CAST(i AS INTEGER) AS idx, CAST(le AS BIGINT) AS le, CAST(count(*) FILTER (WHERE le IS NULL OR floor(value) <= le) AS BIGINT) AS cumulative
    FROM events, (VALUES (0,10),(1,50),(2,100),(3,500),(4,NULL)) AS b(i, le) GROUP BY 1, 2, 3"""


@query(_CUM)
def histogram_cumulative(t: Tables) -> DataFrame:
    hist = aggregate.histogram(t.whole(), BOUNDS, ["event_type"], "v")
    return aggregate.histogram_cumulative(hist, BOUNDS, ["event_type"])


_BUCKETS = "concat_ws(',', count(*) FILTER (WHERE floor(value) <= 10), count(*) FILTER (WHERE floor(value) > 10 AND floor(value) <= 50), count(*) FILTER (WHERE floor(value) > 50 AND floor(value) <= 100), count(*) FILTER (WHERE floor(value) > 100 AND floor(value) <= 500), count(*) FILTER (WHERE floor(value) > 500))"
_TOTALS = 'CAST(count(*) AS BIGINT) AS "count", CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS "sum"'


@query(f"SELECT event_type, {_BUCKETS} AS counts, {_TOTALS} FROM events GROUP BY 1")
def histogram_per_bucket(t: Tables) -> DataFrame:
    hist = aggregate.histogram(t.whole(), BOUNDS, ["event_type"], "v")
    back = numbers.cumulative_to_buckets(numbers.cumulative(F.col("counts")))
    return hist.withColumn("counts", F.array_join(F.transform(back, lambda x: x.cast("string")), ","))


def _text(counts: str):
    return F.array_join(F.transform(counts, lambda x: x.cast("string")), ",").alias(counts)


@query(
    f"""WITH {_WIDE}, h AS (SELECT event_type, {_BUCKETS} AS counts, {_TOTALS} FROM events GROUP BY 1)
    SELECT d.idx, d.event_type, coalesce(h.counts, '0,0,0,0,0') AS counts, coalesce(h."count", 0) AS "count", coalesce(h."sum", 0) AS "sum" FROM d LEFT JOIN h ON h.event_type = d.event_type"""
)
def labeled_histogram_complete(t: Tables) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    hist = aggregate.histogram(t.whole(), BOUNDS, ["event_type"], "v")
    out = aggregate.complete(hist, WIDE, "event_type", {"counts": F.array(*[zero] * (len(BOUNDS) + 1)), "count": zero, "sum": zero})
    return out.withColumn("counts", _text("counts"))


_US = [None, *numbers.LATENCY_BOUNDS_US, None]
_LATENCY = ", ".join(f"count(*) FILTER (WHERE {' AND '.join(filter(None, [a and f'v > {a}', b and f'v <= {b}']))})" for a, b in zip(_US, _US[1:], strict=False))


@query(f"SELECT l_returnflag, concat_ws(',', {_LATENCY}) AS counts, CAST(count(*) AS BIGINT) AS \"count\", CAST(sum(v) AS BIGINT) AS \"sum\" FROM (SELECT l_returnflag, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS v FROM lineitem) GROUP BY 1")
def histogram_latency_bounds(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("v", F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint"))
    return aggregate.histogram(rows, numbers.LATENCY_BOUNDS_US, ["l_returnflag"], "v").withColumn("counts", _text("counts"))


_V = "CAST(floor(value) AS BIGINT)"
_BUCKET = f"(length(bin({_V})) - 1)"


@query(f"""SELECT event_type, CAST(CASE WHEN {_V} = 0 THEN -1 ELSE {_BUCKET} END AS INTEGER) AS pos,
    CAST(CASE WHEN {_V} = 0 THEN 0 WHEN {_BUCKET} = 0 THEN 1 ELSE 3 * (1 << ({_BUCKET} - 1)) END AS BIGINT) AS midpoint, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2, 3""")
def exp_histogram_buckets(t: Tables) -> DataFrame:
    exp = aggregate.exponential_histogram(t.whole(), ["event_type"], "v")
    return aggregate.exponential_samples(exp, ["event_type"])


_EXP_STATS = f"""SELECT event_type, {_TOTALS}, CAST(count(*) FILTER (WHERE {_V} = 0) AS BIGINT) AS zero_count,
    sum({_V})::DOUBLE / count(*) AS mean, CAST(CASE WHEN min({_V}) = 0 THEN 0 ELSE 1 << (length(bin(min({_V}))) - 1) END AS BIGINT) AS "min",
    CAST((1 << length(bin(max({_V})))) - 1 AS BIGINT) AS "max" FROM events GROUP BY 1"""


@query(_EXP_STATS)
def exp_histogram_stats(t: Tables) -> DataFrame:
    return aggregate.exponential_stats(aggregate.exponential_histogram(t.whole(), ["event_type"], "v")).drop("positive")


_COMPACT = f"""WITH b AS (SELECT event_type, {_BUCKET} AS b, count(*) AS n FROM events WHERE {_V} > 0 GROUP BY 1, 2),
    r AS (SELECT event_type, min(b) AS lo, max(b) AS hi FROM b GROUP BY 1),
    s AS (SELECT event_type, lo, unnest(range(lo, hi + 1)) AS k FROM r)
    SELECT s.event_type, CAST(s.lo AS INTEGER) AS "offset", string_agg(coalesce(b.n, 0)::VARCHAR, ',' ORDER BY s.k) AS counts
    FROM s LEFT JOIN b ON b.event_type = s.event_type AND b.b = s.k GROUP BY 1, 2"""


@query(_COMPACT)
def exp_histogram_compact(t: Tables) -> DataFrame:
    exp = aggregate.exponential_histogram(t.whole(), ["event_type"], "v").withColumn("c", numbers.compact_buckets(F.col("positive")))
    return exp.select("event_type", F.col("c.offset").alias("offset"), F.array_join(F.transform("c.counts", lambda x: x.cast("string")), ",").alias("counts"))


@query("""WITH p AS (SELECT DISTINCT CAST(floor(l_extendedprice * l_quantity * l_quantity) AS BIGINT) AS v FROM lineitem), b AS (SELECT DISTINCT length(bin(v)) - 1 AS b FROM p WHERE v > 0),
    x AS (SELECT v, CAST(length(bin(v)) - 1 AS INTEGER) AS bucket FROM (SELECT v FROM p UNION SELECT (1::BIGINT << b) + unnest([-1, 0, 1]) FROM b) WHERE v > 0)
    SELECT v, bucket, CAST(CASE WHEN bucket = 0 THEN 1 ELSE 3 * pow(2, bucket - 1)::HUGEINT END AS BIGINT) AS midpoint, 1::BIGINT << bucket AS low,
    CASE WHEN bucket = 62 THEN 9223372036854775807 ELSE (1::BIGINT << (bucket + 1)) - 1 END AS high FROM x""")
def exp_bucket_bounds(t: Tables) -> DataFrame:
    """The buckets of all values, and of either side of every power of two that is among their bounds."""
    v = t.lineitem.select(F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity")).cast("bigint").alias("v")).distinct()
    edge = v.where("v > 0").select(numbers.bucket_index(F.col("v")).alias("b")).distinct()
    edge = edge.select(F.explode(F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda x: numbers.bucket_low(F.col("b")) + x)).alias("v"))
    v = v.union(edge).where("v > 0").distinct().withColumn("bucket", numbers.bucket_index(F.col("v")))
    b = F.col("bucket")
    return v.select("v", "bucket", numbers.bucket_midpoint(b).alias("midpoint"), numbers.bucket_low(b).alias("low"), numbers.bucket_high(b).alias("high"))


@query("SELECT l_orderkey, CAST(sum(greatest(date_diff('day', o_orderdate, l_shipdate), 0)) * 86400000000000 AS BIGINT) AS nanos FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def timer_guard_elapsed(t: Tables) -> DataFrame:
    """Guards that start at the order and finish at the shipment; 0 if that came first."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("l_orderkey").agg(F.sum(aggregate.elapsed_nanos(at("o_orderdate"), at("l_shipdate"))).alias("nanos"))


_TIMER = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
    SELECT event_type, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE rn % 8 = 0) AS BIGINT) AS sample_count,
    CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE rn % 8 = 0), 0) AS BIGINT) AS sample_sum,
    sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE rn % 8 = 0)::DOUBLE / nullif(count(*) FILTER (WHERE rn % 8 = 0), 0) AS sample_avg FROM r GROUP BY 1"""


@query(_TIMER)
def timer_stride_8(t: Tables) -> DataFrame:
    rows = sampling.stride_sample(t.whole(), 7, "user_id", ("ts", "event_id"))
    return aggregate.timer(rows, BOUNDS, ["event_type"], "v").drop("counts")


@query(f"""WITH {_DOMAIN}, x AS ({_TIMER}) SELECT d.idx, d.event_type, coalesce(x.calls, 0) AS calls, coalesce(x.sample_count, 0) AS sample_count, coalesce(x.sample_sum, 0) AS sample_sum, x.sample_avg
    FROM d LEFT JOIN x ON x.event_type = d.event_type""")
def labeled_timer_complete(t: Tables) -> DataFrame:
    rows = sampling.stride_sample(t.whole(), 8, "user_id", ("ts", "event_id"))
    zero = F.lit(0).cast("bigint")
    timers = aggregate.timer(rows, BOUNDS, ["event_type"], "v").drop("counts")
    return aggregate.complete(timers, TYPES, "event_type", {"calls": zero, "sample_count": zero, "sample_sum": zero})


# Label sets, caps, eviction

_LABELS = "concat('event_type=\"', event_type, '\",user_id=\"', user_id, '\"')"


@query(f'SELECT {_LABELS} AS labels, CAST(count(*) AS BIGINT) AS "sum" FROM events GROUP BY 1')
def dynamic_counter_series(t: Tables) -> DataFrame:
    series = aggregate.snapshot(t.obs(), aggregate.counter_sum)
    return series.select(prometheus_labels(F.col("labels")).alias("labels"), "sum")


@query(f'SELECT {_LABELS} AS labels, arg_max(value, (ts, event_id)) AS "value" FROM events GROUP BY 1')
def dynamic_gauge_series(t: Tables) -> DataFrame:
    series = aggregate.snapshot(t.obs(op="set"), aggregate.gauge_last, initial=0.0)
    return series.select(prometheus_labels(F.col("labels")).alias("labels"), "value")


@query(f"""WITH e AS (SELECT {_LABELS} AS labels, event_id, ts, {_V} AS v, event_id % 7 = 0 AS is_set FROM events), s AS (SELECT *, max(CASE WHEN is_set THEN (ts, event_id) END) OVER (PARTITION BY labels) AS last_set FROM e)
    SELECT labels, CAST(sum(CASE WHEN last_set IS NULL OR (ts, event_id) >= last_set THEN v ELSE 0 END) AS BIGINT) AS "value" FROM s GROUP BY 1""")
def dynamic_gauge_i64_series(t: Tables) -> DataFrame:
    rows = t.obs(value="v").withColumn("op", F.when(F.col("seq") % 7 == 0, "set").otherwise("add"))
    return aggregate.snapshot(rows, aggregate.set_add_fold).select(prometheus_labels(F.col("labels")).alias("labels"), "value")


@query(f"SELECT {_LABELS} AS labels, {_BUCKETS} AS counts, {_TOTALS} FROM events GROUP BY 1")
def dynamic_histogram_series(t: Tables) -> DataFrame:
    series = aggregate.snapshot(t.obs(value="v"), aggregate.histogram, bounds=BOUNDS)
    return series.select(prometheus_labels(F.col("labels")).alias("labels"), _text("counts"), "count", "sum")


@query(_EXP_STATS.replace("SELECT event_type", f"SELECT {_LABELS} AS labels"))
def dynamic_distribution_series(t: Tables) -> DataFrame:
    series = aggregate.exponential_stats(aggregate.snapshot(t.obs(value="v"), aggregate.exponential_histogram))
    return series.select(prometheus_labels(F.col("labels")).alias("labels"), *[c for c in series.columns if c not in ("labels", "positive")])


@query("SELECT event_type, lower(x[1] || regexp_replace(x[2:], '([A-Z])', '_\\1', 'g')) AS label, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, upper(event_type[1]) || event_type[2:] || 'OnDay' || day(ts) || 'AM' AS x FROM events) GROUP BY 1, 2")
def enum_labels(t: Tables) -> DataFrame:
    name = F.concat(F.initcap("event_type"), F.lit("OnDay"), F.dayofmonth("ts").cast("string"), F.lit("AM"))
    return t.events.groupBy("event_type", snake_case_column(name).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query('SELECT CAST(count(*) AS BIGINT) AS "sum" FROM events WHERE event_type = \'click\' AND user_id = 3')
def dynamic_point_lookup(t: Tables) -> DataFrame:
    series = aggregate.snapshot(t.obs(), aggregate.counter_sum)
    return aggregate.point_read(series, F.col("labels"), {"user_id": "3", "event_type": "click"}, {"sum": F.lit(0).cast("bigint")})


@query("SELECT CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS cardinality FROM events")
def dynamic_cardinality(t: Tables) -> DataFrame:
    return aggregate.cardinality(t.obs())


@query("SELECT CAST(count(*) AS BIGINT) AS sum_all FROM events")
def dynamic_sum_all(t: Tables) -> DataFrame:
    return aggregate.sum_all(aggregate.snapshot(t.obs(), aggregate.counter_sum))


@query("SELECT concat('a=\"', user_id, '\",b=\"', CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'x' END, '\"') AS labels, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def label_canonicalisation(t: Tables) -> DataFrame:
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    pairs = F.array(pair("b", F.lit("x")), pair("a", F.col("user_id")), pair("b", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("x")))
    return t.events.select(prometheus_labels(from_pairs(pairs)).alias("labels")).groupBy("labels").agg(F.count(F.lit(1)).alias("n"))


_FIRST = f"""WITH f AS (SELECT {_LABELS} AS labels, user_id, event_type, min((ts, event_id)) AS first, count(*) AS n FROM events GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (ORDER BY first) AS rn FROM f)"""


@query(f"""{_FIRST} SELECT CASE WHEN rn <= {CAP} THEN labels ELSE '__ft_overflow="true"' END AS labels, CAST(sum(n) AS BIGINT) AS "sum" FROM r GROUP BY 1""")
def capped_series(t: Tables) -> DataFrame:
    series = aggregate.counter_sum(cardinality.cap_series(t.obs(), CAP), ["labels"])
    return series.select(prometheus_labels(F.col("labels")).alias("labels"), "sum")


@query(f"""{_FIRST} SELECT CAST(sum(n) FILTER (WHERE rn > {CAP}) AS BIGINT) AS overflow_records, CAST(count(*) FILTER (WHERE rn > {CAP}) AS BIGINT) AS overflow_series,
    CAST(least(count(*), {CAP}) + CASE WHEN count(*) > {CAP} THEN 1 ELSE 0 END AS BIGINT) AS cardinality FROM r""")
def overflow_stats(t: Tables) -> DataFrame:
    return cardinality.overflow_stats(t.obs(), CAP).drop("metric")


@query(f"""{_FIRST} SELECT 'events' AS metric, CAST(sum(n) FILTER (WHERE rn > {CAP}) AS BIGINT) AS overflow_records, CAST(count(*) FILTER (WHERE rn > {CAP}) AS BIGINT) AS overflow_series,
    CAST({CAP} + 1 AS BIGINT) AS cardinality FROM r HAVING count(*) > {CAP}""")
def overflow_warnings(t: Tables) -> DataFrame:
    return SHOP.overflow_warnings(t.obs())


_GENERATIONS = f"""WITH c AS (SELECT user_id, event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3),
    g AS (SELECT *, CASE WHEN h - lag(h) OVER w > {IDLE_HOURS} THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY h)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY h) AS generation FROM g),
    a AS (SELECT user_id, event_type, generation, max(h) AS last_cycle, sum(n) AS n FROM s GROUP BY 1, 2, 3)
    SELECT user_id, event_type, CAST(generation AS BIGINT) AS generation, last_cycle, CAST(n AS BIGINT) AS n,
    generation < max(generation) OVER (PARTITION BY user_id, event_type) OR (SELECT max(h) FROM c) - last_cycle > {IDLE_HOURS} AS evicted FROM a"""


@query(_GENERATIONS)
def evicted_generations(t: Tables) -> DataFrame:
    by = ["user_id", "event_type"]
    rows = t.whole()
    now = rows.agg(F.max("hour")).first()[0]
    return cardinality.live_generations(cardinality.generations(rows, "hour", IDLE_HOURS, by), now or 0, IDLE_HOURS, by, "hour", [F.count(F.lit(1)).alias("n")])


#: The fold over touches in time order, its state the live series with their last cycles.
_CAP_AND_EVICT = f"""WITH RECURSIVE f AS (SELECT {_LABELS} AS labels, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS cycle, min((ts, event_id)) AS first FROM events GROUP BY 1, 2),
    t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cycle, first) AS i FROM f),
    walk AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS labels, NULL::BIGINT AS cycle, [{{'k': 'x', 't': 0::BIGINT}}][2:] AS live, false AS redirected, false AS fresh
    UNION ALL SELECT i, labels, cycle, list_filter(kept, lambda x: x.k <> CASE WHEN known OR open THEN labels ELSE '' END) || [{{'k': CASE WHEN known OR open THEN labels ELSE '' END, 't': cycle}}], NOT (known OR open), open AND NOT known
    FROM (SELECT *, list_contains(list_transform(kept, lambda x: x.k), labels) AS known, len(kept) < {CAP} AS open
    FROM (SELECT t.i, t.labels, t.cycle, list_filter(w.live, lambda x: t.cycle - x.t <= {IDLE_HOURS}) AS kept FROM walk w JOIN t ON t.i = w.i + 1)))
    SELECT 'events' AS metric, labels, cycle, CAST(greatest(sum(fresh::INT) OVER (PARTITION BY labels ORDER BY i) - 1, 0) AS INTEGER) AS generation, redirected FROM walk WHERE i > 0"""


@query(_CAP_AND_EVICT)
def cap_and_evict(t: Tables) -> DataFrame:
    rows = t.obs().withColumn("cycle", cardinality.cycle_of(F.col("ts"), 3600))
    out = cardinality.cap_and_evict(rows, "cycle", CAP, IDLE_HOURS)
    return out.select("metric", prometheus_labels(F.col("labels")).alias("labels"), "cycle", "generation", "redirected")


# Deltas: each user's events as exports of a total that also falls

_LAG = "SELECT user_id, event_id, c, lag(c, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS c FROM events)"


def _exports(t: Tables) -> DataFrame:
    return t.whole().select("user_id", "event_id", F.col("v").alias("c"))


@query(f"SELECT user_id, event_id, c, c - p AS c_delta FROM ({_LAG})")
def delta_signed(t: Tables) -> DataFrame:
    return temporality.delta(_exports(t), ["c"], temporality.SIGNED, ["user_id"], "event_id")


@query(f"SELECT user_id, event_id, c, CASE WHEN c < p THEN c ELSE c - p END AS c_delta FROM ({_LAG})")
def delta_reset(t: Tables) -> DataFrame:
    return temporality.delta(_exports(t), ["c"], temporality.RESET, ["user_id"], "event_id")


@query(f"SELECT user_id, event_id, c, c - p AS c_delta FROM ({_LAG}) WHERE c > p")
def delta_saturating(t: Tables) -> DataFrame:
    return temporality.delta(_exports(t), ["c"], temporality.SATURATE, ["user_id"], "event_id")


@query(f"""WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, {_V} AS v FROM events)
    SELECT event_type, day, CAST(CASE WHEN v = 0 THEN 64 ELSE length(bin(v)) - 1 END AS INTEGER) AS pos, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1, 2, 3""")
def delta_buckets(t: Tables) -> DataFrame:
    """Totals by day, taken apart again: the deltas must be each day's own counts."""
    daily = aggregate.exponential_histogram(t.whole(), ["event_type", "day"], "v")
    cells = daily.select("event_type", "day", F.explode("positive").alias("b", "n")).unionByName(daily.select("event_type", "day", F.lit(64).alias("b"), F.col("zero_count").alias("n")))
    days = daily.select("day").distinct().withColumnRenamed("day", "d")
    total = cells.join(days, F.col("d") >= F.col("day")).groupBy("event_type", "d", "b").agg(F.sum("n").alias("n"))
    zero = F.sum(F.when(F.col("b") == 64, F.col("n")))
    grown = total.groupBy("event_type", F.col("d").alias("day")).agg(F.map_from_entries(F.collect_list(F.when(F.col("b") != 64, F.struct("b", "n")))).alias("positive"), F.coalesce(zero, F.lit(0)).cast("bigint").alias("zero_count"))
    return temporality.bucket_deltas(grown, ["event_type"], "day")


def _daily(series: DataFrame, values: list[str], by: list[str], policy: str) -> DataFrame:
    """Values by day as running totals, and their deltas: each day's own values again."""
    totals = series
    for v in values:
        totals = aggregate.running(totals, v, by, "day", v + "_total")
    names = [v + "_total" for v in values]
    out = temporality.delta(totals.select(*by, "day", *names), names, policy, by, "day")
    return out.select(*by, "day", *[F.col(n + "_delta").alias(v) for v, n in zip(values, names, strict=True)])


@query(f"""WITH {_DOMAIN}, w AS (SELECT DISTINCT {_DAY} AS day FROM events)
    SELECT d.event_type, w.day, CAST(count(e.event_id) AS BIGINT) AS "sum" FROM w CROSS JOIN d LEFT JOIN events e ON e.event_type = d.event_type AND strftime(e.ts, '%Y-%m-%d') = w.day GROUP BY 1, 2""")
def delta_labeled_counter(t: Tables) -> DataFrame:
    sums = aggregate.counter_sum(t.whole(), ["day", "event_type"], "one")
    members = aggregate.complete(sums, TYPES, "event_type", {"sum": F.lit(0).cast("bigint")}, ["day"]).drop("idx")
    return _daily(members, ["sum"], ["event_type"], temporality.SIGNED)


@query(f"SELECT user_id, event_type, {_DAY} AS day, {_TOTALS} FROM events GROUP BY 1, 2, 3")
def delta_histogram_series(t: Tables) -> DataFrame:
    hist = aggregate.histogram(t.whole(), BOUNDS, ["user_id", "event_type", "day"], "v")
    return _daily(hist, ["count", "sum"], ["user_id", "event_type"], temporality.RESET)


_TIMER_DAYS = _TIMER.replace("SELECT event_type,", f"SELECT event_type, {_DAY} AS day,").replace("GROUP BY 1", "GROUP BY 1, 2")


@query(f"SELECT event_type, day, calls, sample_count, sample_sum FROM ({_TIMER_DAYS})")
def delta_timer(t: Tables) -> DataFrame:
    rows = sampling.stride_sample(t.whole(), 8, "user_id", ("ts", "event_id"))
    return _daily(aggregate.timer(rows, BOUNDS, ["event_type", "day"], "v"), ["calls", "sample_count", "sample_sum"], ["event_type"], temporality.RESET)


@query(f"SELECT event_type, {_DAY} AS day, arg_max(value, (ts, event_id)) AS \"value\" FROM events GROUP BY 1, 2")
def delta_gauge_is_current(t: Tables) -> DataFrame:
    last = aggregate.gauge_last(t.whole(), ["event_type", "day"], "value", ("ts", "event_id"), 0.0)
    return temporality.export(last, "gauge", ["value"], ["event_type"], "day", temporality.DELTA)


# Text

_HELP = "SELECT '# HELP {0} {1}' AS line UNION ALL SELECT '# TYPE {0} {2}'"


@query(_HELP.format("shop_events", "Events", "counter") + " UNION ALL SELECT concat('shop_events{event_type=\"', event_type, '\"} ', count(*)) FROM events GROUP BY event_type")
def prometheus_counter_lines(t: Tables) -> DataFrame:
    series = aggregate.counter_sum(t.whole(), ["event_type"], "one").withColumn("labels", otel.label_attributes("event_type"))
    return exposition.prometheus_counter(series, "shop_events", help_="Events", labels="labels").select("line")


@query(_HELP.format("shop_value", "Value", "gauge") + " UNION ALL SELECT concat('shop_value{event_type=\"', event_type, '\"} ', arg_max(value, (ts, event_id))::VARCHAR) FROM events GROUP BY event_type")
def prometheus_gauge_lines(t: Tables) -> DataFrame:
    series = aggregate.gauge_last(t.events, ["event_type"], "value", ("ts", "event_id"), 0.0).withColumn("labels", otel.label_attributes("event_type"))
    return exposition.prometheus_gauge(series, "shop_value", help_="Value", labels="labels").select("line")


@query(
    _HELP.format("shop_size", "Size", "histogram")
    + f""" UNION ALL SELECT concat('shop_size_bucket{{event_type="', event_type, '",le="', coalesce(le::VARCHAR, '+Inf'), '"}} ', cumulative) FROM ({_CUM})
    UNION ALL SELECT concat('shop_size_sum{{event_type="', event_type, '"}} ', "sum") FROM (SELECT event_type, {_TOTALS} FROM events GROUP BY 1)
    UNION ALL SELECT concat('shop_size_count{{event_type="', event_type, '"}} ', "count") FROM (SELECT event_type, {_TOTALS} FROM events GROUP BY 1)"""
)
def prometheus_histogram_lines(t: Tables) -> DataFrame:
    series = aggregate.histogram(t.whole(), BOUNDS, ["event_type"], "v").withColumn("labels", otel.label_attributes("event_type"))
    return exposition.prometheus_histogram(series, "shop_size", BOUNDS, "Size", "labels").select("line")


@query(
    _HELP.format("shop_dist", "Dist", "summary")
    + f""" UNION ALL SELECT concat('shop_dist_sum{{{{', {_LABELS}, '}}}} ', "sum") FROM (SELECT user_id, event_type, {_TOTALS} FROM events GROUP BY 1, 2)
    UNION ALL SELECT concat('shop_dist_count{{{{', {_LABELS}, '}}}} ', "count") FROM (SELECT user_id, event_type, {_TOTALS} FROM events GROUP BY 1, 2)""".replace("{{", "{").replace("}}", "}")
)
def prometheus_summary_lines(t: Tables) -> DataFrame:
    series = aggregate.exponential_histogram(t.obs(value="v"), ["labels"])
    return exposition.prometheus_summary(series, "shop_dist", "Dist", "labels").select("line")


@query("SELECT concat('shop.events:', count(*), '|c|#', 'event_type:', event_type, ',user_id:', user_id, ',env:prod') AS line FROM events GROUP BY event_type, user_id")
def dogstatsd_counter_lines(t: Tables) -> DataFrame:
    series = aggregate.snapshot(t.obs(), aggregate.counter_sum)
    return exposition.dogstatsd_counter(series, "shop.events", labels="labels", tags={"env": "prod"}).select("line")


@query(
    """WITH g AS (SELECT user_id, arg_max(CASE WHEN event_id % 3 = 0 THEN floor(value) ELSE value END, (ts, event_id)) AS v FROM events GROUP BY 1)
    SELECT concat('shop.value:', CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE v::VARCHAR END, '|g|#user_id:', user_id) AS line FROM g"""
)
def dogstatsd_gauge_lines(t: Tables) -> DataFrame:
    rows = t.events.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("double")).otherwise(F.col("value")))
    series = aggregate.gauge_last(rows, ["user_id"], "value", ("ts", "event_id"), 0.0).withColumn("labels", label_map(user_id="user_id"))
    return exposition.dogstatsd_gauge(series, "shop.value", labels="labels").select("line")


@query(f"""WITH h AS (SELECT event_type, {_TOTALS} FROM events GROUP BY 1) SELECT concat('shop.size.count:', "count", '|c|#event_type:', event_type) AS line FROM h
    UNION ALL SELECT concat('shop.size.sum:', "sum", '|c|#event_type:', event_type) FROM h""")
def dogstatsd_histogram_lines(t: Tables) -> DataFrame:
    series = aggregate.histogram(t.whole(), BOUNDS, ["event_type"], "v").withColumn("labels", otel.label_attributes("event_type"))
    return exposition.dogstatsd_histogram(series, "shop.size", "labels").select("line")


@query(f"""WITH x AS ({_TIMER}) SELECT concat('shop.call.calls:', calls, '|c|#event_type:', event_type) AS line FROM x
    UNION ALL SELECT concat('shop.call.samples.count:', sample_count, '|c|#event_type:', event_type) FROM x
    UNION ALL SELECT concat('shop.call.samples.sum:', sample_sum, '|c|#event_type:', event_type) FROM x""")
def dogstatsd_timer_lines(t: Tables) -> DataFrame:
    rows = sampling.stride_sample(t.whole(), 8, "user_id", ("ts", "event_id"))
    series = aggregate.timer(rows, BOUNDS, ["event_type"], "v").withColumn("labels", otel.label_attributes("event_type"))
    return exposition.dogstatsd_timer(series, "shop.call", "labels").select("line")


@query(f"""WITH b AS (SELECT event_type, CAST(CASE WHEN {_V} = 0 THEN 0 WHEN {_BUCKET} = 0 THEN 1 ELSE 3 * (1 << ({_BUCKET} - 1)) END AS BIGINT) AS m, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT concat('shop.dist:', m, '|d', CASE WHEN n > 1 THEN concat('|@', (1.0::DOUBLE / n)::VARCHAR) ELSE '' END, '|#event_type:', event_type) AS line FROM b""")
def dogstatsd_distribution_lines(t: Tables) -> DataFrame:
    exp = aggregate.exponential_histogram(t.whole(), ["event_type"], "v")
    rows = aggregate.exponential_samples(exp, ["event_type"]).withColumn("labels", otel.label_attributes("event_type"))
    return exposition.dogstatsd_distribution(rows, "shop.dist", "labels", rate_text=numbers.sql_float_text).select("line")


SHOP = MetricSet([MetricSpec("events", "counter", "Events", dynamic=True, max_series=CAP)], "shop")


@query(f"""{_FIRST}, n AS (SELECT e.*, CASE WHEN r.rn <= {CAP} THEN concat('event_type:', e.event_type, ',user_id:', e.user_id) ELSE '__ft_overflow:true' END AS tags, CAST(floor(epoch(e.ts) / 86400) AS BIGINT) AS d FROM events e JOIN r USING (user_id, event_type)),
    s AS (SELECT tags, min(d) AS lo FROM n GROUP BY 1), spine AS (SELECT tags, unnest(range(lo, (SELECT max(d) + 1 FROM n))) AS d FROM s)
    SELECT spine.d AS "window", concat('shop.events:', count(n.event_id), '|c|#', spine.tags) AS line FROM spine LEFT JOIN n ON n.tags = spine.tags AND n.d = spine.d GROUP BY spine.d, spine.tags""")
def dogstatsd_delta_lines(t: Tables) -> DataFrame:
    rows = t.obs().withColumn("window", cardinality.cycle_of(F.col("ts"), 86400))
    return SHOP.export_dogstatsd_delta(rows, "window").select("window", "line")


_MIDPOINT = f"CAST(CASE WHEN {_V} = 0 THEN 0 WHEN {_BUCKET} = 0 THEN 1 ELSE 3 * (1 << ({_BUCKET} - 1)) END AS BIGINT)"
SIZES = MetricSet([MetricSpec("size", "distribution", "Sizes", dynamic=True, max_series=0)], "shop", rate_text=numbers.sql_float_text)


@query(f"""WITH b AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS "window", user_id, event_type, {_MIDPOINT} AS m, count(*) AS n FROM events GROUP BY 1, 2, 3, 4)
    SELECT "window", concat('shop.size:', m, '|d', CASE WHEN n > 1 THEN concat('|@', (1.0::DOUBLE / n)::VARCHAR) ELSE '' END, '|#event_type:', event_type, ',user_id:', user_id) AS line FROM b""")
def dogstatsd_distribution_delta_lines(t: Tables) -> DataFrame:
    rows = t.obs("size", "record", "v").withColumn("window", cardinality.cycle_of(F.col("ts"), 86400))
    return SIZES.export_dogstatsd_delta(rows, "window").select("window", "line")


#: A metric of each kind that the lines above leave out, fed with the same events.
KIT = MetricSet(
    [
        MetricSpec("high", "max_gauge", initial=480), MetricSpec("high_f", "max_gauge_f64"), MetricSpec("low", "min_gauge", initial=2), MetricSpec("low_f", "min_gauge_f64"), MetricSpec("last", "gauge"),
        MetricSpec("calls", "timer", bounds=BOUNDS, domain=TYPES, stride=8), MetricSpec("by_type", "gauge", domain=TYPES), MetricSpec("level", "gauge_i64", dynamic=True, max_series=0), MetricSpec("sizes", "histogram", bounds=BOUNDS, dynamic=True, max_series=0),
    ],
    "kit",
)
_GAUGES = f"""g AS (SELECT greatest(CAST(480 AS BIGINT), max({_V})) AS high, greatest(0.0::DOUBLE, max(value)) AS high_f, least(CAST(2 AS BIGINT), min({_V})) AS low, min(value) AS low_f, arg_max({_V}, (ts, event_id)) AS last FROM events),
    x AS ({_TIMER}), c AS ({_CUM.replace("FROM events,", "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 8 = 0),")}),
    t AS (SELECT d.event_type, coalesce(x.calls, 0) AS calls, coalesce(x.sample_count, 0) AS sample_count, coalesce(x.sample_sum, 0) AS sample_sum FROM d LEFT JOIN x ON x.event_type = d.event_type),
    le AS (SELECT unnest([0, 1, 2, 3, 4]) AS idx, unnest(['10', '50', '100', '500', '+Inf']) AS le),
    k AS (SELECT d.event_type, coalesce(arg_max({_V}, (e.ts, e.event_id)), 0) AS v FROM d LEFT JOIN events e ON e.event_type = d.event_type GROUP BY 1),
    l AS ({_FOLD.replace("user_id, event_id, ts, CAST", "user_id, event_type, event_id, ts, CAST").replace("PARTITION BY user_id", "PARTITION BY user_id, event_type").replace("SELECT user_id, CAST(sum", "SELECT user_id, event_type, CAST(sum").replace("FROM s GROUP BY 1", "FROM s GROUP BY 1, 2")}),
    h AS (SELECT user_id, event_type, {_TOTALS} FROM events GROUP BY 1, 2), hc AS (SELECT user_id, event_type, coalesce(le::VARCHAR, '+Inf') AS le, count(*) FILTER (WHERE le IS NULL OR floor(value) <= le) AS n FROM events, (VALUES (10), (50), (100), (500), (NULL)) AS b(le) GROUP BY 1, 2, 3)"""
_PAIR = "'event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"'"


def _kit(t: Tables) -> DataFrame:
    """The events once for each metric of the set."""
    ops = {"calls": "elapsed", "sizes": "record"}
    parts = [t.obs(s.field, ops.get(s.field, "set" if s.family == "gauge" else "observe"), "v") for s in KIT.specs]
    parts[7] = parts[7].withColumn("op", F.when(F.col("seq") % 7 == 0, "set").otherwise("add"))
    return exposition.union(*parts)


def _kit_head(name: str, kind: str, help_: str) -> str:
    return _HELP.format(f"kit_{name}", help_, kind)


@query(
    f"WITH {_DOMAIN}, {_GAUGES} "
    + " UNION ALL ".join([_kit_head(n, "gauge", n) for n in ("high", "high_f", "low", "low_f", "last", "by_type", "level")] + [f"SELECT concat('kit_{n} ', {n}::VARCHAR) AS line FROM g" for n in ("high", "high_f", "low", "low_f", "last")])
    + f""" UNION ALL SELECT concat('kit_by_type{{event_type="', event_type, '"}} ', v) FROM k UNION ALL SELECT 'kit_level{{' || {_PAIR} || '}} ' || "value" FROM l
    UNION ALL {_kit_head("calls_calls", "counter", "calls total calls")} UNION ALL SELECT concat('kit_calls_calls{{event_type="', event_type, '"}} ', calls) FROM t
    UNION ALL {_kit_head("calls_samples", "histogram", "calls sampled latency in nanoseconds")}
    UNION ALL SELECT concat('kit_calls_samples_bucket{{event_type="', d.event_type, '",le="', le.le, '"}} ', coalesce(c.cumulative, 0)) FROM d CROSS JOIN le LEFT JOIN c ON c.event_type = d.event_type AND c.idx = le.idx
    UNION ALL SELECT concat('kit_calls_samples_sum{{event_type="', event_type, '"}} ', sample_sum) FROM t UNION ALL SELECT concat('kit_calls_samples_count{{event_type="', event_type, '"}} ', sample_count) FROM t
    UNION ALL {_kit_head("sizes", "histogram", "sizes")} UNION ALL SELECT 'kit_sizes_bucket{{' || {_PAIR} || ',le="' || le || '"}} ' || n FROM hc
    UNION ALL SELECT 'kit_sizes_sum{{' || {_PAIR} || '}} ' || "sum" FROM h UNION ALL SELECT 'kit_sizes_count{{' || {_PAIR} || '}} ' || "count" FROM h""".replace("{{", "{").replace("}}", "}")
)
def metric_set_prometheus(t: Tables) -> DataFrame:
    return KIT.export_prometheus(_kit(t)).select("line")


#: Two timers that the same producers call in turn.
TIMERS = MetricSet([MetricSpec("reads", "timer", bounds=BOUNDS, stride=2), MetricSpec("writes", "timer", bounds=BOUNDS, domain=TYPES, stride=4)], "twin")


@query(f"""WITH {_DOMAIN}, c AS (SELECT user_id, ts, event_id, {_V} AS v, event_type, event_type IN ('view', 'click') AS reads, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT *, rn % CASE WHEN reads THEN 2 ELSE 4 END = 0 AS sampled FROM c), w AS (SELECT d.event_type, count(s.event_id) AS calls, count(s.event_id) FILTER (WHERE sampled) AS n, coalesce(sum(v) FILTER (WHERE sampled), 0) AS total FROM d LEFT JOIN s ON s.event_type = d.event_type AND NOT s.reads GROUP BY 1),
    r AS (SELECT count(*) AS calls, count(*) FILTER (WHERE sampled) AS n, coalesce(sum(v) FILTER (WHERE sampled), 0) AS total FROM s WHERE reads)
    SELECT 'twin.' || unnest(['reads.calls:' || calls, 'reads.samples.count:' || n, 'reads.samples.sum:' || total]) || '|c' AS line FROM r
    UNION ALL SELECT 'twin.' || unnest(['writes.calls:' || calls, 'writes.samples.count:' || n, 'writes.samples.sum:' || total]) || '|c|#event_type:' || event_type FROM w""")
def metric_set_two_timers(t: Tables) -> DataFrame:
    """Calls of a producer are one sequence, whichever timer they go to."""
    calls = t.obs("reads", "elapsed", "v").withColumn("metric", F.when(F.try_element_at("labels", F.lit("event_type")).isin("view", "click"), "reads").otherwise("writes"))
    return TIMERS.export_dogstatsd(calls).select("line")


_COMPACT_TEXT = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE {0}::VARCHAR END"


@query(
    f"WITH {_DOMAIN}, {_GAUGES} "
    + " UNION ALL ".join(f"SELECT concat('kit.{n}:', {_COMPACT_TEXT.format(n)}, '|g') AS line FROM g" for n in ("high", "high_f", "low", "low_f", "last"))
    + """ UNION ALL SELECT concat('kit.by_type:', v, '|g|#event_type:', event_type) FROM k UNION ALL SELECT concat('kit.level:', "value", '|g|#event_type:', event_type, ',user_id:', user_id) FROM l
    UNION ALL SELECT concat('kit.calls.calls:', calls, '|c|#event_type:', event_type) FROM t UNION ALL SELECT concat('kit.calls.samples.count:', sample_count, '|c|#event_type:', event_type) FROM t
    UNION ALL SELECT concat('kit.calls.samples.sum:', sample_sum, '|c|#event_type:', event_type) FROM t UNION ALL SELECT concat('kit.sizes.count:', "count", '|c|#event_type:', event_type, ',user_id:', user_id) FROM h
    UNION ALL SELECT concat('kit.sizes.sum:', "sum", '|c|#event_type:', event_type, ',user_id:', user_id) FROM h"""
)
def metric_set_dogstatsd(t: Tables) -> DataFrame:
    return KIT.export_dogstatsd(_kit(t)).select("line")


@query(f"WITH {_DOMAIN}, {_GAUGES} SELECT 'otel_metrics_gauge' AS \"table\", 5 + (SELECT count(*) FROM k) + (SELECT count(*) FROM l) AS n UNION ALL SELECT 'otel_metrics_sum', (SELECT count(*) FROM t) UNION ALL SELECT 'otel_metrics_histogram', (SELECT count(*) FROM t) + (SELECT count(*) FROM h)")
def metric_set_table_rows(t: Tables) -> DataFrame:
    return otel.total_rows(KIT.export_clickhouse(_kit(t), RESOURCE))


DYNAMIC = MetricSet([MetricSpec("hits", "counter", dynamic=True, max_series=CAP), MetricSpec("now", "gauge", dynamic=True, max_series=CAP), MetricSpec("size", "histogram", bounds=BOUNDS, dynamic=True, max_series=CAP), MetricSpec("spread", "distribution", dynamic=True, max_series=CAP)], "dyn")
_FIRST_SETS = f"WITH f AS (SELECT user_id, event_type, row_number() OVER (ORDER BY min((ts, event_id)), event_type, CAST(user_id AS VARCHAR)) AS rn FROM events GROUP BY 1, 2)"


@query(f"""{_FIRST_SETS}, e AS (SELECT CASE WHEN rn <= {CAP} THEN 'event_type=' || f.event_type || ',user_id=' || f.user_id ELSE '__ft_overflow=true' END AS attributes, {_V} AS v, ts, event_id FROM events JOIN f USING (user_id, event_type)),
    b AS (SELECT attributes, CAST(CASE WHEN v > 0 THEN length(bin(v)) - 1 END AS INTEGER) AS b, count(*) AS n FROM e GROUP BY 1, 2), lo AS (SELECT attributes, min(b) AS lo, max(b) AS hi, sum(n) FILTER (WHERE b IS NULL) AS zeros FROM b GROUP BY 1),
    x AS (SELECT attributes, string_agg(n::VARCHAR, ',' ORDER BY i) AS counts FROM (SELECT lo.attributes, i, coalesce(b.n, 0) AS n FROM (SELECT attributes, unnest(range(lo, hi + 1)) AS i FROM lo) lo LEFT JOIN b ON b.attributes = lo.attributes AND b.b = lo.i) GROUP BY 1)
    SELECT 'dyn_hits' AS "MetricName", attributes, count(*)::DOUBLE AS "Value", '' AS counts, 0.0::DOUBLE AS "Min", 0.0::DOUBLE AS "Max" FROM e GROUP BY 2
    UNION ALL SELECT 'dyn_now', attributes, arg_max(v, (ts, event_id))::DOUBLE, '', 0.0, 0.0 FROM e GROUP BY 2
    UNION ALL SELECT 'dyn_size', attributes, sum(v)::DOUBLE, {_BUCKETS.replace("floor(value)", "v")}, 0.0, 0.0 FROM e GROUP BY 2
    UNION ALL SELECT 'dyn_spread', e.attributes, sum(v)::DOUBLE, coalesce(any_value(lo.zeros), 0)::VARCHAR || ';' || coalesce(any_value(lo.lo), 0) || ';' || coalesce(any_value(x.counts), ''),
        CASE WHEN any_value(lo.zeros) > 0 THEN 0 ELSE (1::BIGINT << any_value(lo.lo)) END::DOUBLE, CASE WHEN any_value(lo.hi) IS NULL THEN 0 ELSE (1::BIGINT << (any_value(lo.hi) + 1)) - 1 END::DOUBLE FROM e JOIN lo ON lo.attributes = e.attributes LEFT JOIN x ON x.attributes = e.attributes GROUP BY 2""")
def metric_set_dynamic_rows(t: Tables) -> DataFrame:
    """The rows of the four tables for dynamic metrics with an overflow series, value by value."""
    obs = exposition.union(*[t.obs(s.field, {"counter": "add", "gauge": "set"}.get(s.family, "record"), "one" if s.family == "counter" else "v") for s in DYNAMIC.specs])
    tables, none = DYNAMIC.export_clickhouse(obs, RESOURCE), F.lit("")
    attributes = F.array_join(F.transform(series_key(F.col("Attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attributes")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    plain = [tables[n].select("MetricName", attributes, "Value", none.alias("counts"), F.lit(0.0).alias("Min"), F.lit(0.0).alias("Max")) for n in (otel.SUM, otel.GAUGE)]
    size = tables[otel.HISTOGRAM].select("MetricName", attributes, F.col("Sum").alias("Value"), text("BucketCounts").alias("counts"), "Min", "Max")
    spread = tables[otel.EXP_HISTOGRAM].select("MetricName", attributes, F.col("Sum").alias("Value"), F.concat_ws(";", F.col("ZeroCount").cast("string"), F.col("PositiveOffset").cast("string"), text("PositiveBucketCounts")).alias("counts"), "Min", "Max")
    return exposition.union(*plain, size, spread)


@query("SELECT count(DISTINCT (user_id, event_type)) AS fingerprints, count(DISTINCT (user_id, event_type)) AS label_sets, true AS either_order FROM events")
def label_fingerprints(t: Tables) -> DataFrame:
    """As many fingerprints as label sets, whatever the order of their keys."""
    e = t.events.select(label_map(event_type="event_type", user_id="user_id").alias("a"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type")).alias("b"))
    e = e.select(fingerprint(F.col("a")).alias("f"), (fingerprint(F.col("a")) == fingerprint(F.col("b"))).alias("same"), series_key(F.col("a")).alias("k"))
    return e.agg(F.count_distinct("f").alias("fingerprints"), F.count_distinct("k").alias("label_sets"), F.bool_and("same").alias("either_order"))


@query("SELECT CAST(count(*) AS BIGINT) AS traces, CAST(count(*) AS BIGINT) AS spans, CAST(count(*) AS BIGINT) AS valid FROM orders")
def random_ids(t: Tables) -> DataFrame:
    """Random ids of every order's root span: valid, and none twice."""
    ids = t.orders.select(trace_ids.random_trace_id().alias("t"), trace_ids.random_span_id().alias("s"))
    good = F.col("t").rlike("^[0-9a-f]{32}$") & F.col("s").rlike("^[0-9a-f]{16}$") & trace_ids.is_valid(F.col("t")) & trace_ids.is_valid(F.col("s"))
    return ids.agg(F.count_distinct("t").alias("traces"), F.count_distinct("s").alias("spans"), F.count_if(good).alias("valid"))


@query(f"WITH {_DOMAIN}, {_GAUGES} SELECT 'kit_' || unnest(['high', 'high_f', 'low', 'low_f', 'last']) AS \"MetricName\", '' AS attributes, unnest([high::DOUBLE, high_f, low::DOUBLE, low_f, last::DOUBLE]) AS \"Value\" FROM g UNION ALL SELECT 'kit_by_type', 'event_type=' || event_type, v::DOUBLE FROM k UNION ALL SELECT 'kit_level', 'event_type=' || event_type || ',user_id=' || user_id, \"value\"::DOUBLE FROM l")
def metric_set_otlp_gauges(t: Tables) -> DataFrame:
    """The set as OTLP JSON, read back as rows of the gauge table."""
    back = otel.rows_from_otlp(KIT.export_otlp(_kit(t), RESOURCE), RESOURCE)[otel.GAUGE]
    return _flat(back, "Value").select("MetricName", "attributes", "Value")


# OpenTelemetry rows

_OTEL = "'env=test,service.name=shop' AS resource, 'shop' AS \"ServiceName\", CAST(1700000000000000000 AS BIGINT) AS \"TimeUnixNano\", concat('event_type=', event_type) AS attributes"


def _flat(rows: DataFrame, *columns: str) -> DataFrame:
    text = lambda m: F.array_join(F.transform(series_key(F.col(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    plain = [F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",").alias(c) if dict(rows.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    return rows.select(text("ResourceAttributes").alias("resource"), "ServiceName", "TimeUnixNano", text("Attributes").alias("attributes"), "MetricName", *plain)


@query(f"SELECT {_OTEL}, 'events' AS \"MetricName\", count(*)::DOUBLE AS \"Value\", 2 AS \"AggregationTemporality\", false AS \"IsMonotonic\" FROM events GROUP BY event_type")
def otel_sum_rows(t: Tables) -> DataFrame:
    series = aggregate.counter_sum(t.whole(), ["event_type"], "one").withColumn("labels", otel.label_attributes("event_type"))
    return _flat(otel.sum_rows(series, RESOURCE, "events", labels="labels"), "Value", "AggregationTemporality", "IsMonotonic")


@query(f"SELECT {_OTEL}, 'value' AS \"MetricName\", arg_max(value, (ts, event_id)) AS \"Value\" FROM events GROUP BY event_type")
def otel_gauge_rows(t: Tables) -> DataFrame:
    series = aggregate.gauge_last(t.events, ["event_type"], "value", ("ts", "event_id"), 0.0).withColumn("labels", otel.label_attributes("event_type"))
    return _flat(otel.gauge_rows(series, RESOURCE, "value", labels="labels"), "Value")


_OTEL_HIST = f"SELECT {_OTEL}, 'size' AS \"MetricName\", CAST(count(*) AS BIGINT) AS \"Count\", sum({_V})::DOUBLE AS \"Sum\", {_BUCKETS} AS \"BucketCounts\", '10,50,100,500' AS \"ExplicitBounds\" FROM events GROUP BY event_type"


@query(_OTEL_HIST)
def otel_histogram_rows(t: Tables) -> DataFrame:
    series = aggregate.histogram(t.whole(), BOUNDS, ["event_type"], "v").withColumn("labels", otel.label_attributes("event_type"))
    return _flat(otel.histogram_rows(series, RESOURCE, "size", BOUNDS, labels="labels"), "Count", "Sum", "BucketCounts", "ExplicitBounds")


@query(_OTEL_HIST)
def otlp_json_round_trip(t: Tables) -> DataFrame:
    """A histogram as OTLP JSON and back to rows: the same table."""
    series = aggregate.histogram(t.whole(), BOUNDS, ["event_type"], "v").withColumn("labels", otel.label_attributes("event_type"))
    json = otel.metric_json(series, "histogram", "size", RESOURCE.time_unix_nano, bounds=BOUNDS, labels="labels")
    return _flat(otel.rows_from_otlp(json, RESOURCE)[otel.HISTOGRAM], "Count", "Sum", "BucketCounts", "ExplicitBounds")


@query(f"WITH x AS ({_TIMER}) SELECT {_OTEL}, 'call_calls' AS \"MetricName\", calls::DOUBLE AS \"Value\" FROM x UNION ALL SELECT {_OTEL}, 'call_samples', sample_sum::DOUBLE FROM x")
def otel_timer_rows(t: Tables) -> DataFrame:
    """The calls' values and the samples' sums."""
    rows = sampling.stride_sample(t.whole(), 8, "user_id", ("ts", "event_id"))
    series = aggregate.timer(rows, BOUNDS, ["event_type"], "v").withColumn("labels", otel.label_attributes("event_type"))
    calls, samples = otel.timer_rows(series, RESOURCE, "call", BOUNDS, labels="labels")
    return _flat(calls, "Value").unionByName(_flat(samples, "Sum").withColumnRenamed("Sum", "Value"))


@query("""SELECT event_id, concat('flag=', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',type=', event_type, ',user=', user_id, ',value=', CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE value::VARCHAR END) AS attributes,
    CASE WHEN event_id % 3 = 0 THEN user_id::DOUBLE WHEN event_id % 3 = 1 THEN value ELSE 0.0 END AS number FROM events""")
def otlp_attributes(t: Tables) -> DataFrame:
    """Typed attributes as strings: the last of a repeated key stays, what is no scalar goes."""
    kinds = {"stringValue": "string", "intValue": "string", "doubleValue": "double", "boolValue": "boolean"}
    value = lambda **kw: F.struct(*[kw.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()])
    attribute = lambda k, **kw: F.struct(F.lit(k).alias("key"), value(**kw).alias("value"))
    pairs = F.array(attribute("user", stringValue=F.lit("old")), attribute("type", stringValue=F.col("event_type")), attribute("value", doubleValue=F.col("value")), attribute("flag", boolValue=F.col("event_id") % 2 == 0), attribute("user", intValue=F.col("user_id")), attribute("list"))
    text = F.array_join(F.transform(series_key(otel.attrs_to_map(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    third = F.col("event_id") % 3
    number = numbers.number_value(F.when(third == 0, F.col("user_id")), F.when(third == 1, F.col("value")))
    return t.events.select("event_id", text.alias("attributes"), number.alias("number"))


@query(f"""WITH c AS ({_COMPACT}), s AS ({_EXP_STATS}) SELECT 'env=test,service.name=shop' AS resource, 'shop' AS "ServiceName", CAST(1700000000000000000 AS BIGINT) AS "TimeUnixNano", concat('event_type=', s.event_type) AS attributes, 'dist' AS "MetricName",
    s."count" AS "Count", s."sum"::DOUBLE AS "Sum", s.zero_count AS "ZeroCount", c."offset" AS "PositiveOffset", c.counts AS "PositiveBucketCounts", s."min"::DOUBLE AS "Min", s."max"::DOUBLE AS "Max" FROM s JOIN c USING (event_type)""")
def otel_exp_histogram_rows(t: Tables) -> DataFrame:
    series = aggregate.exponential_stats(aggregate.exponential_histogram(t.whole(), ["event_type"], "v")).withColumn("labels", otel.label_attributes("event_type"))
    return _flat(otel.exponential_rows(series, RESOURCE, "dist", labels="labels"), "Count", "Sum", "ZeroCount", "PositiveOffset", "PositiveBucketCounts", "Min", "Max")


# Larger aggregates, numbers as text, run statistics


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(CAST(floor(l_extendedprice) AS BIGINT)) AS highest, arg_max(l_discount, (l_shipdate, l_orderkey, l_linenumber)) AS last_discount
    FROM lineitem GROUP BY 1, 2""")
def order_lineitem_counters(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.max(F.floor("l_extendedprice").cast("bigint")).alias("highest"),
        F.max_by("l_discount", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("last_discount"),
    )


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::VARCHAR AS full_text, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE l_quantity::VARCHAR END AS compact_text FROM lineitem")
def float_texts(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.float_text(F.col("l_extendedprice")).alias("full_text"), numbers.compact_float_text(F.col("l_quantity")).alias("compact_text"))


@query("""WITH r AS (SELECT l_suppkey, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, CAST(count(*) AS BIGINT) AS runs, min(q) AS "min", max(q) AS "max",
    round(CASE WHEN count(*) < 2 OR avg(q) = 0 THEN 0.0 ELSE stddev_samp(q) / avg(q) * 100 END, 6) AS cv_pct,
    round(CASE WHEN count(*) < 5 THEN median(q) ELSE avg(CASE WHEN rn > floor((n - 1) / 4) AND rn <= n - floor((n - 1) / 4) THEN q END) END, 6) AS trimmed_mean FROM r GROUP BY 1""")
def run_summary(t: Tables) -> DataFrame:
    out = run_stats.summarize(t.lineitem, ["l_suppkey"], "l_quantity")
    return out.withColumns({c: F.round(c, 6) for c in ("cv_pct", "trimmed_mean")})


@query("""WITH p AS (SELECT user_id % 4 AS thread, event_id AS i FROM events)
    SELECT thread, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT thread, CASE WHEN i % 16 <> 0 THEN (i + thread) % 8 ELSE (i + thread) % 100 END AS label FROM p) GROUP BY 1, 2""")
def hotspot_profile(t: Tables) -> DataFrame:
    calls = t.events.select((F.col("user_id") % 4).alias("thread"), F.col("event_id").alias("i"))
    return with_profile(calls, "hotspot", 100).groupBy("thread", "label").agg(F.count(F.lit(1)).alias("n"))


@query()
def datagrams(t: Tables) -> DataFrame:
    """Depends on how lines are dealt to partitions: ``datagram_totals`` and the tests check what does not."""
    series = aggregate.snapshot(t.obs(), aggregate.counter_sum)
    return exposition.pack_datagrams(exposition.dogstatsd_counter(series, "shop.events", labels="labels"))


@query("""WITH l AS (SELECT concat('shop.events:', count(*), '|c|#event_type:', event_type, ',user_id:', user_id) AS line FROM events GROUP BY event_type, user_id)
    SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, true AS within_limit FROM l""")
def datagram_totals(t: Tables) -> DataFrame:
    """No line is lost or cut, and no payload is too long."""
    size, lines = F.octet_length("payload"), F.size(F.split("payload", "\n")) - 1
    return datagrams(t).agg(F.sum(lines).alias("lines"), F.sum(size).alias("bytes"), (F.max(size) <= 8000).alias("within_limit"))


# Spans


def _spans(t: Tables) -> tuple[DataFrame, DataFrame]:
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    roots = spans.root_spans(o, ["o_orderkey"], F.lit("order"), at("o_orderdate"), at("o_orderdate") + 1_000_000, "server")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").withColumnRenamed("l_orderkey", "o_orderkey")
    children = spans.child_spans(lines, roots, "o_orderkey", ["o_orderkey", "l_linenumber"], F.lit("line"), at("l_shipdate"), at("l_shipdate") + 1000, "client")
    return roots, children


@query("SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey, CAST(count(l.l_orderkey) AS BIGINT) AS children FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1")
def trace_children(t: Tables) -> DataFrame:
    roots, children = _spans(t)
    both = roots.select("trace_id", "span_id", "parent_span_id", "name").unionByName(children.select("trace_id", "span_id", "parent_span_id", "name"))
    per = spans.edges(both).groupBy("parent_span_id").agg(F.count(F.lit(1)).alias("children"))
    return per.join(roots.select("o_orderkey", F.col("span_id").alias("parent_span_id")), "parent_span_id").select("o_orderkey", "children")


@query("SELECT 0 AS depth, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 1, CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def trace_tree(t: Tables) -> DataFrame:
    roots, children = _spans(t)
    columns = ["trace_id", "span_id", "parent_span_id"]
    depths = spans.tree_depths(roots.select(*columns).unionByName(children.select(*columns)))
    return depths.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


_HEADER = "concat(CASE WHEN o_orderkey % 5 = 0 THEN '01' ELSE '00' END, '-', CASE WHEN o_orderkey % 7 = 0 THEN repeat('0', 32) ELSE md5(o_orderkey::VARCHAR) END, '-', substr(md5(o_orderkey::VARCHAR), 1, 16), '-01', CASE WHEN o_orderkey % 3 = 0 THEN '-more' ELSE '' END)"


def _header(key: Column) -> Column:
    hashed = F.md5(key.cast("string"))
    return F.concat(F.when(key % 5 == 0, "01").otherwise("00"), F.lit("-"), F.when(key % 7 == 0, "0" * 32).otherwise(hashed), F.lit("-"), F.substring(hashed, 1, 16), F.lit("-01"), F.when(key % 3 == 0, "-more").otherwise(""))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN substr(h, 4, 32) END AS trace_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN substr(h, 37, 16) END AS span_id,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN concat('00-', substr(h, 4, 32), '-', substr(h, 37, 16), '-01') ELSE '' END AS back FROM (SELECT o_orderkey, {_HEADER} AS h FROM orders)""")
def traceparent_parse(t: Tables) -> DataFrame:
    h = _header(F.col("o_orderkey"))
    p = t.orders.select("o_orderkey", trace_ids.parse_traceparent(h).alias("p"))
    return p.select("o_orderkey", F.col("p.trace_id").alias("trace_id"), F.col("p.span_id").alias("span_id"), trace_ids.to_traceparent(F.col("p.trace_id"), F.col("p.span_id")).alias("back"))


@query("SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(sum(nanos) AS BIGINT) AS nanos FROM (SELECT 'order' AS name, 1000000 AS nanos FROM orders UNION ALL SELECT 'line', 1000 FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1")
def span_durations(t: Tables) -> DataFrame:
    both = exposition.union(*[spans.duration(s).select("name", "duration_nanos") for s in _spans(t)])
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_nanos").alias("nanos"))


@query(f"""SELECT o_orderkey, CASE WHEN good THEN substr(h, 4, 32) ELSE md5(o_orderkey::VARCHAR) END AS trace_id, CASE WHEN good THEN substr(h, 37, 16) END AS parent_span_id
    FROM (SELECT o_orderkey, {_HEADER} AS h, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS good FROM orders)""")
def span_remote_parents(t: Tables) -> DataFrame:
    """A valid header is adopted; under an invalid one the span is a root."""
    key = F.col("o_orderkey")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    return spans.root_spans(t.orders, ["o_orderkey"], F.lit("order"), at, at + 1000, traceparent=_header(key)).select("o_orderkey", "trace_id", "parent_span_id")


@query("SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'unset' END AS code, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE '' END AS message, 'priority,priority' AS keys, max(o_orderpriority) AS highest, CAST(count(*) AS BIGINT) AS events FROM orders GROUP BY 1")
def span_fields(t: Tables) -> DataFrame:
    """A status, a key that is set twice and stays so, and an event of each root."""
    roots, _ = _spans(t)
    state = F.col("o_orderstatus")
    twice = spans.set_attribute(spans.set_attribute(F.col("attributes"), "priority", F.lit("none"), "string"), "priority", F.col("o_orderpriority"), "string")
    roots = roots.join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").withColumn("attributes", twice).withColumn("events", spans.add_event(F.col("events"), F.lit("seen"), F.col("start_unix_nano")))
    roots = roots.withColumn("status", spans.status(F.when(state == "F", "ok").when(state == "O", "error").otherwise("unset"), F.when(state == "O", "open")))
    keys = F.array_join(F.transform("attributes", lambda a: a["key"]), ",").alias("keys")
    return roots.groupBy("o_orderstatus", F.col("status.code").alias("code"), F.col("status.message").alias("message"), keys).agg(F.max(F.element_at("attributes", -1)["value"]["s"]).alias("highest"), F.sum(F.size("events")).alias("events"))


_SPAN_MINUTES = "CASE WHEN event_id % 10 = 0 THEN 1440 ELSE event_id % 50 END"


@query(f"""WITH s AS (SELECT event_id, user_id, ts, epoch_us(ts) AS a, epoch_us(ts) + {_SPAN_MINUTES} * 60000000 AS b FROM events)
    SELECT l.event_id, arg_max(s.event_id, (s.ts, s.event_id)) AS span_event FROM s AS l LEFT JOIN s ON s.user_id = l.user_id AND l.a - 1 BETWEEN s.a AND s.b GROUP BY 1""")
def span_current(t: Tables) -> DataFrame:
    """The innermost span that is open on a log's thread just before its time; spans last from no time to a day."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.events.select("event_id", F.col("user_id").alias("producer"), ((micros - 1) * 1000).alias("time_unix_nano"))
    opened = t.events.select(F.col("user_id").alias("producer"), F.lit("t").alias("trace_id"), F.col("event_id").alias("span_id"), (micros * 1000).alias("start_unix_nano"), (micros * 1000 + F.expr(_SPAN_MINUTES) * 60_000_000_000).alias("end_unix_nano"))
    return spans.current_spans(e, opened).select("event_id", F.col("span_id").alias("span_event"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER w AS rn, sum(CASE WHEN event_type = 'error' AND event_id % 40 = 0 THEN 1 ELSE 0 END) OVER w AS stretch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id, stretch ORDER BY rn) - 1 AS below, first_value(event_id) OVER (PARTITION BY user_id, stretch ORDER BY rn) AS top FROM r)
    SELECT event_id, CASE WHEN user_id % 10 = 0 AND stretch = 0 THEN NULL ELSE CAST(below AS BIGINT) END AS depth, CASE WHEN user_id % 10 = 0 AND stretch = 0 THEN NULL ELSE CAST(top AS VARCHAR) END AS root FROM g""")
def span_chains(t: Tables) -> DataFrame:
    """Every event is a span under its user's event before; some have a parent that is missing, and the first event of
    every tenth user is under the user's last, which makes a cycle of what no missing parent cuts off."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last("event_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = (F.col("event_type") == "error") & (F.col("event_id") % 40 == 0)
    chain = t.events.select("user_id", "event_id", "ts", cut.alias("cut"), F.lag("event_id").over(w).alias("before"), last.alias("last"))
    # The last event of the first stretch: the cycle closes within it.
    stretch = F.sum(F.col("cut").cast("int")).over(w)
    end = F.max_by("event_id", F.struct("ts", "event_id")).over(Window.partitionBy("user_id", "stretch"))
    chain = chain.withColumn("stretch", stretch).withColumn("end", end)
    parent = F.when(F.col("cut"), F.lit(-1)).when(F.col("before").isNull() & (F.col("user_id") % 10 == 0), F.col("end")).otherwise(F.col("before"))
    known = chain.select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), parent.cast("string").alias("parent_span_id"))
    out = spans.tree_depths(known)
    return out.select(F.col("span_id").cast("bigint").alias("event_id"), F.col("depth").cast("bigint").alias("depth"), F.col("root_span_id").alias("root"))


@query("SELECT 'order' AS name, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'line', CAST(count(*) AS BIGINT) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 = 0")
def span_recorded_traces(t: Tables) -> DataFrame:
    """Children of roots that were sampled out are none either."""
    roots, children = _spans(t)
    columns = ["trace_id", "span_id", "parent_span_id", "name"]
    both = roots.select(*columns, (F.col("o_orderkey") % 3 == 0).alias("recorded")).unionByName(children.select(*columns, F.lit(True).alias("recorded")))
    return spans.keep_recorded(both).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT md5(o_orderkey::VARCHAR) AS trace_id, substr(md5(concat('span', chr(31), o_orderkey)), 1, 16) AS span_id,
    concat('{"traceId":"', md5(o_orderkey::VARCHAR), '","spanId":"', substr(md5(concat('span', chr(31), o_orderkey)), 1, 16), '","parentSpanId":"","name":"order","kind":2,"startTimeUnixNano":"', epoch_us(o_orderdate) * 1000,
    '","endTimeUnixNano":"', epoch_us(o_orderdate) * 1000 + 1000000, '","attributes":[{"key":"status","value":{"stringValue":"', o_orderstatus, '"}}],"events":[]}') AS json FROM orders""")
def span_otlp_json(t: Tables) -> DataFrame:
    roots, _ = _spans(t)
    named = roots.withColumn("attributes", spans.set_attribute(F.col("attributes"), "status", F.col("o_orderstatus"), "string"))
    return spans.to_otlp(named)


_ADAPTIVE = """WITH r AS (SELECT o_orderkey, o_custkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 7 END AS INTEGER) AS shift, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    SELECT CAST(count(*) FILTER (WHERE shift = 0 OR rn % (1 << shift) = 0) AS BIGINT) AS recorded_count, CAST(count(*) FILTER (WHERE NOT (shift = 0 OR rn % (1 << shift) = 0)) AS BIGINT) AS sampled_out_count FROM r"""


@query(_ADAPTIVE)
def adaptive_span_sampling(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("occupancy", F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.6, 0.9)]), (F.col("o_orderkey") % 4 + 1).cast("int"))).withColumn("producer", F.col("o_custkey") % 3)
    marked = sampling.adaptive_sample(rows, "occupancy", "producer", ("o_orderdate", "o_orderkey")).withColumn("parent_span_id", F.lit(None).cast("string"))
    return spans.counters(marked).select("recorded_count", "sampled_out_count")


@query(f"""WITH e AS (SELECT user_id, event_type, event_id, CAST(floor(value) AS BIGINT) AS v FROM events), c AS (SELECT 'counter' AS kind, user_id, event_id, v AS a, v % 7 AS b FROM e UNION ALL SELECT 'histogram', user_id, event_id, v, v % 7 FROM e UNION ALL SELECT 'distribution', user_id, event_id, v, v % 7 FROM e),
    p AS (SELECT *, lag(a, 1, 0) OVER w AS pa, lag(b, 1, 0) OVER w AS pb FROM c WINDOW w AS (PARTITION BY kind, user_id ORDER BY event_id)),
    d AS (SELECT kind, user_id, event_id, CASE kind WHEN 'counter' THEN a - pa WHEN 'histogram' THEN CASE WHEN a < pa THEN a ELSE a - pa END ELSE greatest(a - pa, 0) END AS da, CASE kind WHEN 'counter' THEN b - pb WHEN 'histogram' THEN CASE WHEN b < pb THEN b ELSE b - pb END ELSE greatest(b - pb, 0) END AS db FROM p)
    SELECT kind, CAST(user_id AS VARCHAR) AS series, event_id, concat(da, ',', db) AS deltas FROM d WHERE kind <> 'distribution' OR da > 0 OR db > 0""")
def delta_arrays(t: Tables) -> DataFrame:
    """Exports whose totals are arrays, of three kinds, each under its policy."""
    v = F.floor("value").cast("bigint")
    rows = t.events.select("user_id", "event_id", F.array(v, v % 7).alias("totals"), F.explode(F.array(*[F.lit(k) for k in ("counter", "histogram", "distribution")])).alias("kind"))
    out = temporality.array_deltas(rows.withColumn("series", F.col("user_id").cast("string")), ["series"], order="event_id")
    return out.select("kind", "series", "event_id", F.array_join(F.transform("deltas", lambda d: d.cast("string")), ",").alias("deltas"))


@query("SELECT CAST(count(*) AS BIGINT) AS points, true AS within_limit, true AS several FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2)")
def otlp_requests(t: Tables) -> DataFrame:
    """Every series once, in requests of bounded size."""
    sets = MetricSet([MetricSpec("events", "counter", dynamic=True, max_series=0)], "shop", rate_text=numbers.sql_float_text)
    requests = sets.export_otlp_requests(t.obs(), RESOURCE, 4000)
    return requests.agg(F.sum("n_points").alias("points"), (F.max(F.octet_length("json")) <= 4000).alias("within_limit"), (F.count(F.lit(1)) > 1).alias("several"))


@query("SELECT CAST(count(*) AS BIGINT) AS points, true AS within_limit, true AS several FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2)")
def otlp_protobuf_requests(t: Tables) -> DataFrame:
    """The same in Protocol Buffers."""
    sets = MetricSet([MetricSpec("events", "counter", dynamic=True, max_series=0)], "shop", rate_text=numbers.sql_float_text)
    requests = sets.export_otlp_protobuf(t.obs(), RESOURCE, 4000)
    return requests.agg(F.sum("n_points").alias("points"), (F.max(F.octet_length("body")) <= 4000).alias("within_limit"), (F.count(F.lit(1)) > 1).alias("several"))


@query("""WITH s AS (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS begun FROM orders), h AS (SELECT *, lower(hex(begun)) AS a, lower(hex(begun + 1000000)) AS b FROM s),
    p AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS trace_id, substr(md5(concat('span', chr(31), o_orderkey)), 1, 16) AS span_id, repeat('0', 16 - length(a)) || a AS a, repeat('0', 16 - length(b)) || b AS b FROM h)
    SELECT trace_id, span_id, '0a10' || trace_id || '1208' || span_id || '2a056f72646572' || '3002' || '39' || array_to_string(list_transform(range(7, -1, -1), lambda i: substr(a, 2 * i + 1, 2)), '') || '41' || array_to_string(list_transform(range(7, -1, -1), lambda i: substr(b, 2 * i + 1, 2)), '') AS span FROM p""")
def span_protobuf(t: Tables) -> DataFrame:
    """The bytes of every root span's message, in hexadecimal."""
    roots, _ = _spans(t)
    return otlp_proto.span_messages(roots).select("trace_id", "span_id", F.lower(F.hex("span")).alias("span"))


@query("SELECT event_type, part, CAST(n AS BIGINT) AS n FROM (SELECT event_type, unnest(['all', 'half']) AS part, unnest([count(*), count(*) // 2]) AS n FROM events GROUP BY 1) WHERE n % 3 <> 0")
def translated_rows(t: Tables) -> DataFrame:
    """A translator of one's own: two rows, one or none for a series, by a table function."""

    def rows_of(row):
        for part, n in (("all", row["sum"]), ("half", row["sum"] // 2)):
            if n % 3:
                yield row["event_type"], part, n

    translate.register(t.spark, "two_parts", rows_of, "event_type string, part string, n bigint")
    return translate.translate(aggregate.counter_sum(t.whole(), ["event_type"], "one"), "two_parts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
