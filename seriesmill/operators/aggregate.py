"""Reads of metrics as aggregations of observation rows.

An observation has ``metric, op, labels, value_l, value_d, ts, seq, producer``;
every operator here takes the columns it needs by name, groups by any columns
(none for one global row), and leaves partial aggregation to Spark.  The order of
observations is ``(ts, seq)``: the last one wins where only one can.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.functions import numbers
from seriesmill.functions.labels import LabelDomain, series_key

Keys = Sequence[str]


def _group(obs: DataFrame, by: Keys, *aggs: Column) -> DataFrame:
    return obs.groupBy(*by).agg(*aggs)


def counter_sum(obs: DataFrame, by: Keys = (), value: str = "value_l", name: str = "sum") -> DataFrame:
    """Signed sum of deltas; 0 without any.  Overflow raises (ANSI)."""
    return _group(obs, by, F.coalesce(F.sum(value), F.lit(0).cast("bigint")).alias(name))


def counter_swap(obs: DataFrame, window: Column, by: Keys = (), value: str = "value_l") -> DataFrame:
    """The sum of each window on its own, as a counter that is zeroed at every read."""
    return counter_sum(obs.withColumn("window", window), ["window", *by], value)


def gauge_last(obs: DataFrame, by: Keys = (), value: str = "value_d", order: Keys = ("ts", "seq"), initial: float | int = 0, name: str = "value") -> DataFrame:
    """The last value set, or the initial one."""
    return _group(obs, by, F.coalesce(F.max_by(value, F.struct(*order)), F.lit(initial)).alias(name))


def extrema(obs: DataFrame, by: Keys = (), value: str = "value_l", max_initial: float | int | None = 0, min_initial: float | int | None = None, names: tuple[str, str] = ("max", "min")) -> DataFrame:
    """Largest and least value with the initial ones; NaN is never observed.

    The least starts at the largest long, or at infinity for doubles.
    """
    double = dict(obs.dtypes)[value] in ("double", "float")
    seen = F.when(~F.isnan(value), F.col(value)) if double else F.col(value)
    kind = "double" if double else "bigint"
    low = (float("inf") if double else numbers.LONG_MAX) if min_initial is None else min_initial
    high = F.greatest(F.lit(max_initial).cast(kind), F.max(seen)).alias(names[0])
    return _group(obs, by, high, F.least(F.lit(low).cast(kind), F.min(seen)).alias(names[1]))


def extrema_reset(obs: DataFrame, windows: DataFrame, window: str, by: Keys = (), **kw) -> DataFrame:
    """Extrema of each window alone; a window without rows has the initial values.

    ``windows``: one row for every window (and key) to report.
    """
    value = kw.get("value", "value_l")
    keyed = windows.join(obs.select(window, *by, value), [window, *by], "left")
    return extrema(keyed, [window, *by], **kw)


def set_add_fold(obs: DataFrame, by: Keys = (), op: str = "op", value: str = "value_l", order: Keys = ("ts", "seq"), name: str = "value") -> DataFrame:
    """A gauge that is both set and added to: the last set and all later adds.

    Two aggregations and a join on the keys: two scans, and a hot series needs no sort.
    """
    maps = [k for k in by if dict(obs.dtypes)[k].startswith("map")]
    obs = obs.withColumns({k: series_key(F.col(k)) for k in maps})  # maps cannot be joined on
    at = F.struct(*order)
    last = obs.where(F.col(op) == "set").groupBy(*by).agg(F.max(at).alias("_at"), F.max_by(value, at).alias("_base"))
    later = obs.where(F.col(op) != "set").withColumn("_order", at)
    if by:
        later = later.join(last, list(by), "left").where(F.col("_at").isNull() | (F.col("_order") > F.col("_at")))
        adds = later.groupBy(*by).agg(F.sum(value).alias("_adds"))
        # A series without later adds has a set, one without a set has adds.
        out = last.join(adds, list(by), "full")
    else:  # one row of state: a scalar subquery, not a join
        top = last.select("_at").scalar()
        adds = later.where(top.isNull() | (F.col("_order") > top)).agg(F.sum(value).alias("_adds"))
        out = last.select("_base", adds.scalar().alias("_adds"))
    out = out.withColumns({k: F.map_from_entries(k) for k in maps})
    return out.select(*by, (F.coalesce("_base", F.lit(0)) + F.coalesce("_adds", F.lit(0))).cast("bigint").alias(name))


def histogram(obs: DataFrame, bounds: Sequence[int], by: Keys = (), value: str = "value_l") -> DataFrame:
    """``counts`` per bucket (one more than bounds; a bound belongs to its bucket), ``count``, ``sum``."""
    v = F.col(value)
    return _group(obs, by, numbers.bucket_counts(v, bounds).alias("counts"), F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias("sum"))


def histogram_cumulative(hist: DataFrame, bounds: Sequence[int], by: Keys = ()) -> DataFrame:
    """A row ``(idx, le, cumulative)`` for each bound and a last one with a null ``le``."""
    le = F.array(*[F.lit(b).cast("bigint") for b in bounds], F.lit(None).cast("bigint"))
    zipped = F.arrays_zip(le.alias("le"), numbers.cumulative(F.col("counts")).alias("cumulative"))
    return hist.select(*by, F.posexplode(zipped).alias("idx", "b")).select(*by, "idx", "b.le", "b.cumulative")


def exponential_histogram(obs: DataFrame, by: Keys = (), value: str = "value_l") -> DataFrame:
    """``count, sum, zero_count, positive``: a sparse map from floor(log2 v) to count.

    At most 64 rows a series and task are shuffled.  Negative values are an error.
    """
    v = F.when(F.col(value) < 0, F.raise_error(F.lit("a distribution takes no negative value")).cast("bigint")).otherwise(F.col(value))
    cells = obs.withColumn("_v", v).where("_v is not null").withColumn("_b", numbers.bucket_index(F.col("_v")))
    cells = cells.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    entry = F.when(F.col("_b").isNotNull(), F.struct("_b", "_n"))
    return cells.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.sum("_s"), F.lit(0)).cast("bigint").alias("sum"),
        F.coalesce(F.sum(F.when(F.col("_b").isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias("zero_count"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("positive"),
    )


def exponential_stats(exp: DataFrame) -> DataFrame:
    """Adds ``mean`` and the approximate ``min`` and ``max``; null for an empty series.

    The least is 0 with any zero, else the low end of the lowest bucket; the
    largest is the high end of the highest bucket.
    """
    keys = F.map_keys("positive")
    low = F.when(F.col("zero_count") > 0, F.lit(0).cast("bigint")).otherwise(numbers.bucket_low(F.array_min(keys)))
    high = F.coalesce(numbers.bucket_high(F.array_max(keys)), F.when(F.col("zero_count") > 0, F.lit(0).cast("bigint")))
    return exp.withColumn("mean", F.try_divide("sum", "count")).withColumn("min", low).withColumn("max", high)


def exponential_samples(exp: DataFrame, by: Keys = ()) -> DataFrame:
    """A row ``(pos, midpoint, n)`` for each non-empty bucket: zeros first, then rising."""
    zero = F.when(F.col("zero_count") > 0, F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("bigint").alias("midpoint"), F.col("zero_count").alias("n")))).otherwise(F.array())
    rest = F.transform(F.array_sort(F.map_entries("positive")), lambda e: F.struct(e["key"].alias("pos"), numbers.bucket_midpoint(e["key"]).alias("midpoint"), e["value"].alias("n")))
    return exp.select(*by, F.inline(F.filter(F.concat(zero, rest), lambda x: x["n"] > 0)))


def timer(obs: DataFrame, bounds: Sequence[int] = numbers.LATENCY_BOUNDS_NS, by: Keys = (), value: str = "value_l", sampled: str = "sampled") -> DataFrame:
    """``calls``, and of the sampled ones ``counts, sample_count, sample_sum, sample_avg``."""
    v = F.when(F.col(sampled), F.col(value))
    out = _group(obs, by, F.count(F.lit(1)).alias("calls"), numbers.bucket_counts(v, bounds).alias("counts"), F.count(v).alias("sample_count"), F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias("sample_sum"))
    return out.withColumn("sample_avg", F.try_divide("sample_sum", "sample_count"))


def elapsed_nanos(start: Column, end: Column) -> Column:
    """Nanoseconds of a guard from its start and end, 0 if the clock went back."""
    return F.greatest(end - start, F.lit(0)).cast("bigint")


def complete(series: DataFrame, domain: LabelDomain, label: str, fill: dict[str, Column], by: Keys = ()) -> DataFrame:
    """A row for every member of a closed domain in its order, absent ones filled; with ``by``,
    such as an export window, for every member in each of its groups.

    Both sides have at most as many rows as the domain has members (and groups).
    """
    if by:
        each = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(v).alias(label)) for i, v in enumerate(domain.values)])
        members = series.select(*by).distinct().select(*by, F.inline(each))
    else:
        members = domain.frame(series.sparkSession).withColumnRenamed("value", label)
    joined = members.join(series, [*by, label], "left")
    filled = [F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in series.columns if c not in (*by, label)]
    return joined.select(*by, "idx", label, *filled)


def into_domain(obs: DataFrame, domain: LabelDomain, label: str) -> DataFrame:
    """Labels outside the domain become its last member."""
    return obs.withColumn(label, F.when(F.col(label).isin(*domain.values), F.col(label)).otherwise(F.lit(domain.values[-1])))


def snapshot(obs: DataFrame, read, labels: str = "labels", **kw) -> DataFrame:
    """One row for each live series: ``read`` grouped by the canonical label set."""
    return read(obs, by=[labels], **kw)


def point_read(series: DataFrame, labels: Column, want: dict[str, str], fill: dict[str, Column]) -> DataFrame:
    """The series of exactly these labels, one row; filled if there is none."""
    exact = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(want.items())]) if want else F.array().cast("array<struct<key:string,value:string>>")
    found = series.where(series_key(labels) == exact)
    return found.agg(*[F.coalesce(F.first(c), default).alias(c) for c, default in fill.items()])


def sum_all(series: DataFrame, value: str = "sum") -> DataFrame:
    return series.agg(F.coalesce(F.sum(value), F.lit(0).cast("bigint")).alias("sum_all"))


def cardinality(obs: DataFrame, labels: str = "labels", by: Keys = ()) -> DataFrame:
    """Exact number of live series, the overflow series included."""
    return obs.select(*by, series_key(F.col(labels)).alias("_k")).groupBy(*by).agg(F.count_distinct("_k").alias("cardinality"))


def running(series: DataFrame, value: str, by: Keys, order: str, name: str) -> DataFrame:
    """Running totals over windows: the cumulative temporality of per-window sums."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(name, F.sum(value).over(w))
