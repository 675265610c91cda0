"""Delta temporality: what a series gained since the last export.

Input rows are cumulative, one for each series and export; what the series kept
of its last export is ``lag`` over its exports.  There are three policies for a
fall of the total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.functions.labels import series_key

#: Counters: the plain difference, negative after a reset.
SIGNED = "signed"
#: Histograms and timers: after a fall, all of the current total is new.
RESET = "reset"
#: Distributions: a fall counts as zero.
SATURATE = "saturate"

CUMULATIVE, DELTA = "cumulative", "delta"

#: The policy of each kind of metric; gauges and extrema have no delta.
POLICIES = {"counter": SIGNED, "histogram": RESET, "timer": RESET, "distribution": SATURATE}


def difference(current: Column, previous: Column, policy: str) -> Column:
    previous = F.coalesce(previous, F.lit(0))
    if policy == SIGNED:
        return current - previous
    if policy == RESET:
        return F.when(current < previous, current).otherwise(current - previous)
    if policy == SATURATE:
        return F.greatest(current - previous, F.lit(0))
    raise ValueError(f"no such policy: {policy}")


def delta(cumulative: DataFrame, values: Sequence[str], policy: str, by: Sequence[str], order: str, suffix: str = "_delta") -> DataFrame:
    """Adds the delta of each value.  A series' first export is all new.

    Saturating rows whose deltas are all 0 are left out; the other policies keep them.
    """
    w = Window.partitionBy(*by).orderBy(order)
    out = cumulative.withColumns({v + suffix: difference(F.col(v), F.lag(v).over(w), policy) for v in values})
    if policy == SATURATE:
        out = out.where(F.greatest(*[F.col(v + suffix) for v in values], F.lit(0)) > 0)
    return out


def array_deltas(cumulative: DataFrame, by: Sequence[str] = ("metric", "series"), kind: str = "kind", order: str = "ts", totals: str = "totals", ttl_seconds: int | None = None) -> DataFrame:
    """``(*by, kind, order, deltas)``: exports whose totals are an array, each kind under its policy.

    A series that was not exported for more than ``ttl_seconds`` is new again.  Distributions without news are left out.
    ``streaming.state.deltas`` is the same over a stream.
    """
    w = Window.partitionBy(*by, kind).orderBy(order)
    before = F.lag(totals).over(w)
    if ttl_seconds is not None:
        before = F.when(F.unix_millis(order) - F.lag(F.unix_millis(order)).over(w) <= ttl_seconds * 1000, before)
    rows = cumulative.withColumn("_before", F.coalesce(before, F.array().cast(cumulative.schema[totals].dataType)))
    each = lambda policy: F.transform(totals, lambda c, i: difference(c, F.get(F.col("_before"), i), policy))
    of_kind = F.lit(None)
    for name, policy in POLICIES.items():
        of_kind = F.when(F.col(kind) == name, each(policy)).otherwise(of_kind)
    out = rows.select(*by, kind, order, of_kind.alias("deltas"))
    return out.where(~F.col(kind).isin([k for k, p in POLICIES.items() if p == SATURATE]) | F.exists("deltas", lambda d: d != 0))


def bucket_deltas(cumulative: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Deltas of exponential histograms by bucket: ``(*by, order, pos, n)`` with n > 0.

    ``pos`` 0 to 62 are the buckets in rising order and 64 is the zero count, which comes last.
    """
    cells = F.concat(
        F.transform(F.map_entries("positive"), lambda e: F.struct(e["key"].cast("int").alias("pos"), e["value"].alias("total"))),
        F.array(F.struct(F.lit(64).alias("pos"), F.col("zero_count").alias("total"))),
    )
    rows = cumulative.select(*by, order, F.inline(cells))
    return delta(rows, ["total"], SATURATE, [*by, "pos"], order, "_n").select(*by, order, "pos", F.col("total_n").alias("n"))


def export(cumulative: DataFrame, kind: str, values: Sequence[str], by: Sequence[str], order: str, temporality: str = CUMULATIVE) -> DataFrame:
    """The values as they are, or their deltas under the kind's policy, by the same names."""
    if temporality == CUMULATIVE or kind not in POLICIES:
        return cumulative
    out = delta(cumulative, values, POLICIES[kind], by, order)
    return out.drop(*values).withColumnsRenamed({v + "_delta": v for v in values})


def zero_fill(series: DataFrame, labels: str | None, window: str, span: DataFrame, fill: dict[str, Column], members: DataFrame | None = None) -> DataFrame:
    """A row for every window of a series from its first to the last of all, absent ones filled.

    ``span``: one row ``(first, last)`` of all windows.  ``members``: label sets of a closed
    domain, which are there from the first window on.
    """
    key = series_key(F.col(labels)) if labels else F.lit(0)
    keyed = series.withColumn("_k", key)
    begins = keyed.groupBy("_k").agg(F.min(window).alias("_from"))
    if members is not None:
        begins = begins.unionByName(members.select(key.alias("_k"), span.select("first").scalar().alias("_from"))).groupBy("_k").agg(F.min("_from").alias("_from"))
    spine = begins.where("_from is not null").select("_k", F.explode(F.sequence(F.col("_from"), span.select("last").scalar())).alias(window))
    joined = spine.join(keyed.drop(labels) if labels else keyed, ["_k", window], "left")
    out = joined.select("_k", window, *[F.coalesce(c, f).alias(c) for c, f in fill.items()])
    return (out.withColumn(labels, F.map_from_entries("_k")) if labels else out).drop("_k")
