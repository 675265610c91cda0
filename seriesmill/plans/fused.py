"""All metrics of a set from one pass over the observations.

1. Observations are grouped by metric, series and cell (the bucket of a histogram,
   distribution or timer) with every kind's partial state, before the shuffle as after it.  Two kinds
   need single rows, which go along as they are: timers that are sampled by
   stride, and gauges that are both set and added to.
2. What is left is kept by Spark's cache, so the observations are not read again.  On it,
   timers are sampled over all timers of a producer in one sequence, label sets are
   capped by their first observation, and sets and adds are folded.
3. States of one series are merged; closed domains and unlabeled metrics have a state
   of zero to begin with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.functions import numbers
from seriesmill.functions.labels import overflow_labels, series_key
from seriesmill.operators import aggregate
from seriesmill.operators.ranks import running_sums
from seriesmill.operators.sampling import stride_mask

#: Label sets of a metric are ranked in so many slices first; only the first ones of a slice are ranked together.
CAP_SLICES = 256
#: A timer call that belongs to no metric of the set: it only counts in its producer's sequence.
_NO_METRIC = -1
_ENTRIES = "array<struct<key:string,value:string>>"


def _of(specs: Sequence, test) -> list[int]:
    return [i for i, s in enumerate(specs) if test(s)]


def _is(k: Column, numbers_: list[int]) -> Column:
    return k.isin(numbers_) if numbers_ else F.lit(False)


def _labels(specs: Sequence) -> Column:
    """The entries of the series' label set: of dynamic metrics all, of a closed domain one, else none."""
    out = F.when(_is(F.col("_k"), _of(specs, lambda s: s.dynamic)), series_key(F.col("labels")))
    for i, s in enumerate(specs):
        if s.domain:
            label = F.try_element_at("labels", F.lit(s.domain.label_name))
            value = F.when(label.isin(*s.domain.values), label).otherwise(F.lit(s.domain.values[-1]))
            out = out.when(F.col("_k") == i, F.array(F.struct(F.lit(s.domain.label_name).alias("key"), value.alias("value"))))
    return out.otherwise(F.array().cast(_ENTRIES))


def _cell(specs: Sequence) -> Column:
    """The bucket: by a metric's own bounds, or the power of two, -1 for zero."""
    v, out = F.col("value_l"), F.when(F.lit(False), 0)
    by_bounds: dict[tuple, list[int]] = {}
    for i in _of(specs, lambda s: s.family in ("histogram", "timer")):
        by_bounds.setdefault(tuple(specs[i].bounds), []).append(i)
    for bounds, which in by_bounds.items():
        out = out.when(_is(F.col("_k"), which), F.when(v.isNotNull(), numbers.first_bucket(v, bounds)))
    power = F.when(v < 0, F.raise_error(F.lit("a distribution takes no negative value")).cast("int")).otherwise(F.coalesce(numbers.bucket_index(v), F.lit(-1)))
    return out.when(_is(F.col("_k"), _of(specs, lambda s: s.kind == "distribution")), power).cast("int")


def _states(specs: Sequence) -> dict[str, tuple[Column, Column]]:
    """What is kept of a group: how it starts from observations, and how two are merged.  Only what the set's kinds need."""
    at, kinds = F.struct("ts", "seq"), {s.kind for s in specs}
    number = F.when(~F.isnan("value_d"), F.col("value_d"))
    out = {
        "n": (F.count(F.lit(1)), F.sum("n")), "n_values": (F.count("value_l"), F.sum("n_values")),
        "sum_l": (F.sum(F.when(~_is(F.col("_k"), _of(specs, lambda s: s.family == "gauge")), F.col("value_l"))), F.sum("sum_l")),
    }
    if kinds & {"gauge", "gauge_f64"}:
        out["at"] = (F.max(at), F.max("at"))
    if "gauge" in kinds:
        out["last_l"] = (F.max_by("value_l", at), F.max_by("last_l", "at"))
    if "gauge_f64" in kinds:
        out["last_d"] = (F.max_by("value_d", at), F.max_by("last_d", "at"))
    for name, kind, f, value in (("max_l", "max_gauge", F.max, F.col("value_l")), ("min_l", "min_gauge", F.min, F.col("value_l")), ("max_d", "max_gauge_f64", F.max, number), ("min_d", "min_gauge_f64", F.min, number)):
        if kind in kinds:
            out[name] = (f(value), f(name))
    return out


def _admitted(rows: DataFrame, specs: Sequence, capped: list[int]) -> DataFrame:
    """``(_k, _series, _admitted)``: of each capped metric the label sets that come first, no more than its cap.

    A set beyond the cap in its slice is beyond it at all, so no task ranks all of a metric's sets.
    """
    most = F.element_at(F.create_map(*[F.lit(x) for i in capped for x in (i, specs[i].max_series)]), F.col("_k"))
    first = rows.where(_is(F.col("_k"), capped)).groupBy("_k", "_series").agg(F.min("first").alias("first"))
    in_slice = Window.partitionBy("_k", F.pmod(F.xxhash64("_series"), F.lit(CAP_SLICES))).orderBy("first", "_series")
    first = first.withColumn("_r", F.row_number().over(in_slice)).where(F.col("_r") <= most)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("first", "_series"))).where(F.col("_r") <= most)
    return first.select("_k", "_series", F.lit(True).alias("_admitted"))


def fuse(obs: DataFrame, specs: Sequence, by: Sequence[str], held: list[DataFrame]) -> DataFrame:
    """``(metric_order, *by, labels, states...)``: a row for each series of every metric, kept by Spark's cache.

    ``held`` takes what is kept on the way.
    """
    strided = _of(specs, lambda s: s.kind == "timer" and stride_mask(s.stride))
    folded, capped = _of(specs, lambda s: s.kind == "gauge_i64"), _of(specs, lambda s: s.dynamic and s.max_series)
    fields = [s.field for s in specs]
    wanted = F.col("metric").isin(fields)
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f, i)]), F.col("metric")), F.lit(_NO_METRIC))
    rows = obs.where(wanted | (F.col("op") == "elapsed") if strided else wanted).withColumn("_k", number)
    k = F.col("_k")
    rows = rows.where(~(_is(k, _of(specs, lambda s: s.kind == "distribution")) & F.col("value_l").isNull()))
    # Rows of these kinds stay apart.
    calls, steps = _is(k, [*strided, _NO_METRIC]), _is(k, folded)
    alone = {"r_producer": F.when(calls, F.col("producer")), "r_ts": F.when(calls | steps, F.col("ts")), "r_seq": F.when(calls | steps, F.col("seq")), "r_op": F.when(steps, F.col("op")), "r_value": F.when(calls | steps, F.col("value_l"))}
    rows = rows.withColumns({"_series": _labels(specs), "_cell": _cell(specs), **(alone if strided or folded else {})})
    states = _states(specs)
    first = [F.min(F.struct("ts", "seq")).alias("first")] if capped else []
    # Rows that stay apart are not grouped: hardly any two are alike, and they would be sorted and shuffled for it.
    single = _is(k, [*strided, _NO_METRIC, *folded]) if strided or folded else F.lit(False)
    groups = rows.where(~single).groupBy("_k", *by, "_series", "_cell").agg(*[start.alias(name) for name, (start, _) in states.items()], *first)
    if strided or folded:
        one = {"n": F.lit(1).cast("bigint"), "n_values": F.col("value_l").isNotNull().cast("bigint"), "sum_l": F.col("value_l"), **({"first": F.struct("ts", "seq")} if capped else {})}
        apart = rows.where(single).select("_k", *by, "_series", "_cell", *alone, *[c.alias(name) for name, c in one.items()])
        groups = groups.unionByName(apart, allowMissingColumns=True)
    if strided or folded or capped:
        groups = groups.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(groups)
    sampled = F.col("n_values")
    if strided:
        # Every stride-th call of a producer over all of its timers: of n alike ones, as many as there are multiples among their places.
        timers = running_sums(groups.where(_is(k, [*strided, _NO_METRIC])), ["r_producer"], ["r_ts", "r_seq", "_k", "_series"], "n", "_to")
        every = F.element_at(F.create_map(*[F.lit(x) for i in strided for x in (i, stride_mask(specs[i].stride) + 1)]), k)
        hits = F.when(F.col("r_value").isNotNull(), F.floor(F.col("_to") / every) - F.floor((F.col("_to") - F.col("n")) / every)).otherwise(0).cast("bigint")
        timers = timers.where(k != _NO_METRIC).withColumn("sampled", hits).withColumn("sum_l", F.col("sampled") * F.coalesce("r_value", F.lit(0))).drop("_to")
        groups = groups.where(~_is(k, [*strided, _NO_METRIC])).withColumn("sampled", sampled).unionByName(timers)
    else:
        groups = groups.withColumn("sampled", sampled)
    if capped:
        groups = groups.join(_admitted(groups, specs, capped), ["_k", "_series"], "left")
        over = _is(k, capped) & F.col("_admitted").isNull()
        groups = groups.withColumn("_series", F.when(over, series_key(overflow_labels())).otherwise(F.col("_series"))).drop("_admitted")
    merged = {**{name: merge for name, (_, merge) in states.items()}, "sampled": F.sum("sampled")}
    keep = ["_k", *by, "_series", "_cell", *merged]
    out = groups.where(~_is(k, folded)).select(*keep, F.lit(None).cast("bigint").alias("fold"))
    if folded:
        # An add counts as often as it came; of alike sets one will do.
        turns = groups.where(_is(k, folded)).withColumn("_add", F.when(F.col("r_op") == "set", F.col("r_value")).otherwise(F.col("r_value") * F.col("n")))
        fold = aggregate.set_add_fold(turns, ["_k", *by, "_series"], "r_op", "_add", ("r_ts", "r_seq"), "fold")
        out = out.unionByName(fold, allowMissingColumns=True)
    if not by and (seeds := [(i, [(s.domain.label_name, v)]) for i, s in enumerate(specs) if s.domain for v in s.domain.values] + [(i, []) for i, s in enumerate(specs) if not s.domain and not s.dynamic]):
        out = out.unionByName(obs.sparkSession.createDataFrame(seeds, f"_k int, _series {_ENTRIES}"), allowMissingColumns=True)
    cells = out.groupBy("_k", *by, "_series", "_cell").agg(*[merge.alias(name) for name, merge in merged.items()], F.max("fold").alias("fold"))
    counted = F.collect_list(F.when(F.col("_cell").isNotNull(), F.struct("_cell", F.col("sampled").alias("n"))))
    series = cells.groupBy("_k", *by, "_series").agg(*[merge.alias(name) for name, merge in merged.items()], F.max("fold").alias("fold"), F.map_from_entries(counted).alias("cells"))
    return series.select(F.col("_k").alias("metric_order"), *by, F.map_from_entries("_series").alias("labels"), *merged, "fold", "cells").persist(StorageLevel.MEMORY_AND_DISK)


def columns(spec) -> list[Column]:
    """The columns of a metric's kind, from the states of its series."""
    zero = F.lit(0).cast("bigint")
    total, count = F.coalesce("sum_l", zero), F.coalesce("sampled", zero)
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(spec.bounds))), lambda i: F.coalesce(F.try_element_at("cells", i), zero)).alias("counts")
    match spec.family:
        case "counter":
            return [total.alias("sum")]
        case "histogram":
            return [counts, count.alias("count"), total.alias("sum")]
        case "timer":
            return [F.coalesce("n", zero).alias("calls"), counts, count.alias("sample_count"), total.alias("sample_sum"), F.try_divide(total, count).alias("sample_avg")]
        case "distribution":
            positive = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("cells", lambda b, _: b >= 0))))
            zeros = F.coalesce(F.try_element_at("cells", F.lit(-1)), zero)
            low, high = numbers.bucket_low(F.array_min(F.map_keys(positive))), numbers.bucket_high(F.array_max(F.map_keys(positive)))
            return [
                count.alias("count"), total.alias("sum"), zeros.alias("zero_count"), positive.alias("positive"), F.try_divide(total, count).alias("mean"),
                F.when(zeros > 0, zero).otherwise(low).alias("min"), F.coalesce(high, F.when(zeros > 0, zero)).alias("max"),
            ]
    initial = spec.initial
    match spec.kind:
        case "gauge":
            value = F.coalesce("last_l", F.lit(initial or 0).cast("bigint"))
        case "gauge_f64":
            value = F.coalesce("last_d", F.lit(float(initial or 0)))
        case "gauge_i64":
            value = F.coalesce("fold", zero)
        case "max_gauge":
            value = F.greatest(F.lit(initial or 0).cast("bigint"), F.col("max_l"))
        case "max_gauge_f64":
            value = F.greatest(F.lit(initial or 0).cast("double"), F.col("max_d"))
        case "min_gauge":
            value = F.least(F.lit(numbers.LONG_MAX if initial is None else initial).cast("bigint"), F.col("min_l"))
        case _:
            value = F.least(F.lit(float("inf") if initial is None else initial).cast("double"), F.col("min_d"))
    return [value.alias("value")]
