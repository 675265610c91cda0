"""Cardinality caps with an overflow series, and eviction of idle series.

The cap admits label sets in the order of their first observation; rows of all
others go to one overflow series, which is not counted against the cap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.functions.labels import OVERFLOW_KEY, OVERFLOW_VALUE, canonical, overflow_labels, series_key

DEFAULT_MAX_SERIES = 2000
#: The sweep interval in seconds and the cycles that a series may idle.
SWEEP_SECONDS, SWEEP_THRESHOLD = 10, 30


def admitted(obs: DataFrame, max_series: int, metric: str = "metric", labels: str = "labels", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """``(metric, _series, admitted)`` for the label sets of each metric that come first.

    The order is made over distinct label sets, not rows.  As a filter on the rank, the
    limit reaches below the shuffle: a task sends at most ``max_series`` sets of a metric
    (``spark.sql.optimizer.windowGroupLimitThreshold`` permitting).  0 admits all.
    """
    first = obs.groupBy(metric, series_key(F.col(labels)).alias("_series")).agg(F.min(F.struct(*order)).alias("_first"))
    if max_series:
        rank = F.row_number().over(Window.partitionBy(metric).orderBy("_first", "_series"))
        first = first.withColumn("_rank", rank).where(F.col("_rank") <= max_series)
    return first.select(metric, "_series", F.lit(True).alias("admitted"))


def cap_series(obs: DataFrame, max_series: int = DEFAULT_MAX_SERIES, metric: str = "metric", labels: str = "labels", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The observations with the labels of unadmitted sets replaced by the overflow label,
    and ``redirected``.  Re-aggregate by labels afterwards."""
    keyed = obs.withColumn(labels, canonical(F.col(labels))).withColumn("_series", series_key(F.col(labels)))
    joined = keyed.join(admitted(obs, max_series, metric, labels, order), [metric, "_series"], "left")
    over = F.col("admitted").isNull()
    return joined.withColumn(labels, F.when(over, overflow_labels()).otherwise(F.col(labels))).withColumn("redirected", over).drop("_series", "admitted")


def overflow_stats(obs: DataFrame, max_series: int, metric: str = "metric", labels: str = "labels", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """``(metric, overflow_records, overflow_series, cardinality)``: rows redirected, distinct
    label sets redirected, and live series, the overflow series among them."""
    n = obs.groupBy(metric, series_key(F.col(labels)).alias("_series")).agg(F.count(F.lit(1)).alias("_n"))
    joined = n.join(admitted(obs, max_series, metric, labels, order), [metric, "_series"], "left")
    over = F.col("admitted").isNull()
    return joined.groupBy(metric).agg(
        F.coalesce(F.sum(F.when(over, F.col("_n"))), F.lit(0)).cast("bigint").alias("overflow_records"),
        F.count_if(over).alias("overflow_series"),
        (F.count_if(~over) + F.max(over.cast("bigint"))).alias("cardinality"),
    )


def cycle_of(ts: Column, seconds: int = SWEEP_SECONDS) -> Column:
    """The logical cycle of a time: whole sweep intervals since the epoch."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("bigint")


def generations(obs: DataFrame, cycle: str, max_staleness: int, by: Sequence[str], pinned: str | None = None) -> DataFrame:
    """Adds ``generation``: a series starts anew after more than ``max_staleness`` idle cycles.

    A series with a ``pinned`` row (a live handle) is never evicted.  Gaps are found
    over distinct cycles of a series, not over its rows.
    """
    touched = obs.groupBy(*by, cycle).agg(F.max(pinned).alias("_pin") if pinned else F.max(F.lit(False)).alias("_pin"))
    w = Window.partitionBy(*by).orderBy(cycle)
    fresh = (F.col(cycle) - F.lag(cycle).over(w) > max_staleness) & ~F.max("_pin").over(Window.partitionBy(*by))
    touched = touched.withColumn("generation", F.sum(F.coalesce(fresh, F.lit(False)).cast("int")).over(w)).drop("_pin")
    return obs.join(touched, [*by, cycle])


def live_generations(generation_rows: DataFrame, now: int, max_staleness: int, by: Sequence[str], cycle: str, aggs: Sequence[Column]) -> DataFrame:
    """Each generation's aggregates with its last cycle and ``evicted``: whether a sweep
    of cycle ``now`` has dropped it."""
    out = generation_rows.groupBy(*by, "generation").agg(F.max(cycle).alias("last_cycle"), *aggs)
    newest = F.max("generation").over(Window.partitionBy(*by))
    return out.withColumn("evicted", (F.col("generation") < newest) | (F.lit(now) - F.col("last_cycle") > max_staleness))


def cap_and_evict(obs: DataFrame, cycle: str, max_series: int, max_staleness: int, metric: str = "metric", labels: str = "labels", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Cap and eviction together: a slot that an evicted series frees admits a later one.

    ``(metric, labels, cycle, generation, redirected)`` for every label set and cycle that
    has observations.  This is a fold in time order: a sweep ends every cycle.  The overflow
    series takes a slot while it lives, so two must go before another is admitted.

    A series that is admitted lives to the end of its run of touches without a longer idle gap, and the slots of a
    cycle are gone after its first ``max_series`` touches at the latest; any touch after these means that
    some are redirected.  So the fold meets only the first touches of each cycle, one more than the cap, with the
    ends of their runs, streamed through one task per group of metrics whatever the number of series;
    the rest is by series.
    """
    id_ = F.struct(F.col(metric).alias("metric"), series_key(F.col(labels)).alias("series")).alias("_id")
    touches = obs.groupBy(id_, F.col(cycle).alias("cycle")).agg(F.min(F.struct(*order)).alias("first"))
    so_far = Window.partitionBy("_id").orderBy(F.col("cycle").asc_nulls_last())
    begins = F.coalesce(F.col("cycle") - F.lag("cycle").over(so_far) <= max_staleness, F.lit(False)) == F.lit(False)
    runs = touches.withColumn("_begin", F.when(begins, F.col("cycle")))
    runs = runs.withColumn("_run", F.last("_begin", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    if not max_series:
        generation = F.greatest(F.count("_begin").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) - 1, F.lit(0))
        return runs.select("_id.metric", F.map_from_entries("_id.series").alias("labels"), "cycle", generation.cast("int").alias("generation"), F.lit(False).alias("redirected"))

    # One sort for the ends alone, from the last touch back.
    back = Window.partitionBy("_id").orderBy(F.col("cycle").desc())
    last = F.coalesce(F.lag("cycle").over(back) - F.col("cycle") > max_staleness, F.lit(True))
    ends = touches.where("cycle is not null").withColumn("_last", F.when(last, F.col("cycle")))
    ends = ends.withColumn("_end", F.last("_last", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(F.col("_id.metric"), "cycle").orderBy("first", F.to_json("_id.series")))
    heads = ends.select("_id", "cycle", "_end", place.alias("_place")).where(F.col("_place") <= max_series + 1)
    heads = heads.withColumns({"_metric": F.col("_id.metric"), "_key": F.to_json("_id.series")})
    heads = heads.repartition(F.col("_metric")).sortWithinPartitions("_metric", "cycle", "_place")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live, clock = None, {}, None
        for batch in batches:
            admitted = []
            for m, key, now, end, at in zip(*(batch.column(c).to_pylist() for c in ("_metric", "_key", "cycle", "_end", "_place")), strict=True):
                if m != current:
                    current, live, clock = m, {}, None
                if now != clock:  # the sweeps between the last cycle and this one
                    live = {k: t for k, t in live.items() if now - t <= max_staleness}
                    clock = now
                new = at <= max_series and key not in live
                admit = new and len(live) < max_series
                if admit:
                    live[key] = end
                elif new or at > max_series:
                    live[OVERFLOW_KEY] = now
                admitted.append(admit)
            yield batch.select(["_id", "cycle"]).filter(pa.array(admitted, pa.bool_()))

    kinds = {f.name: f.dataType.simpleString() for f in heads.schema.fields}
    admissions = heads.mapInArrow(fold, f"_id {kinds['_id']}, cycle {kinds['cycle']}").groupBy("_id").agg(F.collect_list("cycle").alias("_admitted"))
    out = runs.select("_id", "cycle", "_run").join(admissions, "_id", "left")
    # A touch without a cycle is after all others and finds nothing alive.
    until = F.when(F.col("cycle").isNull(), F.size("_admitted") + 1).otherwise(F.size(F.filter("_admitted", lambda c: c <= F.col("cycle"))))
    inside = F.exists("_admitted", lambda c: c.between(F.col("_run"), F.col("cycle")))
    return out.withColumn("_admitted", F.coalesce("_admitted", F.array().cast(f"array<{kinds['cycle']}>"))).select(
        "_id.metric", F.map_from_entries("_id.series").alias("labels"), "cycle", F.greatest(until - 1, F.lit(0)).cast("int").alias("generation"), (F.col("cycle").isNotNull() & ~inside).alias("redirected")
    )


def is_overflow(labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(OVERFLOW_KEY)) == OVERFLOW_VALUE, F.lit(False))
