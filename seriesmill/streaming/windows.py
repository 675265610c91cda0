"""Windowed metrics over a stream of observations.

The plans are those of batch: a tumbling window is one more grouping column.
Rows later than the watermark are dropped from windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import numbers
from seriesmill.functions.labels import series_key


def windowed(obs: DataFrame, window: str, watermark: str, by: Sequence[str], aggs: Sequence[Column], slide: str | None = None) -> DataFrame:
    """``(window_start, window_end, *by, ...)``; works on a stream and on a table alike."""
    rows = obs.withWatermark("ts", watermark) if obs.isStreaming else obs
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = rows.groupBy(w.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[c for c in out.columns if c not in ("w", *by)])


def counters(obs: DataFrame, window: str, watermark: str, by: Sequence[str] = ("metric", "series")) -> DataFrame:
    """Signed sums per series and window: the deltas of a counter."""
    return windowed(_keyed(obs), window, watermark, by, [F.coalesce(F.sum("value_l"), F.lit(0)).alias("sum")])


def gauges(obs: DataFrame, window: str, watermark: str, by: Sequence[str] = ("metric", "series")) -> DataFrame:
    """The last value set in each window."""
    return windowed(_keyed(obs), window, watermark, by, [F.max_by("value_d", F.struct("ts", "seq")).alias("value")])


def extrema(obs: DataFrame, window: str, watermark: str, by: Sequence[str] = ("metric", "series"), initial: int = 0) -> DataFrame:
    """Largest value of each window with the initial one, reset at every window."""
    return windowed(_keyed(obs), window, watermark, by, [F.greatest(F.lit(initial).cast("bigint"), F.max("value_l")).alias("max")])


def histograms(obs: DataFrame, bounds: Sequence[int], window: str, watermark: str, by: Sequence[str] = ("metric", "series")) -> DataFrame:
    v = F.col("value_l")
    return windowed(_keyed(obs), window, watermark, by, [numbers.bucket_counts(v, bounds).alias("counts"), F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0)).alias("sum")])


def exponential(obs: DataFrame, window: str, watermark: str, by: Sequence[str] = ("metric", "series")) -> DataFrame:
    """A row for each series, window and bucket; a null bucket counts the zeros."""
    rows = _keyed(obs).withColumn("bucket", numbers.bucket_index(F.col("value_l")))
    return windowed(rows, window, watermark, [*by, "bucket"], [F.count("value_l").alias("n"), F.sum("value_l").alias("sum")])


def _keyed(obs: DataFrame) -> DataFrame:
    """The label set as sorted entries: maps are no grouping key of a stream."""
    return obs.withColumn("series", series_key(F.col("labels")))
