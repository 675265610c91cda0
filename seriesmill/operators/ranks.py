"""Row numbers and running sums within keys, without sorting a frequent key in one task.

A key with few rows is one window.  The rows of a frequent key are cut into ranges
of its order, each numbered on its own, and every range starts after what the
ranges before it hold: a prefix sum over the ranges, of which there is a bounded
number at any size of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of all frequent keys together, about; a key is frequent with more rows than a range's share, and than LEAST_ROWS.
RANGES, LEAST_ROWS = 1024, 1_000_000
#: Rows drawn for each range to place its borders.
DRAWN = 64


def with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int = RANGES, least_rows: int = LEAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with ``_range``, and whether any key was cut: a key's rows are in the order of their ranges,
    and a range is a bounded part of all rows.

    Borders are rows drawn from the key's own, so rows alike in all of ``order`` share a range.
    Nulls come first in ``order``, as in ``Window.orderBy``; null is a key like any other.
    """
    key, at = F.struct(*keys), F.struct(*order)
    counts = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    share = max(least_rows, -(-(total or 0) // ranges))
    if (most or 0) <= share:
        return df.withColumn("_range", F.lit(0)), False
    spark = df.sparkSession
    frequent = counts.where(F.col("_n") > share).select("_k")
    drawn = df.select(key.alias("_k"), at.alias("_at")).join(F.broadcast(frequent), "_k", "left_semi").where(F.rand(7) < min(1.0, DRAWN / share))
    borders = drawn.groupBy("_k").agg(F.array_sort(F.collect_list("_at")).alias("_b"))
    borders = borders.select("_k", F.filter("_b", lambda x, i: i % DRAWN == DRAWN - 1).alias("_b"))
    # At most a few thousand borders: collected, so that every later use sees the same ones.
    borders = spark.createDataFrame(borders.collect(), borders.schema)
    out = df.withColumn("_k", key).join(F.broadcast(borders), "_k", "left")
    return out.withColumn("_range", F.when(F.col("_b").isNull(), 0).otherwise(F.size(F.filter("_b", lambda b: b < at)))).drop("_k", "_b"), True


def _before(df: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """``(keys, _range, _before)``: the total of the ranges before each one of the frequent keys."""
    frequent = df.where("_range > 0").select(*keys).distinct()
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    sums = df.groupBy(*keys, "_range").agg(total.alias("_t"))
    sums = sums.alias("a").join(F.broadcast(frequent).alias("b"), same, "left_semi")
    up_to = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "_range", F.coalesce(F.sum("_t").over(up_to), F.lit(0)).alias("_before"))


def _add_before(df: DataFrame, before: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_range")]
    columns = [F.col(f"l.{c}") for c in df.columns if c not in ("_range", name)]
    return df.alias("l").join(F.broadcast(before).alias("r"), same, "left").select(*columns, (F.col(f"l.{name}") + F.coalesce("_before", F.lit(0))).alias(name))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, ranges: int = RANGES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Adds ``name``, a bigint: the row's number from 1 among those of its ``keys`` by ``order``, nulls first.

    Rows alike in keys and order are numbered in any order.  ``df`` must give the same rows
    each time it is run: it is counted first, where a key is frequent.
    """
    ranged, cut = with_ranges(df, keys, order, ranges, least_rows)
    out = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)).cast("bigint"))
    return _add_before(out, _before(ranged, keys, F.count(F.lit(1))), keys, name) if cut else out.drop("_range")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, ranges: int = RANGES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``keys`` up to this one by ``order``;
    rows alike in order are taken in any order."""
    ranged, cut = with_ranges(df, keys, order, ranges, least_rows)
    rows = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn(name, F.coalesce(F.sum(value).over(rows), F.lit(0)))
    return _add_before(out, _before(ranged, keys, F.coalesce(F.sum(value), F.lit(0))), keys, name) if cut else out.drop("_range")
