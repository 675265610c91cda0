"""Numbers as text, base-2 exponential buckets, and fixed-bound buckets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LONG_MAX = 2**63 - 1

#: The default latency bounds, in microseconds and nanoseconds.
LATENCY_BOUNDS_US = (10, 50, 100, 500, 1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000)
LATENCY_BOUNDS_NS = tuple(b * 1_000 for b in LATENCY_BOUNDS_US)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _expanded(text: Column) -> Column:
    """The JVM's ``d.dddE<n>``, without sign, laid out anew."""

    def layout(x: Column) -> Column:
        # Digits, and the place of the decimal point after their start.
        d, point = x["digits"], x["point"]
        n = F.char_length(d)
        return (
            F.when((n <= point) & (point <= 16), F.concat(d, F.repeat(F.lit("0"), point - n), F.lit(".0")))
            .when((point > 0) & (point <= 16), F.concat(F.substring(d, F.lit(1), point), F.lit("."), F.substring(d, point + 1, n)))
            .when((point > -5) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
            .when(n == 1, F.concat(d, F.lit("e"), (point - 1).cast("string")))
            .otherwise(F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, F.lit(2), n), F.lit("e"), (point - 1).cast("string")))
        )

    digits = F.regexp_replace(F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit("")), "0+$", "")
    return _let(F.struct(digits.alias("digits"), (F.substring_index(text, "E", -1).cast("int") + 1).alias("point")), layout)


def float_text(v: Column) -> Column:
    """Shortest decimal text of a double that reads back as it: ``42.0``, ``0.75``, ``1e16``,
    ``1.5e-7``, ``inf``, ``NaN``; plain notation from 1e-5 up to below 1e16.

    The digits are those of the JVM's own text; where that has an exponent, only
    their layout is made anew.
    """
    s = v.cast("string")
    sign = F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    big = F.concat(sign, _expanded(F.regexp_replace(s, "^-", "")))
    return F.when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf"))).when(F.contains(s, F.lit("E")), big).otherwise(s)


@F.pandas_udf(StringType())
def _repr(v: pd.Series) -> pd.Series:
    return v.map(float.__repr__, na_action="ignore")


def sql_float_text(v: Column) -> Column:
    """The least digits of a double that read back as it and are closest to it, laid out as SQL engines cast it to
    text: ``0.0001``, ``6.25e-05``; plain notation from 1e-4 on.

    The JVM's own text has a digit too many for some doubles before Java 19, so the digits are Python's.
    """
    return _repr(v.cast("double"))


def compact_float_text(v: Column) -> Column:
    """Whole numbers below 2**53 as integers, others as ``float_text``; -0.0 is ``0``."""
    whole = ~F.isnan(v) & (F.abs(v) < 2.0**53)
    whole = whole & F.when(whole, v == F.floor(v).cast("double")).otherwise(False)
    return F.when(whole, F.floor(v).cast("bigint").cast("string")).otherwise(float_text(v))


def bucket_index(v: Column) -> Column:
    """floor(log2 v) of a positive long, exactly; null for zero and below."""
    return F.when(v > 0, F.length(F.bin(v)) - 1)


def bucket_midpoint(b: Column) -> Column:
    return F.when(b == 0, F.lit(1).cast("bigint")).when(b == 62, F.lit(3 << 61)).otherwise(F.call_function("shiftleft", F.lit(3).cast("bigint"), (b - 1).cast("int")))


def bucket_low(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), b.cast("int"))


def bucket_high(b: Column) -> Column:
    return F.when(b >= 62, F.lit(LONG_MAX)).when(b.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(b + 1, F.lit(62)).cast("int")) - 1)


def compact_buckets(buckets: Column) -> Column:
    """``struct(offset, counts)`` of a sparse map from bucket to count: empty buckets at
    either end trimmed, inner ones kept as zeros; offset 0 and no counts if empty."""
    keys = F.map_keys(F.map_filter(buckets, lambda _, n: n > 0))
    low = F.array_min(keys)
    counts = F.transform(F.sequence(low, F.array_max(keys)), lambda b: F.coalesce(F.try_element_at(buckets, b), F.lit(0).cast("bigint")))
    empty = F.size(keys) == 0
    return F.struct(F.coalesce(low, F.lit(0)).cast("int").alias("offset"), F.when(empty, F.array().cast("array<bigint>")).otherwise(counts).alias("counts"))


def first_bucket(v: Column, bounds: Sequence[int]) -> Column:
    """Index of the first bound, in the order given, that is no less than v; else their number."""
    out = None
    for i, b in enumerate(bounds):
        out = F.when(v <= b, i) if out is None else out.when(v <= b, i)
    return F.lit(0) if out is None else out.otherwise(len(bounds))


def bucket_counts(v: Column, bounds: Sequence[int]) -> Column:
    """Aggregate: array of the counts per bucket, one more than there are bounds."""
    at = first_bucket(v, bounds)
    return F.array(*[F.count_if(v.isNotNull() & (at == i)) for i in range(len(bounds) + 1)])


def cumulative(counts: Column) -> Column:
    """Running sums of an array of counts."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(counts, start, lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")) + n)))


def cumulative_to_buckets(cumulative_counts: Column) -> Column:
    """Counts per bucket of cumulative ones; a fall counts as zero."""
    return F.transform(cumulative_counts, lambda c, i: F.greatest(c - F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(cumulative_counts, i - 1), F.lit(0))), F.lit(0)).cast("bigint"))


def number_value(as_int: Column, as_double: Column) -> Column:
    return F.coalesce(as_int.cast("double"), as_double, F.lit(0.0))
