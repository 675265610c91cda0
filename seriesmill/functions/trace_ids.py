"""Trace and span ids, and the traceparent header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADER = r"^00-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([0-9a-fA-F]{2})"


def parse_id(text: Column, digits: int) -> Column:
    """The id in lower case if it is exactly so many hexadecimal digits, else null."""
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{digits}}}\\z"), F.lower(text))


def is_valid(id_: Column) -> Column:
    """Not null and not all zeros."""
    return F.coalesce(id_.rlike("[1-9a-fA-F]"), F.lit(False))


def parse_traceparent(header: Column) -> Column:
    """``struct(trace_id, span_id, flags)``, null unless the version is 00, the parts are
    hexadecimal and of the right length, and no id is zero.  What follows the flags is
    ignored; so are the flags themselves when a span adopts the header."""
    part = lambda i: F.lower(F.regexp_extract(header, _HEADER, i))
    good = header.rlike(_HEADER) & is_valid(part(1)) & is_valid(part(2))
    return F.when(good, F.struct(part(1).alias("trace_id"), part(2).alias("span_id"), part(3).alias("flags")))


def to_traceparent(trace_id: Column, span_id: Column) -> Column:
    """Always with the sampled flag; empty for a span that is not recorded."""
    return F.when(is_valid(trace_id) & is_valid(span_id), F.concat_ws("-", F.lit("00"), trace_id, span_id, F.lit("01"))).otherwise(F.lit(""))


def random_trace_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def random_span_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 17, 16)


def derived_trace_id(*key: Column) -> Column:
    """An id that follows from a key: the same in every run."""
    return F.md5(F.concat_ws("\x1f", *[k.cast("string") for k in key]))


def derived_span_id(*key: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("\x1f", F.lit("span"), *[k.cast("string") for k in key])), 1, 16)
