"""Series as text lines: the Prometheus and DogStatsD formats.

Every function returns ``(series, pos, line)``: ``series`` orders the series of the
metric (null for its header, first), ``pos`` the lines of a series.  Label columns are
maps; ``labels=None`` is a metric without labels.  Nothing is sorted here;
``ordered`` does that for whoever writes the lines down.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import numbers
from seriesmill.functions.labels import dogstatsd_tags, prometheus_labels, series_key

_SERIES = "array<struct<key:string,value:string>>"


def integer_text(v: Column) -> Column:
    return v.cast("string")


def _key(labels: str | None) -> Column:
    return series_key(F.col(labels)) if labels else F.array().cast(_SERIES)


def ordered(lines: DataFrame) -> DataFrame:
    """The lines of one metric in the order they are written."""
    return lines.orderBy(F.col("series").asc_nulls_first(), "pos").select("line")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Prometheus


def prometheus_header(series: DataFrame, name: str, kind: str, help_: str) -> DataFrame:
    """HELP and TYPE lines; a metric without series has them too."""
    lines = [(-2, f"# HELP {name} {help_}"), (-1, f"# TYPE {name} {kind}")]
    rows = series.sparkSession.createDataFrame(lines, "pos int, line string")
    return rows.select(F.lit(None).cast(_SERIES).alias("series"), "pos", "line")


def _braces(labels: str | None, strict: bool, le: Column | None = None) -> Column:
    text = prometheus_labels(F.col(labels), strict) if labels else F.lit("")
    if le is None:
        return F.concat(F.lit("{"), text, F.lit("}")) if labels else F.lit("")
    comma = F.when(text == "", F.lit("")).otherwise(F.lit(","))
    return F.concat(F.lit("{"), text, comma, F.lit('le="'), le, F.lit('"}'))


def prometheus_value(series: DataFrame, name: str, kind: str, value: Column, help_: str | None = None, labels: str | None = None, strict_compat: bool = False) -> DataFrame:
    """Counters and gauges: ``name{labels} value``, value a text column."""
    line = F.concat(F.lit(name), _braces(labels, strict_compat), F.lit(" "), value)
    rows = series.select(_key(labels).alias("series"), F.lit(0).alias("pos"), line.alias("line"))
    return union(prometheus_header(series, name, kind, help_ or name), rows)


def prometheus_counter(series: DataFrame, name: str, value: str = "sum", **kw) -> DataFrame:
    """Signed, labeled or not."""
    return prometheus_value(series, name, "counter", integer_text(F.col(value)), **kw)


def prometheus_gauge(series: DataFrame, name: str, value: str = "value", **kw) -> DataFrame:
    """Longs as integers, doubles by their shortest text."""
    double = dict(series.dtypes)[value] in ("double", "float")
    return prometheus_value(series, name, "gauge", numbers.float_text(F.col(value)) if double else integer_text(F.col(value)), **kw)


def prometheus_histogram(series: DataFrame, name: str, bounds: Sequence[int], help_: str | None = None, labels: str | None = None, strict_compat: bool = False) -> DataFrame:
    """Cumulative buckets with ``le`` after the labels, ``+Inf``, sum and count.

    The lines of a series come from one row by ``explode``: no join and no shuffle.
    """
    le = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    running = numbers.cumulative(F.col("counts"))
    buckets = F.transform(F.arrays_zip(le.alias("le"), running.alias("n")), lambda b, i: F.struct(i.alias("pos"), F.concat(F.lit(name + "_bucket"), _braces(labels, strict_compat, b["le"]), F.lit(" "), b["n"].cast("string")).alias("line")))
    tail = [F.struct(F.lit(len(bounds) + 1 + i).alias("pos"), F.concat(F.lit(f"{name}_{what}"), _braces(labels, strict_compat), F.lit(" "), F.col(what).cast("string")).alias("line")) for i, what in enumerate(("sum", "count"))]
    rows = series.select(_key(labels).alias("series"), F.inline(F.concat(buckets, F.array(*tail))))
    return union(prometheus_header(series, name, "histogram", help_ or name), rows)


def prometheus_summary(series: DataFrame, name: str, help_: str | None = None, labels: str | None = None, strict_compat: bool = False) -> DataFrame:
    """Distributions: sum and count only."""
    tail = [F.struct(F.lit(i).alias("pos"), F.concat(F.lit(f"{name}_{what}"), _braces(labels, strict_compat), F.lit(" "), F.col(what).cast("string")).alias("line")) for i, what in enumerate(("sum", "count"))]
    return union(prometheus_header(series, name, "summary", help_ or name), series.select(_key(labels).alias("series"), F.inline(F.array(*tail))))


def prometheus_timer(series: DataFrame, name: str, bounds: Sequence[int], help_: str | None = None, labels: str | None = None, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two metrics: the calls as a counter, then the samples as a histogram."""
    help_ = help_ or name
    calls = prometheus_counter(series, name + "_calls", "calls", help_=help_ + " total calls", labels=labels, strict_compat=strict_compat)
    samples = series.withColumnsRenamed({"sample_sum": "sum", "sample_count": "count"})
    return calls, prometheus_histogram(samples, name + "_samples", bounds, help_ + " sampled latency in nanoseconds", labels, strict_compat)


# DogStatsD


def _tags(labels: str | None, tags: dict[str, str]) -> Column:
    """Label tags before the caller's.  Labeled metrics have the ``|#`` without any tag, too."""
    fixed = ",".join(f"{k}:{v}" for k, v in tags.items())
    if labels is None:
        return F.lit("|#" + fixed if fixed else "")
    own = dogstatsd_tags(F.col(labels))
    comma = F.when((own == "") | F.lit(not fixed), F.lit("")).otherwise(F.lit(","))
    return F.concat(F.lit("|#"), own, comma, F.lit(fixed))


def _dogstatsd(series: DataFrame, parts: Sequence[tuple[str, Column, str]], labels: str | None, tags: dict[str, str] | None, keep: Sequence[str]) -> DataFrame:
    end = _tags(labels, tags or {})
    lines = [F.struct(F.lit(i).alias("pos"), F.concat(F.lit(name + ":"), value, F.lit("|" + kind), end).alias("line")) for i, (name, value, kind) in enumerate(parts)]
    return series.select(*keep, _key(labels).alias("series"), F.inline(F.array(*lines)))


def dogstatsd_counter(series: DataFrame, name: str, value: str = "sum", labels: str | None = None, tags: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` names further columns to carry beside the lines, such as a window."""
    return _dogstatsd(series, [(name, integer_text(F.col(value)), "c")], labels, tags, keep)


def dogstatsd_gauge(series: DataFrame, name: str, value: str = "value", labels: str | None = None, tags: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    double = dict(series.dtypes)[value] in ("double", "float")
    return _dogstatsd(series, [(name, numbers.compact_float_text(F.col(value)) if double else integer_text(F.col(value)), "g")], labels, tags, keep)


def dogstatsd_histogram(series: DataFrame, name: str, labels: str | None = None, tags: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Count and sum as counters; the buckets are dropped."""
    return _dogstatsd(series, [(f"{name}.{what}", F.col(what).cast("string"), "c") for what in ("count", "sum")], labels, tags, keep)


def dogstatsd_timer(series: DataFrame, name: str, labels: str | None = None, tags: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    parts = [(".calls", "calls"), (".samples.count", "sample_count"), (".samples.sum", "sample_sum")]
    return _dogstatsd(series, [(name + suffix, F.col(c).cast("string"), "c") for suffix, c in parts], labels, tags, keep)


def dogstatsd_distribution(samples: DataFrame, name: str, labels: str | None = None, tags: dict[str, str] | None = None, keep: Sequence[str] = (), rate_text: Callable[[Column], Column] = numbers.float_text) -> DataFrame:
    """Rows ``(pos, midpoint, n)`` as samples: ``name:midpoint|d``, with the rate 1/n where n > 1.

    The order is that of ``pos``: zeros first for totals, last for deltas.  ``rate_text`` writes the rate: as the other
    numbers here, or as SQL has it (``numbers.sql_float_text``), which differs below 1e-4.
    """
    rate = F.when(F.col("n") > 1, F.concat(F.lit("|@"), rate_text(F.lit(1.0) / F.col("n")))).otherwise(F.lit(""))
    line = F.concat(F.lit(name + ":"), F.col("midpoint").cast("string"), F.lit("|d"), rate, _tags(labels, tags or {}))
    return samples.where("n > 0").select(*keep, _key(labels).alias("series"), F.col("pos").cast("int").alias("pos"), line.alias("line"))


def with_midpoints(bucket_deltas: DataFrame) -> DataFrame:
    """Adds the midpoint to rows of ``temporality.bucket_deltas``; position 64 is the zero bucket."""
    return bucket_deltas.withColumn("midpoint", F.when(F.col("pos") == 64, F.lit(0).cast("bigint")).otherwise(numbers.bucket_midpoint(F.col("pos"))))


def pack_datagrams(lines: DataFrame, limit: int = 8000, line: str = "line") -> DataFrame:
    """Whole lines packed into datagrams of at most ``limit`` bytes, a newline after each;
    longer lines are dropped.  ``(partition, datagram, payload)``.

    A greedy fold over each partition in its order, one datagram in memory at a time.
    """
    import pandas as pd

    def fold(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            out = []
            for text in pdf[line]:
                n = len(text.encode()) + 1
                if n > limit:
                    continue
                if size + n > limit:
                    out.append((part, number, "".join(held)))
                    number, held, size = number + 1, [], 0
                held.append(text + "\n")
                size += n
            if out:
                yield pd.DataFrame(out, columns=["partition", "datagram", "payload"])
        if held:
            yield pd.DataFrame([(part, number, "".join(held))], columns=["partition", "datagram", "payload"])

    return lines.select(line).mapInPandas(fold, "partition int, datagram int, payload string")
