"""Statistics of repeated benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trimmed_mean(runs: DataFrame, by: list[str], value: str, name: str = "trimmed_mean") -> DataFrame:
    """The median of fewer than 5 runs; else the mean without (n - 1) // 4 at either end.

    A group is the runs of one mode: a handful of rows.
    """
    w = Window.partitionBy(*by)
    ranked = runs.where(F.col(value).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)))
    cut = F.floor((F.col("_n") - 1) / 4)
    inner = F.when((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut), F.col(value))
    return ranked.groupBy(*by).agg(F.when(F.max("_n") < 5, F.median(value)).otherwise(F.avg(inner)).alias(name))


def cv_pct(value: Column) -> Column:
    """Aggregate: sample standard deviation over mean, in percent; 0 for one run or mean 0."""
    cv = F.try_divide(F.stddev_samp(value), F.avg(value)) * 100
    return F.when((F.count(value) < 2) | (F.avg(value) == 0), F.lit(0.0)).otherwise(cv)


def parse_runs(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(file columns..., key, value)`` of ``key=value`` lines; other lines are skipped."""
    others = [c for c in lines.columns if c != text]
    kv = F.regexp_extract(F.trim(text), r"^([A-Za-z0-9_.]+)=(\S+)", 1), F.regexp_extract(F.trim(text), r"^([A-Za-z0-9_.]+)=(\S+)", 2)
    return lines.select(*others, kv[0].alias("key"), kv[1].alias("value")).where("key <> ''")


def summarize(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs, least, largest and trimmed mean, and the coefficient of variation of each group."""
    basic = runs.groupBy(*by).agg(F.count(value).alias("runs"), F.min(value).alias("min"), F.max(value).alias("max"), cv_pct(F.col(value)).alias("cv_pct"))
    return basic.join(trimmed_mean(runs, by, value), by)


#: Words that ``perf stat`` puts between a figure and its event.
PERF_UNITS = ("msec", "usec", "nsec", "ns", "seconds", "Joules", "Bytes", "MiB", "MB/s", "C")
#: What is reported of a run's events: one over another, times a factor.
RATES = {
    "instructions_per_cycle": ("instructions", "cycles", 1.0),
    "cache_misses_pct": ("cache-misses", "cache-references", 100.0),
    "l1d_misses_pct": ("L1-dcache-load-misses", "L1-dcache-loads", 100.0),
    "branch_misses_pct": ("branch-misses", "branches", 100.0),
}


def parse_perf(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(event, total)`` of the figures in ``perf stat``'s own layout, summed by event.

    A line has a figure with thousands separators, a unit for some events, and the event: bare, with a modifier (``cycles:u``) or
    within its unit of the processor (``cpu_core/cycles/u``).  Lines without a figure, ``<not counted>`` among them, are left out.
    """
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    rows = lines.select(words.alias("w")).where(F.size("w") > 1)
    figure = F.expr("try_cast(replace(w[0], ',', '') AS double)")
    named = F.get("w", F.when(F.get("w", F.lit(1)).isin(*PERF_UNITS), 2).otherwise(1))
    inner, bare = F.split_part(named, F.lit("/"), F.lit(2)), F.substring_index(named, ":", 1)
    rows = rows.select(F.when(F.contains(named, F.lit("/")), inner).otherwise(bare).alias("event"), figure.alias("total"))
    return rows.where("total is not null and event is not null").groupBy("event").agg(F.sum("total").alias("total"))


def event_rates(totals: DataFrame, rates: dict[str, tuple[str, str, float]] | None = None) -> DataFrame:
    """One row with each of ``rates``, 0 where its lower event was not counted."""
    of = lambda event: F.coalesce(F.sum(F.when(F.col("event") == event, F.col("total"))), F.lit(0.0))
    return totals.agg(*[ratio(of(above) * factor, of(below)).alias(name) for name, (above, below, factor) in (rates or RATES).items()])


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0 where b is."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
