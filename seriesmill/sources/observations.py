"""Observations from tables, files, streams and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = "metric string, op string, labels map<string,string>, value_l bigint, value_d double, ts timestamp, ts_unix_nano bigint, seq bigint, producer string"
OPS = ("add", "set", "observe", "record", "elapsed")


def observations(rows: DataFrame, metric: Column | str, op: str, *, labels: Column | None = None, value_l: Column | None = None, value_d: Column | None = None, ts: str = "ts", seq: str = "seq", producer: Column | None = None) -> DataFrame:
    """Rows of any table as observations; absent parts are null, absent labels empty."""
    if op not in OPS:
        raise ValueError(f"no such operation: {op}")
    at = F.col(ts).cast("timestamp")
    return rows.select(
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), F.lit(op).alias("op"),
        (F.create_map().cast("map<string,string>") if labels is None else labels).alias("labels"),
        (F.lit(None) if value_l is None else value_l).cast("bigint").alias("value_l"), (F.lit(None) if value_d is None else value_d).cast("double").alias("value_d"),
        at.alias("ts"), (F.unix_micros(at) * 1000).alias("ts_unix_nano"), F.col(seq).cast("bigint").alias("seq"), (F.lit(None) if producer is None else producer).cast("string").alias("producer"),
    )


def read(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Observations stored in files: parquet and orc hold the schema, json and csv are read by it.

    csv has no maps: its labels are a JSON column.
    """
    if format == "csv":
        flat = OBSERVATION.replace("labels map<string,string>", "labels string")
        df = spark.read.options(header="true", **options).schema(flat).csv(path)
        return df.withColumn("labels", F.coalesce(F.from_json("labels", "map<string,string>"), F.create_map().cast("map<string,string>")))
    reader = spark.read.options(**options).schema(OBSERVATION) if format == "json" else spark.read.options(**options)
    return reader.format(format).load(path)


def read_stream(spark: SparkSession, path: str, format: str = "parquet", max_files: int = 1000, **options: str) -> DataFrame:
    """A stream of observation files as they appear in a folder."""
    return spark.readStream.schema(OBSERVATION).options(maxFilesPerTrigger=str(max_files), **options).format(format).load(path)


def rate_stream(spark: SparkSession, rows_per_second: int, metric: str, labels: Column | None = None) -> DataFrame:
    """A generated stream: one counter increment for each row of the rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return observations(rate, metric, "add", labels=labels, value_l=F.lit(1), ts="timestamp", seq="value")


def write(obs: DataFrame, path: str, format: str = "parquet", mode: str = "append") -> None:
    """Partitioned by day, so that a time filter prunes folders; csv has its labels as JSON."""
    out = obs.withColumn("day", F.to_date("ts"))
    if format == "csv":
        out = out.withColumn("labels", F.to_json("labels"))
    writer = out.write.mode(mode).partitionBy("day")
    (writer.option("header", "true") if format == "csv" else writer).format(format).save(path)


def with_profile(calls: DataFrame, profile: str, n_labels: int) -> DataFrame:
    """Adds ``label``, the number of the label that call ``i`` of ``thread`` goes to.

    uniform: (i + t) mod n.  hotspot: 15 of 16 go round the first min(8, n) labels, the rest over all.
    churn: (17 i + 131 t) mod n.
    """
    i, t, n = F.col("i"), F.col("thread"), F.lit(n_labels)
    index = {
        "uniform": (i + t) % n,
        "hotspot": F.when(i % 16 != 0, (i + t) % min(8, n_labels)).otherwise((i + t) % n),
        "churn": (i * 17 + t * 131) % n,
    }[profile]
    return calls.withColumn("label", index)


def access_profile(spark: SparkSession, profile: str, rows: int, n_labels: int, threads: int = 1) -> DataFrame:
    """``(thread, i, label)``: calls made up by a profile of ``with_profile``."""
    calls = spark.range(rows * threads).select((F.col("id") % threads).alias("thread"), F.floor(F.col("id") / threads).alias("i"))
    return with_profile(calls, profile, n_labels)
