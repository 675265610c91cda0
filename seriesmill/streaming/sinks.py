"""Where exports go: tables, text files, datagrams and HTTP, from a batch or from
``foreachBatch`` of a stream."""

from __future__ import annotations

import gzip
import random
import socket
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators import exposition, otel

#: Bytes of a datagram, bytes from which a body is compressed, spans in a
#: request, seconds of the first wait and of the longest, days that tables are kept.
MAX_DATAGRAM, GZIP_FROM, SPAN_BATCH, BASE_BACKOFF, MAX_BACKOFF, RETENTION_DAYS = 8000, 1024, 512, 5.0, 300.0, 30


@dataclass(frozen=True)
class DogStatsDConfig:
    host: str = "127.0.0.1"
    port: int = 8125
    interval: float = 10.0
    tags: dict[str, str] = field(default_factory=dict)
    max_datagram: int = MAX_DATAGRAM


@dataclass(frozen=True)
class OtlpConfig:
    endpoint: str
    interval: float = 60.0
    headers: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)
    service: str = "seriesmill"
    timeout: float = 10.0


@dataclass(frozen=True)
class SpanConfig:
    endpoint: str
    interval: float = 10.0
    headers: dict[str, str] = field(default_factory=dict)
    service: str = "seriesmill"
    max_batch_size: int = SPAN_BATCH


@dataclass(frozen=True)
class TableConfig:
    path: str
    interval: float = 10.0
    service: str = "seriesmill"
    attributes: dict[str, str] = field(default_factory=dict)
    retention_days: int = RETENTION_DAYS


@dataclass(frozen=True)
class SweeperConfig:
    interval: float = 10.0
    threshold: int = 30


def backoff_seconds(failures: int, jitter: float, first_doubled: bool = True, both_ways: bool = False) -> float:
    """The wait after so many failures in a row: 5 s doubling up to 300 s.

    ``first_doubled``: the first failure waits twice the base.  ``jitter`` in 0..1 adds up
    to a quarter, above the longest wait too; ``both_ways``: a quarter off to a quarter more.
    """
    steps = min(failures if first_doubled else max(failures - 1, 0), 10)
    wait = min(BASE_BACKOFF * 2**steps, MAX_BACKOFF)
    return wait + wait / 4 * (2 * jitter - 1 if both_ways else jitter)


def retrying(action: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep, **kw) -> object:
    """Runs the action until it succeeds, at most ``attempts`` times; then its error is raised."""
    for failures in count(1):
        try:
            return action()
        except OSError:
            if failures >= attempts:
                raise
            sleep(backoff_seconds(failures, random.random(), **kw))


def send_datagrams(lines: DataFrame, config: DogStatsDConfig) -> None:
    """Packs lines into datagrams and sends them from the executors."""
    host, port = config.host, config.port

    def send(rows: Iterator) -> None:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for row in rows:
                s.sendto(row.payload.encode(), (host, port))

    exposition.pack_datagrams(lines, config.max_datagram).foreachPartition(send)


def http_body(text: str) -> tuple[bytes, dict[str, str]]:
    """The body and its headers; compressed from ``GZIP_FROM`` bytes on."""
    raw = text.encode()
    headers = {"Content-Type": "application/json"}
    return (gzip.compress(raw), headers | {"Content-Encoding": "gzip"}) if len(raw) >= GZIP_FROM else (raw, headers)


def post_json(requests: DataFrame, url: str, headers: dict[str, str], timeout: float = 10.0, attempts: int = 5) -> None:
    """Posts every ``json`` of the rows, each retried with growing waits; from the executors.

    A request that fails to the end fails the task, so Spark runs it again: nothing is lost,
    and receivers may see a request twice.
    """

    def post(rows: Iterator) -> None:
        for row in rows:
            body, more = http_body(row.json)
            request = urllib.request.Request(url, body, {**more, **headers})
            retrying(lambda r=request: urllib.request.urlopen(r, timeout=timeout).close(), attempts)

    requests.select("json").foreachPartition(post)


def post_protobuf(requests: DataFrame, url: str, headers: dict[str, str], timeout: float = 10.0, attempts: int = 5) -> None:
    """Posts every ``body`` of the rows (``otlp_proto``), compressed from ``GZIP_FROM`` bytes on, as ``post_json`` does."""

    def post(rows: Iterator) -> None:
        for row in rows:
            raw, more = bytes(row.body), {"Content-Type": "application/x-protobuf"}
            if len(raw) >= GZIP_FROM:
                raw, more = gzip.compress(raw), more | {"Content-Encoding": "gzip"}
            request = urllib.request.Request(url, raw, {**more, **headers})
            retrying(lambda r=request: urllib.request.urlopen(r, timeout=timeout).close(), attempts)

    requests.select("body").foreachPartition(post)


def export_metrics(metrics: DataFrame, config: OtlpConfig, resource: otel.Resource) -> None:
    post_json(otel.export_request(metrics, resource), config.endpoint.rstrip("/") + "/v1/metrics", config.headers, config.timeout)


def export_spans(otlp_spans: DataFrame, config: SpanConfig) -> None:
    from seriesmill.operators import spans

    post_json(spans.trace_requests(otlp_spans, config.service, batch=config.max_batch_size), config.endpoint.rstrip("/") + "/v1/traces", config.headers)


def write_tables(batch: dict[str, DataFrame], config: TableConfig, epoch: int | None = None) -> None:
    """Appends each table below the path, by day, sorted as it is read.

    With an ``epoch`` each batch has a folder level of its own that is overwritten, so a
    batch that runs again leaves its rows once.
    """
    for name, df in batch.items():
        out = df.withColumn("date", F.to_date("TimeUnix"))
        if epoch is not None:
            out = out.withColumn("epoch", F.lit(epoch))
        keys = ["date"] if epoch is None else ["date", "epoch"]
        writer = out.sortWithinPartitions("ServiceName", "MetricName", "TimeUnix").write.partitionBy(*keys)
        (writer.mode("append") if epoch is None else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")).parquet(f"{config.path.rstrip('/')}/{name}")


def expired(table: DataFrame, today: str, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """The days of a table that are past its retention: whole folders to drop."""
    return table.select("date").distinct().where(F.col("date") < F.date_sub(F.lit(today).cast("date"), retention_days))


def table_ddl(database: str, retention_days: int = RETENTION_DAYS) -> dict[str, str]:
    """``CREATE TABLE`` statements of the four tables, partitioned by day."""
    shared = "ResourceAttributes MAP<STRING,STRING>, ResourceSchemaUrl STRING, ServiceName STRING, ScopeName STRING, ScopeVersion STRING, ScopeAttributes MAP<STRING,STRING>, ScopeDroppedAttrCount BIGINT, ScopeSchemaUrl STRING, MetricName STRING, MetricDescription STRING, MetricUnit STRING, Attributes MAP<STRING,STRING>, StartTimeUnixNano BIGINT, TimeUnixNano BIGINT, StartTimeUnix TIMESTAMP, TimeUnix TIMESTAMP, Flags BIGINT"
    own = {
        otel.SUM: "Value DOUBLE, AggregationTemporality INT, IsMonotonic BOOLEAN",
        otel.GAUGE: "Value DOUBLE",
        otel.HISTOGRAM: "Count BIGINT, Sum DOUBLE, BucketCounts ARRAY<BIGINT>, ExplicitBounds ARRAY<DOUBLE>, Min DOUBLE, Max DOUBLE, AggregationTemporality INT",
        otel.EXP_HISTOGRAM: "Count BIGINT, Sum DOUBLE, Scale INT, ZeroCount BIGINT, PositiveOffset INT, PositiveBucketCounts ARRAY<BIGINT>, NegativeOffset INT, NegativeBucketCounts ARRAY<BIGINT>, Min DOUBLE, Max DOUBLE, AggregationTemporality INT",
    }
    return {name: f"CREATE TABLE IF NOT EXISTS {otel.qualified_table(database, name)} ({shared}, {columns}, date DATE) USING PARQUET PARTITIONED BY (date) TBLPROPERTIES ('retention.days' = '{retention_days}')" for name, columns in own.items()}


def each_batch(export: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that skips batches without rows."""

    def run(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            export(df, epoch)

    return run


def start(stream: DataFrame, export: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None, mode: str = "append"):
    """Starts an export loop: every so many seconds, or once over all that is there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch(export))
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
