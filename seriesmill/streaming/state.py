"""Keyed state: running totals, deltas of cumulative exports by series, and caps with eviction by metric.

All need the RocksDB state store (``STATE_STORE``), which keeps state on disk
and in checkpoints.  Rows of a micro-batch are folded in ``(ts, seq)`` order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType, TimestampType

from seriesmill.functions.labels import OVERFLOW_KEY, OVERFLOW_VALUE, series_key
from seriesmill.operators.cardinality import DEFAULT_MAX_SERIES, SWEEP_SECONDS, SWEEP_THRESHOLD, cycle_of
from seriesmill.operators.temporality import POLICIES, RESET, SATURATE, SIGNED

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_TOTAL = StructType([StructField("total", LongType()), StructField("last", LongType())])
TOTALS = StructType([StructField("metric", StringType()), StructField("series", StringType()), StructField("delta", LongType()), StructField("total", LongType())])


class RunningTotals(StatefulProcessor):
    """A counter's total and what the batch added, one row for each series that was touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("total", _TOTAL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, last = self.state.get() if self.state.exists() else (0, 0)
        delta = sum(int(pdf["value_l"].fillna(0).sum()) for pdf in rows)
        self.state.update((total + delta, last + 1))
        yield pd.DataFrame({"metric": [key[0]], "series": [key[1]], "delta": [delta], "total": [total + delta]})

    def close(self) -> None:
        pass


def series_text(obs: DataFrame) -> DataFrame:
    return obs.withColumn("series", F.to_json(series_key(F.col("labels"))))


def running_totals(obs: DataFrame) -> DataFrame:
    """``(metric, series, delta, total)`` in update mode, keyed by series."""
    keyed = series_text(obs).select("metric", "series", "value_l")
    return keyed.groupBy("metric", "series").transformWithStateInPandas(statefulProcessor=RunningTotals(), outputStructType=TOTALS, outputMode="Update", timeMode="None")


# Deltas of cumulative exports

_LAST = StructType([StructField("at", LongType()), StructField("totals", ArrayType(LongType()))])
DELTAS = StructType([StructField("metric", StringType()), StructField("series", StringType()), StructField("kind", StringType()), StructField("ts", TimestampType()), StructField("deltas", ArrayType(LongType()))])


def array_delta(current: Sequence[int], previous: Sequence[int] | None, policy: str) -> list[int]:
    """``temporality.difference`` of each total; a total that was not there before is all new."""
    previous = [*(previous or []), *[0] * len(current)][: len(current)]
    if policy == SIGNED:
        return [c - p for c, p in zip(current, previous, strict=True)]
    if policy == RESET:
        return [c if c < p else c - p for c, p in zip(current, previous, strict=True)]
    return [max(c - p, 0) for c, p in zip(current, previous, strict=True)]


class Deltas(StatefulProcessor):
    """What a series' totals gained since its last export; its state goes when it has not been exported for ``ttl_ms``.

    The state of a series is its last totals.  An export that is no later than the last one is passed over.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        exports = sorted((int(at), list(totals)) for pdf in rows for at, totals in zip(pdf["at"], pdf["totals"], strict=True))
        at, totals = self.last.get() if self.last.exists() else (None, None)
        before, out = at, []
        for now, current in exports:
            if at is not None and now <= at:
                continue
            known = totals if at is not None and now - at <= self.ttl_ms else None
            deltas = array_delta(current, known, POLICIES[key[2]])
            if POLICIES[key[2]] != SATURATE or any(deltas):
                out.append((*key, pd.Timestamp(now, unit="ms"), deltas))
            at, totals = now, current
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.handle.registerTimer(at + self.ttl_ms)
            self.last.update((at, totals))
        yield pd.DataFrame(out, columns=DELTAS.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=DELTAS.fieldNames())

    def close(self) -> None:
        pass


def deltas(exports: DataFrame, watermark: str, ttl_seconds: int) -> DataFrame:
    """``(metric, series, kind, ts, deltas)`` of a stream of cumulative exports ``(metric, labels, kind, ts, totals)``.

    ``kind`` sets the policy: counters are signed, histograms and timers start anew after a fall, distributions count a fall as
    zero and leave out exports without news.  ``totals`` is an array: a histogram's counts, count and sum, say.  A series
    that is not exported for ``ttl_seconds`` is new when it comes back, and its state is dropped once the watermark has passed that time.
    ``temporality.array_deltas`` is the same in batch.
    """
    keyed = series_text(exports.withWatermark("ts", watermark)).select("metric", "series", "kind", "ts", F.unix_millis("ts").alias("at"), "totals")
    return keyed.groupBy("metric", "series", "kind").transformWithStateInPandas(statefulProcessor=Deltas(ttl_seconds * 1000), outputStructType=DELTAS, outputMode="Append", timeMode="EventTime")


# Caps and eviction

_LIVE = StructType([StructField("last_cycle", LongType()), StructField("since", LongType())])
_NAME = StructType([StructField("series", StringType())])
ADMITTED = StructType(
    [StructField(n, t) for n, t in (("metric", StringType()), ("series", StringType()), ("cycle", LongType()), ("since", LongType()), ("redirected", BooleanType()), ("value_l", LongType()), ("evicted", LongType()))]
)


class CapAndEvict(StatefulProcessor):
    """Admits the first series of a metric up to a cap and drops idle ones.

    State is a map of the live series with their last cycle and that of their admission: at most the cap and the
    overflow series, nothing of series that are gone.  A timer in event time sweeps
    the metric when its longest idle series falls due, whether rows of the metric come or not.
    """

    def __init__(self, max_series: int, max_staleness: int, cycle_ms: int):
        self.max_series, self.max_staleness, self.cycle_ms = max_series, max_staleness, cycle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.live = handle, handle.getMapState("live", _NAME, _LIVE)

    def _due(self, live: dict[str, tuple[int, int]]) -> int:
        """When the first of the live series will have been idle for too long."""
        return (min(t for t, _ in live.values()) + self.max_staleness + 1) * self.cycle_ms

    def _set_timer(self, live: dict[str, tuple[int, int]]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if live:
            self.handle.registerTimer(self._due(live))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.live.iterator()}
        overflow = json.dumps([{"key": OVERFLOW_KEY, "value": OVERFLOW_VALUE}], separators=(",", ":"))
        live, out, clock, evicted = dict(before), [], None, 0
        pdf = pd.concat(list(rows)).sort_values(["cycle", "at", "seq"])
        for series, cycle, value in zip(pdf["series"], pdf["cycle"], pdf["value_l"], strict=True):
            cycle = int(cycle)
            if cycle != clock:
                gone = [s for s, (t, _) in live.items() if cycle - t > self.max_staleness]
                for s in gone:
                    del live[s]
                evicted, clock = evicted + len(gone), cycle
            admit = series in live or not self.max_series or len(live) < self.max_series
            name = series if admit else overflow
            live[name] = (cycle, live[name][1] if name in live else cycle)
            out.append((key[0], name, cycle, live[name][1], not admit, None if pd.isna(value) else int(value), evicted))
            evicted = 0
        for name in before.keys() - live.keys():
            self.live.removeKey((name,))
        for name, entry in live.items():
            if before.get(name) != entry:
                self.live.updateValue((name,), entry)
        self._set_timer(live)
        yield pd.DataFrame(out, columns=ADMITTED.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cycle = expiredTimerInfo.getExpiryTimeInMs() // self.cycle_ms
        live = {k[0]: (v[0], v[1]) for k, v in self.live.iterator()}
        gone = [s for s, (t, _) in live.items() if cycle - t > self.max_staleness]
        for s in gone:
            self.live.removeKey((s,))
            del live[s]
        if live:
            self.handle.registerTimer(self._due(live))
        yield pd.DataFrame([(key[0], None, cycle, None, False, None, len(gone))] if gone else [], columns=ADMITTED.fieldNames())

    def close(self) -> None:
        pass


def cap_and_evict(obs: DataFrame, max_series: int = DEFAULT_MAX_SERIES, max_staleness: int = SWEEP_THRESHOLD, sweep_seconds: int = SWEEP_SECONDS, watermark: str = "10 seconds") -> DataFrame:
    """Observations with the series they count for: their own, or the overflow series.

    ``since`` is the cycle in which the series was last admitted.  ``evicted`` on a row counts the series that sweeps dropped just before it.
    A sweep without rows of the metric, once the ``watermark`` has passed its time, gives a row of its own, which has no series: what a
    sweep closure is told.  Keyed by metric; chain ``running_totals`` in a second query for totals by series.
    """
    keyed = series_text(obs.withWatermark("ts", watermark)).select("metric", "series", cycle_of(F.col("ts"), sweep_seconds).alias("cycle"), "ts", F.unix_micros("ts").alias("at"), "seq", "value_l")
    return keyed.groupBy("metric").transformWithStateInPandas(statefulProcessor=CapAndEvict(max_series, max_staleness, sweep_seconds * 1000), outputStructType=ADMITTED, outputMode="Append", timeMode="EventTime")
