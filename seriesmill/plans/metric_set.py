"""A declared set of metrics and its exports, each a single plan.

``MetricSet`` is the schema: fields in export order with their kinds.  Given
observations it aggregates all metrics in one pass (``plans.fused``) and projects the
series to any format.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import numbers
from seriesmill.functions.labels import LabelDomain
from seriesmill.operators import aggregate, cardinality, exposition, otel, otlp_proto, temporality
from seriesmill.plans import fused

#: Kinds by what is aggregated; a labeled form has a domain, a dynamic form keeps the label sets.
KINDS = ("counter", "gauge", "gauge_f64", "max_gauge", "max_gauge_f64", "min_gauge", "min_gauge_f64", "gauge_i64", "histogram", "distribution", "timer")


@dataclass(frozen=True)
class MetricSpec:
    field: str
    kind: str
    help: str | None = None
    bounds: tuple[int, ...] = ()
    domain: LabelDomain | None = None
    dynamic: bool = False
    max_series: int = cardinality.DEFAULT_MAX_SERIES
    stride: int = 1
    initial: float | int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no such kind of metric: {self.kind}")
        if self.domain and self.dynamic:
            raise ValueError("a metric has a closed domain or dynamic labels, not both")
        if self.kind == "histogram" and not self.bounds:
            object.__setattr__(self, "bounds", numbers.LATENCY_BOUNDS_US)
        if self.kind == "timer" and not self.bounds:
            object.__setattr__(self, "bounds", numbers.LATENCY_BOUNDS_NS)

    @property
    def family(self) -> str:
        return "gauge" if "gauge" in self.kind else self.kind


#: A projection of one metric's series: (series, spec, exported name) to lines or rows.
Projection = Callable[[DataFrame, MetricSpec, str], DataFrame]


@dataclass
class MetricSet:
    specs: Sequence[MetricSpec]
    prefix: str = ""
    strict_compat: bool = False
    projections: dict[str, Projection] = field(default_factory=dict)
    #: How DogStatsD's sample rates are written.
    rate_text: Callable[[Column], Column] = numbers.float_text
    _held: list[DataFrame] = field(default_factory=list, init=False, repr=False, compare=False)

    def name(self, spec: MetricSpec, separator: str = "_") -> str:
        return f"{self.prefix}{separator}{spec.field}" if self.prefix else spec.field

    def register(self, kind: str, projection: Projection) -> None:
        """A projection of one's own for a kind, used by ``project``."""
        self.projections[kind] = projection

    def __post_init__(self):
        fields = [s.field for s in self.specs]
        if len(set(fields)) < len(fields):
            raise ValueError("a metric is declared once")

    # Series

    def series(self, obs: DataFrame, spec: MetricSpec, by: Sequence[str] = ()) -> DataFrame:
        """The metric's series, one row each, with the columns of its kind.

        ``by``: further grouping columns, such as an export window.  Dynamic metrics go
        through the cardinality cap first; labeled ones have a row for every member of
        their domain (without ``by``).  All metrics of the set are read together.
        """
        return self._series(self.fused(obs, by), spec, by)

    def fused(self, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """The states of all metrics' series from one pass over the observations, kept by Spark's cache.

        ``release`` drops what is kept.
        """
        out = fused.fuse(obs, self.specs, by, self._held)
        self._held.append(out)
        return out

    def release(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    def _series(self, states: DataFrame, spec: MetricSpec, by: Sequence[str] = ()) -> DataFrame:
        mine = states.where(F.col("metric_order") == list(self.specs).index(spec))
        keys = [*by]
        if spec.domain:
            mine = mine.withColumn(spec.domain.label_name, F.col("labels")[spec.domain.label_name])
            keys.append(spec.domain.label_name)
        if spec.dynamic or spec.domain:
            keys.append("labels")
        return mine.select(*keys, *fused.columns(spec))

    @staticmethod
    def _labels(spec: MetricSpec) -> str | None:
        return "labels" if spec.dynamic or spec.domain else None

    # Exports

    @staticmethod
    def _numbered(parts: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.select(F.lit(i).alias("metric_order"), "*") for i, p in enumerate(parts)])

    def export_prometheus(self, obs: DataFrame) -> DataFrame:
        """``(metric_order, series, pos, line)``; cumulative."""
        parts, states = [], self.fused(obs)
        for spec in self.specs:
            s, name, kw = self._series(states, spec), self.name(spec), {"help_": spec.help or spec.field, "labels": self._labels(spec), "strict_compat": self.strict_compat}
            match spec.family:
                case "counter":
                    parts.append(exposition.prometheus_counter(s, name, **kw))
                case "gauge":
                    parts.append(exposition.prometheus_gauge(s, name, **kw))
                case "histogram":
                    parts.append(exposition.prometheus_histogram(s, name, spec.bounds, **kw))
                case "distribution":
                    parts.append(exposition.prometheus_summary(s, name, **kw))
                case "timer":
                    parts += exposition.prometheus_timer(s, name, spec.bounds, **kw)
        return self._numbered(parts)

    def _dogstatsd(self, s: DataFrame, spec: MetricSpec, tags: dict[str, str] | None, keep: Sequence[str] = (), zeros_last: bool = False) -> DataFrame:
        name, labels = self.name(spec, "."), self._labels(spec)
        kw = {"labels": labels, "tags": tags, "keep": keep}
        match spec.family:
            case "counter":
                return exposition.dogstatsd_counter(s, name, **kw)
            case "gauge":
                return exposition.dogstatsd_gauge(s, name, **kw)
            case "histogram":
                return exposition.dogstatsd_histogram(s, name, **kw)
            case "timer":
                return exposition.dogstatsd_timer(s, name, **kw)
        samples = aggregate.exponential_samples(s, [*keep, *([labels] if labels else [])])
        if zeros_last:
            samples = samples.withColumn("pos", F.when(F.col("pos") == -1, 64).otherwise(F.col("pos")))
        return exposition.dogstatsd_distribution(samples, name, **kw, rate_text=self.rate_text)

    def export_dogstatsd(self, obs: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
        """``(metric_order, series, pos, line)`` of running totals."""
        states = self.fused(obs)
        return self._numbered([self._dogstatsd(self._series(states, spec), spec, tags) for spec in self.specs])

    def export_dogstatsd_delta(self, obs: DataFrame, window: str, tags: dict[str, str] | None = None) -> DataFrame:
        """``(metric_order, window, series, pos, line)``: what each window adds.

        A window (a whole number) is aggregated on its own, which is the delta of its
        totals; gauges have their value in the window.  Counters, histograms and timers have a line of
        zeros in every later window up to the last of all, and members of a closed domain
        in every window; distributions have none.
        """
        states, parts = self.fused(obs, [window]), []
        span = states.agg(F.min(window).alias("first"), F.max(window).alias("last"))
        for spec in self.specs:
            s = self._series(states, spec, [window])
            if spec.family in ("counter", "histogram", "timer"):
                fill = dict.fromkeys({"counter": ("sum",), "histogram": ("count", "sum"), "timer": ("calls", "sample_count", "sample_sum")}[spec.family], F.lit(0).cast("bigint"))
                labels = self._labels(spec)
                members = None
                if spec.domain:
                    label = spec.domain.label_name
                    members = spec.domain.frame(obs.sparkSession).withColumnRenamed("value", label).select(otel.label_attributes(label).alias("labels"))
                s = temporality.zero_fill(s.select(window, *([labels] if labels else []), *fill), labels, window, span, fill, members)
            parts.append(self._dogstatsd(s, spec, tags, [window], zeros_last=True))
        return self._numbered(parts)

    def export_clickhouse(self, obs: DataFrame, resource: otel.Resource) -> dict[str, DataFrame]:
        """The four OTel row tables; tables that no metric feeds are absent."""
        parts: dict[str, list[DataFrame]] = {}
        states = self.fused(obs)
        for spec in self.specs:
            s, name, labels, text = self._series(states, spec), self.name(spec), self._labels(spec), spec.help or spec.field
            match spec.family:
                case "counter":
                    parts.setdefault(otel.SUM, []).append(otel.sum_rows(s, resource, name, "sum", text, labels))
                case "gauge":
                    parts.setdefault(otel.GAUGE, []).append(otel.gauge_rows(s, resource, name, "value", text, labels))
                case "histogram":
                    parts.setdefault(otel.HISTOGRAM, []).append(otel.histogram_rows(s, resource, name, spec.bounds, text, labels))
                case "distribution":
                    parts.setdefault(otel.EXP_HISTOGRAM, []).append(otel.exponential_rows(s, resource, name, text, labels))
                case "timer":
                    calls, samples = otel.timer_rows(s, resource, name, spec.bounds, text, labels)
                    parts.setdefault(otel.SUM, []).append(calls)
                    parts.setdefault(otel.HISTOGRAM, []).append(samples)
        return {table: reduce(DataFrame.unionByName, dfs) for table, dfs in parts.items()}

    def _otlp(self, obs: DataFrame, resource: otel.Resource, of: Callable[..., DataFrame]) -> list[DataFrame]:
        """``of`` (one of ``otel.metric_json`` and ``otel.metric_points``) for every metric."""
        parts, at, states = [], resource.time_unix_nano, self.fused(obs)
        for spec in self.specs:
            s, name, labels, text = self._series(states, spec), self.name(spec), self._labels(spec), spec.help or spec.field
            match spec.family:
                case "counter":
                    parts.append(of(s, "sum", name, at, "sum", description=text, labels=labels))
                case "gauge":
                    parts.append(of(s, "gauge", name, at, "value", description=text, labels=labels))
                case "histogram":
                    parts.append(of(s, "histogram", name, at, bounds=spec.bounds, description=text, labels=labels))
                case "distribution":
                    parts.append(of(s, "exponential", name, at, description=text, labels=labels))
                case "timer":
                    samples = s.drop("sum").withColumnsRenamed({"sample_sum": "sum", "sample_count": "count"})
                    parts.append(of(s, "sum", name + ".calls", at, "calls", description=text + " total calls", labels=labels))
                    parts.append(of(samples, "histogram", name + ".samples", at, bounds=spec.bounds, description=text + " sampled latency in nanoseconds", labels=labels))
        return parts

    def export_otlp(self, obs: DataFrame, resource: otel.Resource) -> DataFrame:
        """``json``: one OTLP metric a row, of many series over several; dynamic metrics without series are left out."""
        return reduce(DataFrame.unionByName, self._otlp(obs, resource, otel.metric_json))

    def export_otlp_requests(self, obs: DataFrame, resource: otel.Resource, limit: int = otel.REQUEST_BYTES) -> DataFrame:
        """``(request, n_points, json)``: export requests of at most ``limit`` bytes, metrics of many series cut over several."""
        return otel.bounded_requests(reduce(DataFrame.unionByName, self._otlp(obs, resource, otel.metric_points)), resource, limit)

    def export_otlp_protobuf(self, obs: DataFrame, resource: otel.Resource, limit: int = otel.REQUEST_BYTES) -> DataFrame:
        """``(request, n_points, body)``: the same in Protocol Buffers, as OTLP's receivers take it by default."""
        return otlp_proto.metric_requests(reduce(DataFrame.unionByName, self._otlp(obs, resource, otlp_proto.points)), resource, limit)

    def project(self, obs: DataFrame) -> DataFrame:
        """The registered projections of every metric whose kind has one, together."""
        states = self.fused(obs)
        parts = [self.projections[s.kind](self._series(states, s), s, self.name(s)) for s in self.specs if s.kind in self.projections]
        return reduce(DataFrame.unionByName, parts)

    def overflow_warnings(self, obs: DataFrame) -> DataFrame:
        """Rows of dynamic metrics that were redirected to their overflow series."""
        parts = [cardinality.overflow_stats(obs.where(F.col("metric") == s.field), s.max_series) for s in self.specs if s.dynamic]
        return reduce(DataFrame.unionByName, parts).where("overflow_records > 0")
