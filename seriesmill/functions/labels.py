"""Label sets: canonical form, rendering, and closed label domains."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The label of the overflow series.
OVERFLOW_KEY, OVERFLOW_VALUE = "__ft_overflow", "true"


def from_pairs(pairs: Column) -> Column:
    """Canonical label map of an array of (key, value) structs: the last value of a key
    wins, keys in byte order.  Independent of the session's policy for repeated keys.
    """
    numbered = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("k"), i.alias("i"), p["value"].alias("v")))
    ordered = F.array_sort(numbered)
    last = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["k"] != x["k"], F.lit(True)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def canonical(labels: Column) -> Column:
    """The label map with its keys in byte order; a null map is the empty one."""
    entries = F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))
    return F.map_from_entries(entries)


def series_key(labels: Column) -> Column:
    """An orderable identity of a label set: its sorted entries."""
    return F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))


def fingerprint(labels: Column) -> Column:
    """A compact 64-bit key of a label set, independent of the order of its keys."""
    return F.xxhash64(series_key(labels))


def overflow_labels() -> Column:
    return F.create_map(F.lit(OVERFLOW_KEY), F.lit(OVERFLOW_VALUE))


def label_map(**columns: Column | str) -> Column:
    """A label map of columns, keys sorted."""
    return F.create_map(*[x for k in sorted(columns) for x in (F.lit(k), F.col(columns[k]).cast("string") if isinstance(columns[k], str) else columns[k].cast("string"))])


def escape_prometheus(value: Column) -> Column:
    """Backslash, double quote and line feed escaped as the text format asks."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus_labels(labels: Column, strict_compat: bool = False) -> Column:
    """``k="v"`` joined by commas; unescaped with ``strict_compat``."""
    value = (lambda v: v) if strict_compat else escape_prometheus
    return F.array_join(F.transform(series_key(labels), lambda e: F.concat(e["key"], F.lit('="'), value(e["value"]), F.lit('"'))), ",")


def dogstatsd_tags(labels: Column) -> Column:
    """``k:v`` joined by commas."""
    return F.array_join(F.transform(series_key(labels), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")


def snake_case(name: str) -> str:
    """An underscore before every capital but the first character, then lower case."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def snake_case_column(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))


@dataclass(frozen=True)
class LabelDomain:
    """A closed one-column domain: members in declaration order."""

    label_name: str
    values: tuple[str, ...]

    def __post_init__(self):
        if not self.label_name:
            raise ValueError("a label domain needs a label name")
        if not self.values:
            raise ValueError("a label domain needs at least one member")

    @property
    def cardinality(self) -> int:
        return len(self.values)

    def index_of(self, value: str) -> int:
        return self.values.index(value)

    def from_index(self, index: int) -> str:
        """The member at the index; beyond the end, the last one."""
        return self.values[index] if 0 <= index < len(self.values) else self.values[-1]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(idx, value)``; its size is that of the declaration."""
        return spark.createDataFrame(list(enumerate(self.values)), "idx int, value string")


def domain_of(members: type[Enum], label_name: str, overrides: dict[str, str] | None = None) -> LabelDomain:
    """The domain of a Python Enum: snake-case member names unless overridden."""
    overrides = overrides or {}
    return LabelDomain(label_name, tuple(overrides.get(m.name, snake_case(m.name)) for m in members))
