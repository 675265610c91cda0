"""Counters of a plan as it runs: redirected rows, spans sampled out and dropped.

They are Spark's observed metrics: aggregates of the rows that pass a point of the plan, so no second scan is
made for them.  A batch hands them to an ``Observation``, a stream to a listener after each micro-batch.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def overflow_counts(redirected: str = "redirected") -> dict[str, Column]:
    """What to count of the output of a cap: rows that went to the overflow series, and all rows."""
    return {"overflow_records": F.count_if(F.col(redirected)), "records": F.count(F.lit(1))}


def span_counts(recorded: str = "recorded", parent: str = "parent_span_id") -> dict[str, Column]:
    """What to count of marked spans: roots recorded, roots sampled out, and all rows that are kept."""
    root = F.col(parent).isNull()
    return {"recorded_count": F.count_if(root & F.col(recorded)), "sampled_out_count": F.count_if(root & ~F.col(recorded)), "len": F.count_if(F.col(recorded))}


def counted(df: DataFrame, name: str | Observation, counts: dict[str, Column]) -> DataFrame:
    """``df``, with the counts taken of its rows as they pass."""
    return df.observe(name, *[c.alias(n) for n, c in counts.items()])


class StreamCounters(StreamingQueryListener):
    """Adds up the counts of every micro-batch, by name: ``totals[name][count]``.  ``spark.streams.addListener`` it."""

    def __init__(self):
        self.totals: dict[str, Counter] = defaultdict(Counter)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            self.totals[name].update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
