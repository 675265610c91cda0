"""Joins in which one key may hold a large share of the rows.

Adaptive execution splits such a key only where both sides are sorted and merged
and the partition is large; here its rows are dealt over slices whatever the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: No slice has more than this part of the rows, about; fewer keys than this are hot.
SLICES = 1024


def hot_keys(counts: DataFrame, key: str, slices: int = SLICES) -> DataFrame:
    """``(key, _slices)`` of the keys with more than one in ``slices`` of all rows; ``counts`` is
    ``(key, n)``, a row for each key.  There are fewer than ``slices`` such keys at any size of the table."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = F.ceil(F.col("n") * slices / max(1, total)).cast("int")
    return materialize(counts.select(key, part.alias("_slices")).where("_slices > 1"), "hot")


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner", slices: int = SLICES) -> DataFrame:
    """``left`` joined to ``right`` by ``key``, ``how`` being inner or left.

    ``counts`` has the rows of ``left`` by key, ``(key, n)``.  Rows of a hot key are dealt over
    slices in turn, and its rows on the right are copied to each: fewer than two copies for each of
    ``slices`` all told, if keys are unique there.  Only the hot keys are broadcast.  Null keys meet nothing.
    """
    hot = F.broadcast(hot_keys(counts, key, slices))
    n = F.coalesce("_slices", F.lit(1))
    left = left.join(hot, key, "left").withColumn("_slice", F.pmod(F.monotonically_increasing_id(), n).cast("int")).drop("_slices")
    right = right.join(hot, key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), n - 1))).drop("_slices")
    return left.join(right, [key, "_slice"], how).drop("_slice")
