"""Stride sampling of timers, and adaptive head sampling of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.ranks import row_numbers

#: Queue occupancy up to which each sampling shift holds.
OCCUPANCY_SHIFTS = ((0.25, 0), (0.50, 5), (0.75, 6))
FULL_SHIFT = 7


def stride_mask(stride: int) -> int:
    """0 counts as 1; rounded up to a power of two, less one."""
    return (1 << (max(stride, 1) - 1).bit_length()) - 1


def stride_sample(obs: DataFrame, stride: int, producer: str = "producer", order: tuple[str, ...] = ("ts", "seq"), name: str = "sampled") -> DataFrame:
    """Marks every stride-th call of a producer, over all of its timers together.

    Calls are counted first, so that those of a busy producer are numbered in ranges of their order.
    """
    if not stride_mask(stride):
        return obs.withColumn(name, F.lit(True))
    numbered = row_numbers(obs, [producer], list(order), "_place")
    return numbered.withColumn(name, F.col("_place").bitwiseAND(F.lit(stride_mask(stride))) == 0).drop("_place")


def shift_of(occupancy: Column) -> Column:
    """The sampling shift for a queue's occupancy, 0 to 1."""
    out = None
    for most, shift in OCCUPANCY_SHIFTS:
        out = F.when(occupancy <= most, shift) if out is None else out.when(occupancy <= most, shift)
    return out.otherwise(FULL_SHIFT)


def adaptive_sample(roots: DataFrame, occupancy: str, producer: str = "producer", order: tuple[str, ...] = ("ts", "seq"), name: str = "recorded") -> DataFrame:
    """Replays head sampling of root spans: all at shift 0, else every 2**shift-th of a
    producer's roots.  ``occupancy`` holds for the row's time."""
    roots, seen = row_numbers(roots, [producer], list(order), "_place"), F.col("_place")
    shift = shift_of(F.col(occupancy))
    every = F.element_at(F.array(*[F.lit(1 << s) for s in range(FULL_SHIFT + 1)]), shift + 1)
    return roots.withColumn(name, (shift == 0) | (seen % every == 0)).drop("_place")
