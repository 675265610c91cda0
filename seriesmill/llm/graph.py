"""Connected components: of an edge table as DataFrame operations, of one tile in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least reachable number of each of n nodes over the links (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge, component = its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step
    re-links a node's neighbours to the least of them, so the edge count never
    grows and the rounds are about the square of the logarithm of the size of a
    component.  A hot node's neighbours are reduced by a partial ``min``; the join that follows
    is one that adaptive execution can split.  Every round is written to the
    shared folder, so a lost executor costs a round at most.

    Null nodes, self-loops and repeated edges are ignored.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    pairs, before = materialize(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        # Converged when both steps leave the edges as they are: all stars then.
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        pairs, before = after, state
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
