"""Mixing sources to target weights by fitting a word budget exactly.

Targets come from weights by water-filling.  Each source then takes whole
documents: full passes first, and for what is left a number of documents of each
length, found from the counts of documents by exact length.  The same share of
all lengths comes first, rounded along the lengths; the remaining budget, no more than a few times
the longest length, is a bounded knapsack solved by dynamic programming.  Which
documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .text import word_counts

#: Words that the dynamic programme of a source is tried on, where the usual few times the
#: longest length do not meet the budget.
DP_WORDS = 1 << 16

#: Sums that it holds at most: beyond them it counts in units of more than a word.
DP_CELLS = 1 << 22

#: Hash ranges in which the documents of a source and length are counted.
RANGES = 1 << 12


def text_sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(id, source, size)`` for every row, size in words; a null text has none."""
    types = dict(docs.dtypes)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(word_counts(b.column(2)), pa.int64())], names=["id", "source", "size"])

    return docs.select(id_col, source_col, text_col).mapInArrow(sizes, f"id {types[id_col]}, source {types[source_col]}, size bigint")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """``(source, source_size, target)`` by water-filling.

    Sources sorted by code point, null last, get ``weights`` in turn.  All targets
    sum to ``share`` times all sizes; a target stops at ``cap`` times its source's
    size and the excess is shared again by weight until none is above.  Each round
    is two sums over the sources, of which only the totals reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.lit(float(cap)) * F.col("source_size")
    level = 0.0
    budget = float(share) * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:
        full = F.lit(level) * F.col("weight") >= limit
        fixed, open_weight, n = table.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if not open_weight:
            break
        higher = max(0.0, (budget - fixed) / open_weight)
        # The level only rises, and each rise fills another source or is the last.
        if higher <= level:
            break
        again = table.agg(F.count_if(F.lit(higher) * F.col("weight") >= limit)).first()[0]
        level = higher
        if again == n:
            break
    return table.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), limit).alias("target"))


def proportional(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each length (rising) that come to ``budget`` words by the same share of all.

    The running number of documents is rounded, not each length's own: up to any length the
    documents are within one of their share, and so the words are within one longest document of ``budget``.
    """
    total = int((lengths * counts).sum())
    # Without overflow: Python's integers.
    upto = [(2 * c * budget + total) // (2 * total) for c in np.cumsum(counts).tolist()]
    return np.diff(np.array(upto, np.int64), prepend=0)


def nearest_sum(lengths: np.ndarray, spare: np.ndarray, rest: int) -> np.ndarray:
    """Documents of each length, at most ``spare``, whose words come nearest to ``rest``:
    a bounded knapsack.  All lengths are positive."""
    chosen = np.zeros(len(lengths), np.int64)
    if rest <= 0 or not (spare > 0).any():
        return chosen
    # The nearest sum from above is one shortest document from some sum below, at most.
    most = rest + int(lengths[spare > 0].min())
    # reach[s]: the part (so many documents of one length) that first made the sum s.
    reach, parts, bits, mask = np.zeros(most + 1, np.int32), [], 1, (1 << (most + 1)) - 1
    spare, step = np.minimum(spare, most // lengths), 1
    # Lengths in a fixed random order, one document of each before two of any: neither short nor long ones come first.
    order = np.random.default_rng(len(lengths)).permutation(len(lengths))
    while not bits >> rest & 1 and (spare > 0).any():
        for i in order[spare[order] > 0].tolist():
            n = min(step, int(spare[i]))
            new = (bits << (n * int(lengths[i]))) & mask & ~bits
            if new:
                parts.append((i, n))
                sums = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                reach[np.flatnonzero(sums)] = len(parts)
                bits |= new
                if bits >> rest & 1:
                    break
        spare = np.maximum(spare - step, 0)
        step *= 2
    below = (bits & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = bits >> rest
    over = (above & -above).bit_length() - 1 if above else most
    s = rest + over if over < rest - below else below
    while s:
        i, n = parts[reach[s] - 1]
        chosen[i] += n
        s -= n * int(lengths[i])
    return chosen


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS, dp_cells: int = DP_CELLS) -> np.ndarray:
    """How many documents of each length (rising) to take so that their words come near
    ``budget``; at most ``counts`` of each.

    The same share of all lengths first, up to a few times the longest length, then a
    bounded knapsack over all the rest.  If that does not meet the budget, the
    programme gets twice the rest, up to ``dp_words``, and the nearest fit stays.
    """
    lengths, counts = lengths.astype(np.int64), np.where(lengths > 0, counts, 0).astype(np.int64)
    best = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return best
    if budget >= total:
        return counts.copy()
    some = np.flatnonzero(counts)
    size, counts = lengths[some], counts[some]
    off, room = budget, 4 * int(size[-1])
    while True:
        taken = proportional(size, counts, max(0, budget - room))
        rest = budget - int((size * taken).sum())
        # Units of more than a word only if the longest documents are longer than dp_cells / 8 words.
        while (unit := -(-rest // dp_cells)) > 1:
            more = nearest_sum(-(-size // unit), counts - taken, rest // unit)
            left = rest - int((size * more).sum())
            if not more.any() or left < 0:
                break
            taken, rest = taken + more, left
        unit = unit if unit > 1 else int(np.gcd.reduce(size))
        taken = taken + nearest_sum(-(-size // unit), counts - taken, (2 * rest + unit) // (2 * unit))
        miss = abs(budget - int((size * taken).sum()))
        if miss < off or not best.any():
            best[some], off = taken, miss
        room *= 2
        if off < unit or room >= 2 * budget or room > max(dp_words, 4 * int(size[-1])):
            return best


def mix_sources(docs: DataFrame, *, weights: list[float], share: float, cap: int, seed: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(id, source, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` is the words that the mix takes of the document, 0 or a multiple of
    its size up to ``cap`` times it.  A source's whole passes are the integer part
    of target over size; the rest is fitted by ``fit_counts``.  Within a source and
    length, documents are taken in the order of a seeded hash of the id, ties by
    id: reruns agree whatever the partitioning.  Null ids, sources and texts are
    ordinary values; repeated rows are documents of their own; empty texts are
    never taken.  An empty table gives an empty table.

    A source or length that holds most rows is counted by hash ranges with partial
    sums; only the one range in which the cut falls is ordered.
    """
    sizes = materialize(text_sizes(docs, id_col, source_col, text_col), "sizes")
    targets = materialize(source_targets(sizes, weights, share, cap), "targets")
    low = F.xxhash64(F.lit(seed), "id")
    rows = sizes.withColumn("order", low).withColumn("range", F.pmod(F.shiftright(F.col("order"), 40), F.lit(RANGES)).cast("int"))
    counted = rows.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "ranges")
    by_length = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        target, size = float(pdf.target.iloc[0]), int(pdf.source_size.iloc[0])
        passes = int(min(cap, target // size)) if size else 0
        budget = round(target - passes * size) if passes < cap else 0
        extra = fit_counts(pdf["size"].to_numpy(), pdf.n.to_numpy(), budget)
        return pd.DataFrame({"s": pdf.source, "z": pdf["size"], "source_size": size, "target": target, "passes": passes, "extra": extra})

    kind = dict(docs.dtypes)[source_col]
    joined = by_length.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fitted = materialize(joined.groupBy("source").applyInPandas(fit, f"s {kind}, z bigint, source_size bigint, target double, passes bigint, extra bigint"), "fitted")

    # The range in which the cut falls: those below are taken whole.
    w = Window.partitionBy("source", "size").orderBy("range")
    cuts = counted.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    cuts = cuts.join(fitted, same).select("s", "z", F.col("range").alias("r"), "source_size", "target", "passes", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("quota"), "n")
    marked = rows.join(cuts, same & (F.col("range") == F.col("r"))).drop("s", "z", "r")
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    whole = marked.where(~split).withColumn("more", F.col("quota") > 0)
    rank = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("order", "id"))
    part = marked.where(split).withColumn("more", rank <= F.col("quota"))
    times = F.col("passes") + F.col("more").cast("bigint")
    return whole.unionByName(part).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (times * F.col("size")).alias("taken"))
