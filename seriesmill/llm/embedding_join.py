"""Exact metric range join of embeddings by cosine.

On unit vectors, a cosine of c or more is a Euclidean distance of
r = sqrt(2 - 2c) or less, so the join is a metric range join.  Every vector
belongs to the cell of its nearest pivot.  If u, at home in cell A, is within r
of v, at home in B, then d(v, A) <= d(u, A) + r <= d(u, B) + r <= d(v, B) + 2r by
the triangle inequality: v is copied to the cells of lower number whose pivots
are that near, and no pair is missed or met twice.  Cells then join on their
own, in tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, least_labels
from .skew import join_hot
from .storage import materialize

#: Rows of a matrix product at once.
_ROWS = 1024


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    """Rows of equal length as a matrix in double precision, each scaled by a power of two to
    about 1: that changes no cosine, and squares neither overflow nor vanish."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def home_and_copies(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit vector's home cell, and ``(row, cell)`` of the copies it needs."""
    distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * vectors @ pivots.T))
    home = distance.argmin(axis=1)
    near = distance[np.arange(len(home)), home]
    # The bisector of two pivots is the tighter bound of the two on the sphere.
    apart = np.sqrt(np.maximum(1e-18, 2.0 - 2.0 * pivots @ pivots.T))[home]
    beyond = np.maximum((distance - near[:, None]) / 2, (distance**2 - near[:, None] ** 2) / (2 * apart))
    copy = (beyond <= radius + 1e-9) & (np.arange(len(pivots)) < home[:, None])
    return home, *np.nonzero(copy)


def tile_links(left: np.ndarray, right: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (i, j) of two matrices, or of one with itself (i < j)."""
    other = left if right is None else right
    a, b, found = _norms(left), _norms(other), []
    for lo in range(0, len(left), _ROWS):
        dots = left[lo : lo + _ROWS] @ other.T
        i, j = np.nonzero(dots / (a[lo : lo + _ROWS, None] * b) >= cosine)
        keep = slice(None) if right is not None else i + lo < j
        found.append((i[keep] + lo, j[keep]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def near_duplicates(vectors: DataFrame, *, cosine: float, cell_size: int, tile_size: int, max_cells: int = 1024, seed: int = 20240229, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors link when their cosine in double precision is ``cosine`` or more.
    ``n_links`` counts the other rows linked directly; ``component_id`` is the
    least id reachable; ``kept`` marks the row whose id that is.  Null, empty and
    zero vectors, those with null or non-finite components, and vectors of different
    lengths link with nothing.  Equal vectors are one class
    from the start: copies cost a count, not pairs.  Null ids are rows like
    others but never name a component unless all ids in it are null.

    There is a pivot for every ``cell_size`` distinct vectors, ``max_cells`` at most, drawn by a
    seeded hash: what the driver and every task hold of them is bounded.
    A cell of any size is joined in tiles of at most ``tile_size`` by ``tile_size``
    rows about, each a task's group; a tile returns one row per linked vector, not its
    pairs.  Vectors without any metric structure meet in almost every cell, and
    the work is then that of all tiles.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    good = rows.where(usable(F.col("v")))
    classes = good.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    radius = math.sqrt(2 - 2 * cosine)
    n = classes.count()
    wanted = min(max_cells, max(1, math.ceil(n / cell_size)))
    drawn = classes.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(wanted).toPandas()["v"]
    pivots: dict[int, list] = {}
    for v in drawn:
        u = np.asarray(v, np.float64)
        u = u / np.abs(u).max()
        pivots.setdefault(len(u), []).append(u / np.linalg.norm(u))
    pivots = {d: np.array(p) for d, p in pivots.items()}
    kind = dict(classes.dtypes)["v"]

    def deal(batches):
        for b in batches:
            length = np.diff(b.column(2).offsets.to_numpy())
            for d in np.unique(length):
                part = b.take(pa.array(np.flatnonzero(length == d)))
                m = _matrix(part.column(2))
                unit = m / _norms(m)[:, None]
                # A length without a pivot of its own is one cell, tiled like any.
                home, row, cell = home_and_copies(unit, pivots.get(int(d), unit[:1] * 0), radius)
                take = pa.array(np.concatenate([np.arange(len(home)), row]))
                out = part.take(take)
                cells = np.concatenate([home, cell]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(cells), d, np.int32)), pa.array(cells), pa.array(np.arange(len(cells)) < len(home))], names=["cls", "m", "v", "d", "cell", "home"])

    dealt = classes.select("cls", "m", "v").mapInArrow(deal, f"cls bigint, m bigint, v {kind}, d int, cell int, home boolean")
    dealt = dealt.withColumn("place", F.struct("d", "cell"))
    sizes = dealt.groupBy("place").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("copies"))
    sizes = materialize(sizes, "cells")
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / tile_size)).cast("int")
    dealt = join_hot(dealt, sizes.select("place", parts("homes").alias("hs"), parts("copies").alias("cs"), "copies"), "place", sizes.select("place", (F.col("homes") + F.col("copies")).alias("n")))
    of = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    spot = lambda kind, i, j, left: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # Home blocks meet each other (i <= j); every home block meets every block of copies.
    as_left = F.transform(F.sequence(F.col("b"), F.col("hs") - 1), lambda j: spot("home", F.col("b"), j, True))
    as_right = F.transform(F.filter(upto("hs"), lambda i: i < F.col("b")), lambda i: spot("home", i, F.col("b"), False))
    to_copies = F.when(F.col("copies") > 0, F.transform(upto("cs"), lambda j: spot("copy", F.col("b"), j, True))).otherwise(F.array().cast("array<struct<kind:string,i:int,j:int,left:boolean>>"))
    copied = F.transform(upto("hs"), lambda i: spot("copy", i, F.col("b"), False))
    dealt = dealt.withColumn("b", F.when(F.col("home"), of("hs")).otherwise(of("cs")))
    tiles = dealt.select("cls", "m", "v", "d", "cell", F.explode(F.when(F.col("home"), F.concat(as_left, as_right, to_copies)).otherwise(copied)).alias("t")).select("cls", "m", "v", "d", "cell", "t.*")

    def join_tile(table: pa.Table) -> pa.Table:
        left = table.filter(table["left"])
        right = table.filter(pc.invert(table["left"]))
        alone = table["kind"][0].as_py() == "home" and table["i"][0].as_py() == table["j"][0].as_py()
        both = left if alone else pa.concat_tables([left, right])
        if not len(left) or not (alone or len(right)):
            i = j = np.empty(0, np.int64)
        else:
            i, j = tile_links(_matrix(left["v"]), None if alone else _matrix(right["v"]), cosine)
            j = j if alone else j + len(left)
        cls, m = both["cls"].to_numpy(), both["m"].to_numpy()
        links = np.bincount(i, weights=m[j], minlength=len(cls)) + np.bincount(j, weights=m[i], minlength=len(cls))
        label = least_labels(len(cls), i, j)
        some = np.flatnonzero(links)
        return pa.table({"a": cls[some], "b": cls[label[some]], "links": links[some].astype(np.int64)})

    # Dealt by the tile, not only by the cell as the rows already are.
    tiles = tiles.repartition("d", "cell", "kind", "i", "j")
    linked = tiles.groupBy("d", "cell", "kind", "i", "j").applyInArrow(join_tile, "a bigint, b bigint, links bigint")
    linked = materialize(linked, "links")
    component = connected_components(linked).withColumnRenamed("node", "cls")
    degree = linked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cls")
    named = classes.join(degree, "cls", "left").join(component, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_component = component.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    named = join_hot(named, least, "component", of_component).select("v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = join_hot(good, named, "v", classes.select("v", F.col("m").alias("n"))).select("id", "n_links", "component_id")
    rest = rows.where(~usable(F.col("v"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("id", id_col)
