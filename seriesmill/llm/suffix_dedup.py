"""Removal of passages that occur before, by suffix sorting in buckets.

A suffix is looked at to a depth of ``width`` bytes, a window.  Every document is cut
into segments: runs of windows whose least-hashed gram (a substring of ``gram``
bytes) is the same one, so equal windows have equal grams, and a segment's text
carries some thirty windows.  Segments meet by their gram:

1. A gram that only one segment has holds no repeated window, and of segments alike
   in all bytes only the first one can have a first occurrence: both are decided by
   hashes, without their texts.
2. The texts of the rest are dealt to buckets by gram.  A bucket is suffix-sorted on
   its own: first the ranks of the suffixes at the places of a difference cover, with
   the lengths of their common prefixes; then all suffixes, one range of first
   bytes at a time, by as many bytes as the cover has a period; and ties by the ranks at
   the place that the cover has in common for both.  Memory is that of a bucket.
3. All windows of a class but the first are repeats; their bytes are cut out.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import TEXT_LEVEL, dealt_rows
from .skew import SLICES, join_hot
from .storage import materialize, new_path
from .text import BYTE, _Powers, byte_slices, mix, release, string_bytes

# A perfect difference set, every difference modulo the period is that of two of its members.
COVER, PERIOD = (0, 1, 3, 13, 32, 36, 43, 52), 57
#: Values of bytes for the hash of a whole segment.
OTHER = np.random.default_rng(57).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Blocks looked at for frequent grams, and segments in these that such a gram has at least.
DRAWN, LEAST_ROWS = 32, 1000
#: Windows whose grams are looked at together, and suffixes sorted at a time.
PIECE, RANGE = 1 << 20, 1 << 17


def _shifts() -> np.ndarray:
    """For two residues, how far to go until both are in the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    inside = np.isin(np.arange(PERIOD), COVER)
    for s in range(PERIOD - 1, -1, -1):
        at = np.roll(inside, -s)
        out[np.ix_(at, at)] = s
    return out


SHIFT = _shifts()


# Segments


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, files_bytes: int) -> DataFrame:
    """``(block, ids, sizes, data)``: documents as they are read, packed to blocks; written once, bucketed
    by block, so what is found out about a block is joined to it without moving texts again."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def pack(batches):
        first, seq = TaskContext.get().partitionId() << 24, 0
        compress = zstandard.ZstdCompressor(level=TEXT_LEVEL).compress
        ids, sizes, data, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([first + seq], pa.int64()), pa.array([pa.concat_arrays(ids)], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([compress(b"".join(data))], pa.binary())],
                names=["block", "ids", "sizes", "data"],
            )

        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), block_bytes // 8):
                raw, offsets = string_bytes(batch.column(1).slice(lo, hi - lo))
                ids.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(np.diff(offsets))
                data.append(raw.tobytes())
                held += len(raw)
                if held >= block_bytes:
                    yield row()
                    ids, sizes, data, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield row()

    packed = texts.mapInArrow(pack, "block bigint, ids array<bigint>, sizes array<bigint>, data binary")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files, name = max(1, math.ceil(total / files_bytes)), f"seriesmill_{uuid.uuid4().hex}"
    spark = docs.sparkSession
    packed.repartition(files, "block").write.bucketBy(files, "block").option("path", new_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def _block_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bytes, offsets and ids of a block's documents."""
    ids, texts = dealt_rows(table)
    raw, offsets = string_bytes(texts)
    return raw, offsets, ids


def _sums(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, _ = _Powers.to(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=out[1:])
    return out


def segments(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, windows, gram's hash, segment's hash)`` of a block's segments."""
    inner = np.zeros(len(raw) + 1, np.int32)
    np.add.at(inner, offsets[:-1], 1)
    np.add.at(inner, np.maximum(offsets[1:] - width + 1, offsets[:-1]), -1)
    whole = np.cumsum(inner[:-1]) > 0
    span, found = width - gram + 1, []
    for a in range(0, len(raw), PIECE):
        at = np.flatnonzero(whole[a : a + PIECE])
        if not len(at):
            continue
        part = raw[a : a + PIECE + width - 1]
        sums, (_, down) = _sums(part, BYTE), _Powers.to(len(part))
        hashes = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
        # A place in the low bits: the least is the first one of the least hash.
        key = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if span > step:
            key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
        anchor = (key[at] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        n = np.diff(np.append(first, len(at)))
        start = at[first]
        other = _sums(part, OTHER)
        seg = mix((other[start + n + width - 1] - other[start]) * down[start] + n.astype(np.uint64))
        found.append((start + a, n, hashes[anchor[first]], seg))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _met(blocks: DataFrame, width: int, gram: int) -> DataFrame:
    """``(gram, seg, id, block, place, n, others)``: a block's distinct segments with the first of each, and the places of the rest."""

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw, offsets, ids = _block_rows(pa.Table.from_batches([batch.slice(k, 1)]))
                start, n, grams, segs = segments(raw, offsets, width, gram)
                doc = np.searchsorted(offsets, start, side="right") - 1
                rank = np.argsort(np.argsort(ids.fill_null(np.iinfo(np.int64).max).to_numpy(), kind="stable"), kind="stable")
                order = np.lexsort((start, rank[doc], segs, grams))
                start, n, grams, segs, doc = start[order], n[order], grams[order], segs[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (segs[1:] != segs[:-1])])) if len(start) else np.empty(0, np.int64)
                many = np.diff(np.append(first, len(start)))
                rest = np.ones(len(start), bool)
                rest[first] = False
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many - 1)]).astype(np.int32)), pa.array(start[rest].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[first].view(np.int64)), pa.array(segs[first].view(np.int64)), ids.take(pa.array(doc[first])), pa.array(np.full(len(first), batch.column(0)[k].as_py(), np.int64)), pa.array(start[first].astype(np.int32)), pa.array(n[first].astype(np.int32)), others],
                    names=["gram", "seg", "id", "block", "place", "n", "others"],
                )
                release()

    return blocks.select("block", "ids", "sizes", "data").mapInArrow(cut, "gram bigint, seg bigint, id bigint, block bigint, place int, n int, others array<int>")


# Suffix sorting of a bucket


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number."""
    out = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[k : len(data) - 7 + k]
    return out


def _cover_ranks(words: np.ndarray, size: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of the suffix at every place of the cover, and least common prefixes of neighbours over 1, 2, 4... ranks."""
    places = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER))
    deep = -(-width // 8)
    order = np.lexsort([words[places + 8 * k] for k in range(deep - 1, -1, -1)])
    places = places[order]
    rank = np.zeros(size, np.int64)
    rank[places] = np.arange(len(places))
    common = np.full(max(0, len(places) - 1), 8 * deep, np.int64)
    for k in range(deep - 1, -1, -1):
        differ = words[places[1:] + 8 * k] ^ words[places[:-1] + 8 * k]
        zeros = np.zeros(len(differ), np.int64)
        for b in range(1, 8):
            zeros += differ < np.uint64(1 << (64 - 8 * b))
        common = np.where(differ != 0, 8 * k + zeros, common)
    table = [common.astype(np.uint8)]
    while 2 << (len(table) - 1) <= len(common):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return rank, table


def _common(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes of different ranks a and b."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.uint8)
    for k in np.unique(level):
        mine = level == k
        out[mine] = np.minimum(table[k][lo[mine]], table[k][hi[mine] - (1 << int(k))])
    return out


def _resolved(at: np.ndarray, group: np.ndarray, rank: np.ndarray, table: list[np.ndarray], width: int) -> np.ndarray:
    """Places that are not the first of their class; ``at`` comes in groups alike in their first bytes.

    Each group is split by one of its members into what is less, equal and greater, over all groups at
    once: how two suffixes go on is told by their ranks at the next place that is in the cover for both.
    """
    again = []
    while len(at):
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        many = np.diff(np.append(first, len(at)))
        which = np.repeat(np.arange(len(first)), many)
        pivot = at[first + many // 2][which]
        shift = SHIFT[pivot % PERIOD, at % PERIOD]
        a, b = rank[pivot + shift], rank[at + shift]
        side = np.sign(b - a)
        apart = np.flatnonzero(side)
        side[apart[_common(table, a[apart], b[apart]) >= width - shift[apart]]] = 0
        equal = side == 0
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which[equal], at[equal])
        again.append(at[equal & (at != least[which])])
        left = ~equal
        at, group = at[left], which[left] * 2 + (side[left] > 0)
        alone = np.bincount(group, minlength=1)[group] == 1 if len(group) else np.empty(0, bool)
        at, group = at[~alone], group[~alone]
    return np.concatenate(again) if again else np.empty(0, np.int64)


def repeated_windows(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of the windows at ``starts`` in ``data``, the sorted starts of those that are equal to one that starts before."""
    padded = np.concatenate([data, np.zeros(-(-width // 8) * 8 + 8, np.uint8)])
    words = _words(padded)
    rank, table = _cover_ranks(words, len(data), width)
    prefix = -(-(PERIOD - 1) // 8)
    lead, again, lo = np.sort(words[starts]), [], 0
    while lo < len(lead):
        hi = min(lo + RANGE, len(lead))
        mine = starts[(words[starts] >= lead[lo]) & (words[starts] <= lead[hi - 1])]
        hi = int(np.searchsorted(lead, lead[hi - 1], side="right"))
        mine = mine[np.lexsort([words[mine + 8 * k] for k in range(prefix - 1, -1, -1)])]
        same = np.ones(max(0, len(mine) - 1), bool)
        for k in range(prefix):
            same &= words[mine[1:] + 8 * k] == words[mine[:-1] + 8 * k]
        group = np.concatenate([[0], np.cumsum(~same)])
        tied = np.bincount(group)[group] > 1
        again.append(_resolved(mine[tied], group[tied], rank, table, width))
        lo = hi
    return np.sort(np.concatenate(again)) if again else np.empty(0, np.int64)


def _sort_bucket(table: pa.Table, width: int) -> pa.Table:
    """``(block, place, n)``: runs of windows of a bucket's segments that are repeats."""
    table = table.sort_by([("id", "ascending"), ("block", "ascending"), ("place", "ascending")])  # null ids last
    n = table["n"].to_numpy()
    data = np.frombuffer(b"".join(table["text"].to_pylist()), np.uint8)
    base = np.concatenate([[0], np.cumsum(n + width - 1)])
    starts = np.repeat(base[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    again = repeated_windows(data, starts, width)
    seg = np.searchsorted(base, again, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (again[1:] != again[:-1] + 1) | (seg[1:] != seg[:-1])])) if len(again) else np.empty(0, np.int64)
    many, seg, at = np.diff(np.append(first, len(again))), seg[first], again[first]
    place = table["place"].to_numpy()[seg] + (at - base[seg])
    del data, base, starts
    release()
    return pa.table({"block": table["block"].combine_chunks().take(pa.array(seg)), "place": pa.array(place.astype(np.int32)), "n": pa.array(many.astype(np.int32))})


# All together


def frequent_grams(blocks: DataFrame, width: int, gram: int, least_rows: int) -> DataFrame:
    """``(gram, frequent)`` of the grams that more than one in ``SLICES`` segments have, of those that grams with ``least_rows`` of them have in
    some ``DRAWN`` blocks.  There are fewer than ``SLICES`` such grams.  Which ones are found changes how work is dealt, not what is returned.
    """
    part = max(1, blocks.count() // DRAWN)
    counts = _met(blocks.where(F.pmod(F.xxhash64("block"), F.lit(part)) == 0), width, gram).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where(F.col("n") >= least_rows), "frequent")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") * SLICES > total).select("gram", F.lit(True).alias("frequent"))


def repeated_runs(blocks: DataFrame, width: int, gram: int, bucket_bytes: int, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``(block, place, n)``: n windows in a row, from byte ``place`` of the block on, that start earlier elsewhere too."""
    # Segments of a frequent gram are dealt by their own hash: alike ones stay together, and of the others
    # it is taken for granted that there are several; how much text they have is added up afterwards.
    heavy = F.broadcast(frequent_grams(blocks, width, gram, least_rows))
    dealt = F.when(F.col("frequent"), F.pmod("seg", F.lit(SLICES))).otherwise(0)
    rows = _met(blocks, width, gram).join(heavy, "gram", "left").withColumn("slice", dealt)
    of_gram = Window.partitionBy("gram", "slice").orderBy("seg", F.col("id").asc_nulls_last(), "block", "place")
    whole = Window.partitionBy("gram", "slice")
    met = rows.select(
        "gram", "seg", "id", "block", "place", "n", "others", (F.coalesce(F.lag("seg").over(of_gram) == F.col("seg"), F.lit(False))).alias("again"),
        (F.col("frequent").isNotNull() | (F.max("seg").over(whole) != F.min("seg").over(whole))).alias("several"),
        F.sum(F.col("n") + F.lit(width - 1)).over(whole).alias("weight"), "frequent",
    )
    met = materialize(met.where("again or several or size(others) > 0").drop("seg"), "segments")
    places = F.when(F.col("again"), F.concat(F.array("place"), "others")).otherwise(F.col("others"))
    alike = met.select("block", F.explode(places).alias("place"), "n")
    # First ones, of grams with different segments: these are sorted.
    open_ = met.where("several and not again")
    weights = F.broadcast(open_.where("frequent").groupBy("gram").agg(F.sum(F.col("n") + width - 1).alias("all")))
    crowded = F.coalesce("all", "weight") > bucket_bytes
    open_ = open_.join(weights, "gram", "left").select("gram", "id", "block", "place", "n", crowded.alias("crowded"))
    total = open_.where("not crowded").agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    bucket = F.when(~F.col("crowded"), F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    wanted = open_.select("block", bucket.alias("bucket"), "id", "place", "n")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return right.slice(0, 0).append_column("text", pa.array([], pa.binary()))
        raw, place, n = _block_rows(left)[0], right["place"].to_pylist(), right["n"].to_pylist()
        text = memoryview(np.ascontiguousarray(raw))
        return right.append_column("text", pa.array([bytes(text[p : p + k + width - 1]) for p, k in zip(place, n, strict=True)], pa.binary()))

    named = ["block bigint", "bucket int", "id bigint", "place int", "n int", "text binary"]
    texts = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(fetch, ", ".join(named))
    texts = materialize(texts, "suffixes")
    kinds = "block bigint, place int, n int"
    sorted_ = texts.where("bucket is not null").groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, width), kinds)
    # A gram with more text than a bucket: its windows meet by their own bytes instead.
    offset = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    windows = texts.where("bucket is null").select("id", "block", "place", "text", offset)
    windows = windows.select("id", "block", (F.col("place") + F.col("o")).alias("place"), F.unhex(F.sha2(F.substring("text", F.col("o") + 1, F.lit(width)), 256)).alias("window"))
    first = windows.groupBy("window").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "block", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = join_hot(windows, first.where("n > 1").drop("n"), "window", first.select("window", "n")).where("first.block <> block or first.place <> place")
    return alike.unionByName(sorted_).unionByName(later.select("block", "place", F.lit(1).alias("n")))


def _cut_out(left: pa.Table, right: pa.Table, width: int) -> pa.Table:
    """``(id, kept, removed)`` of a block's documents, less the bytes of the windows given."""
    if not left.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "kept": pa.array([], pa.binary()), "removed": pa.array([], _SPANS)})
    raw, offsets, ids = _block_rows(left)
    place, n = right["place"].to_numpy().astype(np.int64), right["n"].to_numpy()
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + n + width - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    # Runs end with their document.
    inside = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    borders = np.unique(borders[gone[borders] & gone[borders - 1]])
    start = np.sort(np.concatenate([np.flatnonzero(inside == 1), borders]))
    end = np.sort(np.concatenate([np.flatnonzero(inside == -1), borders]))
    runs = np.searchsorted(start, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(start - offsets[doc]), pa.array(end - offsets[doc])], names=["start", "end"])
    kept = raw[~gone]
    kept_at = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(kept.tobytes())])
    del raw, gone, edge, inside, kept
    release()
    return pa.table({"id": ids, "kept": binary.cast(pa.binary()), "removed": pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), spans)})


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = 32, block_bytes: int = 4 << 20, files_bytes: int = 16 << 20, bucket_bytes: int = 2 << 20, least_rows: int = LEAST_ROWS
) -> DataFrame:
    """``(id_col, n_bytes, kept, removed)`` of every document: its bytes less each one covered by ``width`` bytes
    that also start earlier, in a document of smaller id or before in the same one, and the removed spans.

    Texts are UTF-8 bytes; what is kept may begin or end inside a character, so it is binary.  Null and empty
    texts have no bytes; null ids come last; documents that share an id are one before the other, in an order
    that is kept over the table, so of repeated rows one is first.  Very long texts are taken whole;
    a table without rows gives none; other columns are not looked at.  Equal segments are known by two
    64-bit hashes and their length.

    ``bucket_bytes``: text of one suffix bucket; a gram with more is met window by window, by SHA-256.  Before that, segments
    of a frequent gram (``frequent_grams``) are dealt over slices.
    """
    if not PERIOD <= width or not 0 < gram <= width:
        raise ValueError(f"width is {PERIOD} at least, and gram no more than width")
    blocks = _blocks(docs, id_col, text_col, block_bytes, files_bytes)
    runs = repeated_runs(blocks, width, gram, bucket_bytes, least_rows)
    kinds = "id bigint, kept binary, removed array<struct<start:bigint,end:bigint>>"
    out = blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(lambda a, b: _cut_out(a, b, width), kinds)
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"])
    return out.select(F.col("id").alias(id_col), (F.octet_length("kept") + n_removed).alias("n_bytes"), "kept", "removed")
