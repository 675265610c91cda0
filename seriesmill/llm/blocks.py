"""Counts over a whole corpus, looked up by the blocks of documents that need them.

Documents are dealt to blocks of a bounded size by a hash.  A block sends each
distinct key it holds, with a count, to the bucket that owns the key's range of
hash values; a bucket adds up what all blocks sent and answers each block in the
order it asked; the block then finishes its documents.  Keys travel as packed
arrays, one row for each block and bucket, so a key of any frequency costs one
entry a block: there are no hot keys.  All three steps are grouped Arrow
functions over groups whose size is set by a parameter.  Texts and keys are compressed
by Zstandard, which takes a third less of the shuffle than its own compression.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .text import byte_slices, string_bytes, word_bounds

#: Level of Zstandard for texts, for numbers.
TEXT_LEVEL, NUMBER_LEVEL = 3, 1


def measure(texts: DataFrame) -> tuple[int, int]:
    """Bytes and words of the one string column, in one pass."""

    def sums(batches):
        for b in batches:
            raw, offsets = string_bytes(b.column(0))
            starts, _, _ = word_bounds(raw, offsets)
            yield pa.RecordBatch.from_pydict({"b": pa.array([len(raw)], pa.int64()), "w": pa.array([len(starts)], pa.int64())})

    row = texts.mapInArrow(sums, "b bigint, w bigint").groupBy().sum("b", "w").first()
    return row[0] or 0, row[1] or 0


def block_count(n_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / block_bytes))


def deal(rows: DataFrame) -> DataFrame:
    """``(block, ids, sizes, data)`` from ``(id, text, block)``: what a batch has for a block, in one row
    with the texts' bytes compressed.  A null text becomes the empty one."""

    def packed(batches):
        compress = zstandard.ZstdCompressor(level=TEXT_LEVEL).compress
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), 16 << 20):
                part = batch.slice(lo, hi - lo)
                block = part.column(2).to_numpy()
                order = np.argsort(block, kind="stable")
                block, part = block[order], part.take(pa.array(order))
                raw, offsets = string_bytes(part.column(1))
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
                data = [compress(raw[offsets[i] : offsets[j]].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
                of_block = pa.array(cuts.astype(np.int32))
                ids = pa.ListArray.from_arrays(of_block, part.column(0))
                sizes = pa.ListArray.from_arrays(of_block, pa.array(np.diff(offsets), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), ids, sizes, pa.array(data, pa.binary())], names=["block", "ids", "sizes", "data"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "text", "block").mapInArrow(packed, f"block int, ids array<{kind}>, sizes array<bigint>, data binary")


def dealt_rows(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of the rows that ``deal`` packed."""
    ids, sizes = (pa.concat_arrays([c.flatten() for c in table[name].chunks]) for name in ("ids", "sizes"))
    expand = zstandard.ZstdDecompressor().decompress
    data = b"".join(expand(d) for d in table["data"].to_pylist())
    offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int64)
    return ids, pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted keys starts and ends (buckets + 1 numbers)."""
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]]).astype(np.int64)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, all lowest bytes first, compressed: the empty high bytes cost nothing."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes(), NUMBER_LEVEL)


def unpack(data: bytes, dtype) -> np.ndarray:
    width, planes = np.dtype(dtype).itemsize, zstandard.decompress(data)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, len(planes) // width).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising numbers as the packed steps between them."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def fingerprints(keys: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of each key's place in its bucket, rising as the keys: equal keys have equal ones, and so
    do a few others."""
    return ((keys * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)


def by_bucket(edges: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """``(bucket, keys, counts)`` as bytes, for the buckets that get any."""
    for b in np.flatnonzero(np.diff(edges)).tolist():
        mine = slice(edges[b], edges[b + 1])
        yield b, pack_sorted(keys[mine]), pack(counts[mine].astype(np.uint32))


def total_by_key(requests: pa.Table, dtype) -> list[bytes]:
    """The totals over all rows of a bucket, for each row in the order of its keys."""
    keys = [unpack_sorted(k, dtype) for k in requests["keys"].to_pylist()]
    counts = np.concatenate([unpack(c, np.uint32) for c in requests["counts"].to_pylist()])
    ends = np.cumsum([len(k) for k in keys])[:-1]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
    return [pack(t) for t in np.split(totals, ends)]


def replies(requests: DataFrame, dtype, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(block, bucket, *extra, totals)``; each group is one bucket of one kind.

    Counts add up as doubles, exact below 2**53.
    """

    def answer(table: pa.Table) -> pa.Table:
        return table.select(["block", "bucket", *extra]).append_column("totals", pa.array(total_by_key(table, dtype), pa.binary()))

    kinds = "".join(f", {e} int" for e in extra)
    return requests.groupBy(*extra, "bucket").applyInArrow(answer, f"block int, bucket int{kinds}, totals binary")


def unpack_totals(table: pa.Table) -> np.ndarray:
    """All totals that a block was sent, in the order of its sorted keys."""
    parts = [unpack(t, np.int64) for t in table.sort_by("bucket")["totals"].to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)
