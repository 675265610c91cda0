"""Words of Arrow string columns as 64-bit hashes, computed with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so multi-byte
characters stay whole.  A word's hash is a polynomial in the ring of 64-bit
integers over random per-byte values, followed by a mixing step; all of it is
vectorised over the bytes of a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_SPACE = " \t\n\x0b\x0c\r"
#: The same set for Java regular expressions (both engines agree on it).
WORD_SPACE_CLASS = r"[ \t\n\x0B\f\r]"

_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240229


def _tables():
    rng = np.random.default_rng(_SEED)
    byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lower = byte.copy()
    lower[ord("A") : ord("Z") + 1] = byte[ord("a") : ord("z") + 1]
    space = np.zeros(256, dtype=bool)
    space[[ord(c) for c in WORD_SPACE]] = True
    return byte, lower, space, rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE, LOWER, SPACE, MULTIPLIERS = _tables()


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) <= n:
            size = max(n + 1, _SEGMENT + 1)
            inverse = pow(_BASE, -1, 2**64)
            for name, base in (("up", _BASE), ("down", inverse)):
                step = np.full(size, base, dtype=np.uint64)
                step[0] = 1
                setattr(cls, name, np.multiply.accumulate(step))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def byte_slices(column, limit: int):
    """``(from, to)`` of slices of a string column of about ``limit`` bytes, a row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def release() -> None:
    """Gives freed memory back to the system: Python workers stay between tasks, and what
    they hold counts against their executor."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray | None = None):
    """Start and end byte of every word, and each row's first word (n + 1 numbers).

    ``word_bytes`` tells for each byte whether it is part of a word."""
    inside = ~SPACE[raw] if word_bytes is None else word_bytes[raw]
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A hash of the bytes of each span (sorted by start); ``table`` folds the case."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SEGMENT // 2)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        up, down = _Powers.to(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def word_hashes(column, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the column, and each row's first word (n + 1 numbers)."""
    raw, offsets = string_bytes(column)
    starts, ends, rows = word_bounds(raw, offsets)
    return span_hashes(raw, starts, ends, table), rows


def word_counts(column) -> np.ndarray:
    """Words of each row of a string column."""
    raw, offsets = string_bytes(column)
    return np.diff(word_bounds(raw, offsets)[2])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, across row borders (mask those out)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += words[k : k + count] * MULTIPLIERS[k]
    return mix(out + np.uint64(n))
