"""Removal of repeated passages against a set of all windows seen."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, width):
    """``(id, kept, removed spans)``, documents in the order given."""
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - width + 1):
            if (w := b[k : k + width]) in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        starts = [k for k in range(len(b)) if gone[k] and not (k and gone[k - 1])]
        out.append((i, bytes(x for x, g in zip(b, gone, strict=False) if not g), [(k, next(e for e in range(k, len(gone)) if not gone[e])) for k in starts]))
    return out


def run(df, **kw):
    return sorted(((r["doc_id"], bytes(r["kept"]), [tuple(s) for s in r["removed"]]) for r in suffix_dedup.remove_repeats(df, **kw).collect()), key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    r, s = np.meshgrid(np.arange(suffix_dedup.PERIOD), np.arange(suffix_dedup.PERIOD))
    for side in (r, s):
        assert np.isin((side + suffix_dedup.SHIFT[r, s]) % suffix_dedup.PERIOD, suffix_dedup.COVER).all()


@pytest.mark.parametrize("width, span", [(57, 5), (100, 300), (100, 1 << 18), (130, 40)])
def test_sorting_a_bucket(monkeypatch, width, span):
    monkeypatch.setattr(suffix_dedup, "RANGE", span)
    rng = np.random.default_rng(width + span)
    for letters in (1, 2, 3, 3):
        data = rng.integers(97, 97 + letters, 2500).astype(np.uint8)
        for _ in range(10):
            a, b, n = rng.integers(0, 2000), rng.integers(0, 2000), rng.integers(50, 400)
            data[b : b + n] = data[a : a + n].copy()
        starts, seen, want = np.sort(rng.choice(len(data) - width, 1800, replace=False)), set(), []
        for k in starts.tolist():
            w = data[k : k + width].tobytes()
            want += [k] if w in seen else []
            seen.add(w)
        assert suffix_dedup.repeated_windows(data, starts, width).tolist() == want


def test_segments_cover_every_window():
    rng = np.random.default_rng(2)
    sizes = [0, 5, 99, 100, 101, 3000, 0, 250]
    raw, offsets = rng.integers(97, 100, sum(sizes)).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    start, n, *_ = suffix_dedup.segments(raw, offsets, 100, 32)
    got = sorted(int(s) + k for s, m in zip(start, n, strict=True) for k in range(m))
    assert got == [o + k for o, size in zip(offsets.tolist(), sizes, strict=False) for k in range(size - 99)]


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 20_000, "files_bytes": 60_000, "bucket_bytes": 30_000}, {"block_bytes": 20_000, "bucket_bytes": 1000}, {"width": 60, "gram": 20, "bucket_bytes": 5000}])
def test_documents(spark, kw):
    queries.prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0]))
    assert run(docs, **kw) == sorted(brute(rows, kw.get("width", 100)), key=repr)


def test_awkward_rows(spark):
    """Nulls, short, empty and long texts, repeated rows, characters of several bytes, passages that overlap themselves, clashing columns."""
    queries.prepare(spark)
    rng = random.Random(3)
    passage = "".join(rng.choice("abé日 ") for _ in range(90))
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 250), (6, passage), (7, "é" + passage + "q" + passage), (8, "ab" * 40_000 + passage), (9, "no repeat " + str(list(range(90)))), (10, passage * 3)]
    rows += [(11, "same row " * 30), (11, "same row " * 30), (None, passage + "tail"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in ("id", "block", "place", "n", "bucket", "gram", "ids", "kept")}).repartition(4)
    for kw in ({}, {"block_bytes": 100, "bucket_bytes": 2000}):
        assert run(df, **kw) == sorted(brute(rows, 100), key=repr)
    assert run(df.limit(0)) == []


def test_a_passage_in_a_third_of_all_documents(spark):
    """A frequent gram in many contexts: more text than a bucket holds."""
    queries.prepare(spark)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    noise = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(20, 300)))
    rows = [(i, noise() + passage + noise() if i % 3 == 0 else noise()) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for kw in ({"bucket_bytes": 4000}, {"least_rows": 20}):
        assert run(df, block_bytes=10_000, **kw) == sorted(brute(rows, 100), key=repr)
    blocks = suffix_dedup._blocks(df, "doc_id", "text", 10_000, 1 << 20)
    assert suffix_dedup.frequent_grams(blocks, 100, 32, 20).count() > 0
