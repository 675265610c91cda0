"""Words and hashes in numpy, packing, components."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesmill.llm import blocks, text
from seriesmill.llm.graph import connected_components, least_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.none() | st.text(st.sampled_from("aAbB \n\t\x0b\x1c éÉß日|")), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    got, rows = text.word_hashes(pa.array(texts, pa.string()))
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in want]
    flat = [w for words in want for w in words]
    assert len(set(got.tolist())) == len(set(flat)) and {(a, b) for a, b in zip(got.tolist(), flat, strict=True)} == {(h, w) for h, w in dict(zip(got.tolist(), flat, strict=True)).items()}
    assert text.word_counts(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]


def test_hash_does_not_depend_on_place():
    long = "x" * (text._SEGMENT * 2 + 5)
    a, _ = text.word_hashes(pa.array([f"{long} word {long} word tail", "word"]))
    assert a[1] == a[3] == a[-1] and a[0] == a[2]
    sliced = pa.array(["skip this", "word", None, "b"]).slice(1)
    assert text.word_hashes(sliced)[0][0] == a[1] and text.word_counts(sliced).tolist() == [1, 0, 1]
    assert text.word_counts(pa.array([], pa.string())).tolist() == []


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 9))
def test_packing_and_buckets(numbers, buckets):
    keys = np.array(sorted(set(numbers)), np.uint64)
    assert blocks.unpack_sorted(blocks.pack_sorted(keys), np.uint64).tolist() == keys.tolist()
    short = blocks.fingerprints(keys, buckets)
    assert blocks.unpack_sorted(blocks.pack_sorted(short), np.uint32).tolist() == short.tolist()
    edges = blocks.bucket_edges(keys, buckets)
    assert edges[0] == 0 and edges[-1] == len(keys) and (np.diff(edges) >= 0).all() and len(edges) == buckets + 1


def test_slices_cover_all_rows():
    column = pa.array(["a" * 10, None, "b" * 100, "", "c"])
    got = list(text.byte_slices(column, 12))
    assert got[0][0] == 0 and got[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert list(text.byte_slices(pa.array([], pa.string()), 12)) == []


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100), (100, 101)], [(5, 3), (9, 5), (7, 9), (20, 21)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in got.collect()} == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    n = 1 + max((max(e) for e in edges), default=0)
    labels = least_labels(n, np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))
    assert all(labels[k] == v for k, v in brute(edges).items())
