"""Stupid-backoff language-model scores from the n-gram counts of the corpus itself.

The score of a word after its history is count(history, word) / count(history)
if the longer n-gram occurs ``min_count`` times or more, else ``alpha`` times the
score after the history without its first word; a single word scores its share
of all words (Brants et al., 2007).  Count tables are dealt by ranges of the
n-gram's hash; the n-grams of a block of documents are looked up there, and each
document sums the logarithms of its words' scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, bucket_edges, by_bucket, deal, dealt_rows, measure, replies, unpack_totals
from .text import ngram_hashes, release, word_hashes


def _words(column):
    """The words' hashes, their places in their texts, and each text's first word."""
    words, rows = word_hashes(column)
    return words, np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows)), rows


def _grams(words: np.ndarray, place: np.ndarray, n: int):
    """The words that end an n-gram in their text, and the n-grams' hashes."""
    ends = np.flatnonzero(place >= n - 1)
    return ends, words if n == 1 else ngram_hashes(words, n)[ends - (n - 1)]


def score_documents(docs: DataFrame, *, order: int, min_count: int, alpha: float, block_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_backoff, log_score, mean_log_score)`` for every row of ``docs``.

    Words are runs of non-space bytes with A-Z in lower case; the counts are those of all rows,
    copies and the scored document included.  ``n_backoff`` counts the words that were not
    scored by the longest history they have.  A null or empty text has no words, a
    score of 0 and a null mean.  Null and repeated ids are rows of their own.

    ``block_bytes`` bounds the text that a task holds, unless one text is longer.
    Identity of n-grams is that of their 64-bit hashes.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_bytes, n_words = measure(texts.select("text"))
    blocks = block_count(n_bytes, block_bytes)
    dealt = deal(texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")))

    def request(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        words, place, _ = _words(dealt_rows(table)[1])
        rows = []
        for n in range(1, order + 1):
            keys, counts = np.unique(_grams(words, place, n)[1], return_counts=True)
            for bucket, k, c in by_bucket(bucket_edges(keys, blocks), keys, counts):
                rows.append((block, n, bucket, k, c))
        del words, place, keys, counts
        release()
        return pa.table(dict(zip(("block", "n", "bucket", "keys", "counts"), [list(x) for x in zip(*rows, strict=True)] or [[]] * 5, strict=True)), schema=asked)

    asked = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = dealt_rows(table)
        words, place, rows = _words(texts)
        score = np.zeros(len(place))
        used = np.zeros(len(place), np.int64)
        shorter = None
        for n in range(1, order + 1):
            ends, hashes = _grams(words, place, n)
            _, inverse = np.unique(hashes, return_inverse=True)
            totals = unpack_totals(answers.filter(pc.equal(answers["n"], n)))[inverse] if len(ends) else np.empty(0, np.int64)
            counts = np.zeros(len(place), np.int64)
            counts[ends] = totals
            if n == 1:
                score[ends], used[ends] = totals / max(n_words, 1), 1
            else:
                often = ends[totals >= min_count]
                score[often], used[often] = counts[often] / shorter[often - 1], n
            shorter = counts
        missed = np.minimum(place + 1, order) - used
        logs = np.log(score, where=score > 0, out=np.zeros(len(score))) + missed * np.log(alpha)
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[rows])
        # Sums per text, not differences of running sums: a text's score must not depend on its block.
        full = np.flatnonzero(np.diff(rows))
        sums = np.zeros(len(rows) - 1)
        if len(full):
            sums[full] = np.add.reduceat(logs, rows[full])
        del counts, shorter, score, used, words, place, logs, texts
        release()
        return pa.table({"id": ids, "n_words": np.diff(rows), "n_backoff": add((missed > 0).astype(np.int64)), "log_score": sums})

    asks = dealt.groupBy("block").applyInArrow(request, "block int, n int, bucket int, keys binary, counts binary")
    answers = replies(asks, np.uint64, ("n",))
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"id {kind}, n_words bigint, n_backoff bigint, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_backoff", "log_score", mean.alias("mean_log_score"))
