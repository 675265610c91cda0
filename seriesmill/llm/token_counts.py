"""Token counts through a digest cache.

The cache is a Parquet table ``(digest, version, n_tokens)`` in a shared folder.
A run joins the digests of its contents to the cache, encodes each distinct
content that is missing once, appends those counts, and joins again.  The key
holds a digest of the tokenizer file too, so another tokenizer, or another
version of it, never meets a stale count.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import join_hot
from .storage import materialize, new_path
from .text import byte_slices, release, string_bytes, word_bounds

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"

#: Distinct words whose counts a Python worker remembers at most.
WORD_MEMO = 300_000


def content_digest(text: Column) -> Column:
    """Digest of the normalised content: null counts as the empty text.

    Nothing else is folded: case and white space are the tokenizer's own affair.
    """
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Counter:
    """Token counts of texts as the library of the tokenizer file gives them.

    ``.json`` files go to the tokenizers library, ``.model`` files to
    sentencepiece; no begin, end or added special tokens, no padding or
    truncation.  Special strings inside a text are handled as by default.

    With ``by_word`` the texts are cut at ASCII white space and each distinct
    piece is encoded once.  That is exact for a tokenizer whose pre-tokens and
    special strings never hold such white space and whose normaliser never
    looks across it, which is probed on construction.
    """

    _PROBES = ("a b", "it 's A\tB\n\nc", "e ́ x", "ΣΑΣ Σ", "x  1 2 3 ...  y", "<|endoftext|> z", "don't  stop\r\n", "zéro 5é")

    def __init__(self, path: str, by_word: bool = True):
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
        self.memo: dict[bytes, int] = {}
        self.by_word = False
        if by_word and not self.pieces:
            whole = self.whole(list(self._PROBES))
            self.by_word = self.words(pa.array(self._PROBES)).tolist() == whole
            self.memo.clear()

    def whole(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, column) -> np.ndarray:
        raw, offsets = string_bytes(column)
        starts, ends, rows = word_bounds(raw, offsets)
        data, memo = raw.tobytes(), self.memo
        keys = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        if missing := [k for k in set(keys) if k not in memo]:
            if len(memo) + len(missing) > WORD_MEMO:
                memo.clear()
                missing = list(set(keys))
            memo.update(zip(missing, self.whole([k.decode() for k in missing]), strict=True))
        sums = np.zeros(len(keys) + 1, np.int64)
        np.cumsum(np.fromiter(map(memo.__getitem__, keys), np.int64, len(keys)), out=sums[1:])
        return np.diff(sums[rows])

    def counts(self, column) -> np.ndarray:
        if self.by_word:
            return self.words(column)
        return np.array(self.whole(["" if x is None else x for x in column.to_pylist()]), np.int64)


_COUNTERS: dict[tuple, Counter] = {}


def counter_at(path: str, by_word: bool) -> Counter:
    """The worker's counter: built once, its memory of words is cleared after each task."""
    key = (path, os.path.getmtime(path), by_word)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(path, by_word)
    return _COUNTERS[key]


def tokenizer_version(path: str, by_word: bool = True) -> str:
    """A digest of the file, of the library that reads it with its release, and of how words are counted."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    told = hashlib.sha256(Path(path).read_bytes())
    told.update(f"|{library} {importlib.metadata.version(library)}|{by_word}".encode())
    return told.hexdigest()


class TokenCountCache:
    """Counts by (content digest, tokenizer version) in ``path``; it starts empty."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "token-counts")

    def read(self) -> DataFrame:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)

    def append(self, counts: DataFrame) -> None:
        """Spark commits a write as a whole, so a failed one leaves no half counts."""
        counts.write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: TokenCountCache, *, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row of ``docs``.

    Nulls in the text count as the empty text; null and repeated ids are kept,
    a row each.  Other columns are ignored whatever their names.  The tokenizer
    file must be at the same path on every executor.

    The texts to encode are one per distinct digest: the least id among the rows
    of a digest that the cache lacks names it.  Only that row's text is shuffled,
    by its id, so copies never meet in a task; they get their count in slices (``join_hot``).
    """
    version = tokenizer_version(tokenizer, by_word)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = docs.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest"))
    keyed = materialize(keyed, "digests")
    known = cache.read().where(F.col("version") == version).select("digest", "n_tokens")
    # A group's least id; groups of null ids only are encoded too (null-safe below).
    misses = keyed.groupBy("digest").agg(F.min("id").alias("id")).join(known, "digest", "left_anti")
    chosen = misses.select(F.xxhash64("id", "digest").alias("row"))
    texts = docs.select(F.xxhash64("id", content_digest(F.col("text"))).alias("row"), "text")

    def encode(batches):
        counter = counter_at(tokenizer, by_word)
        try:
            for batch in batches:
                for lo, hi in byte_slices(batch.column(0), 2 << 20):
                    part = batch.column(0).slice(lo, hi - lo)
                    digests = [hashlib.sha256((x or "").encode()).digest() for x in part.to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counter.counts(part), pa.int64())], names=["digest", "n_tokens"])
        finally:
            counter.memo.clear()
            release()

    found = texts.join(chosen, "row", "left_semi").select("text").mapInArrow(encode, "digest binary, n_tokens bigint")
    # Rows that repeat an id and its text name one digest; its counts agree.
    cache.append(found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")).select("digest", F.lit(version).alias("version"), "n_tokens"))
    stored = cache.read().where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    counts = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return join_hot(keyed, stored, "digest", counts, "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
