"""Quality rules: plain text rules, and a hashed n-gram likelihood ratio.

Every document's words and word pairs are hashed into a fixed number of buckets.
Two multinomials over the buckets, one from the trusted documents and one from
all documents, give each bucket a log ratio; a document's score is the mean log
ratio of its n-grams.  The trusted multinomial has the raw one as its prior, so a bucket
of which the trusted documents tell little has a ratio near 1: chance in small
corpora moves no score far, and one threshold holds at every size.  Everything is SQL
functions, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD_SPACE_CLASS

SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE_CLASS + "+", -1), "")


def _rest(column: str, n: int) -> Column:
    """The array without its first n items."""
    return F.slice(column, F.lit(n + 1), F.greatest(F.size(column) - n, F.lit(0)))


def _front(column: str, n: int) -> Column:
    """The array without its last n items."""
    return F.slice(column, F.lit(1), F.greatest(F.size(column) - n, F.lit(0)))


def _pairs(a: str, b: str, gap: int) -> Column:
    """Hash of the i-th item of a and the (i + gap)-th of b."""
    left = F.slice(a, F.lit(1), F.greatest(F.size(b) - gap, F.lit(0)))
    return F.zip_with(left, _rest(b, gap), lambda x, y: F.xxhash64(x, y))


def ngram_buckets(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Adds ``word_ids`` (hashes) and ``grams``: the bucket of each word and word pair, in lower case."""
    hashed = docs.withColumn("_w", words(F.col(text_col))).withColumn("word_ids", F.transform("_w", lambda w: F.xxhash64(F.lower(w))))
    bucket = lambda h: F.pmod(h, F.lit(buckets).cast("bigint")).cast("int")
    singles = F.transform("word_ids", bucket)
    doubles = F.zip_with(_front("word_ids", 1), _rest("word_ids", 1), lambda x, y: bucket(F.xxhash64(x, y)))
    return hashed.withColumn("grams", F.concat(singles, doubles))


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, trusted: str) -> DataFrame:
    """``(bucket, r, t)``: n-grams of all rows, and of those where ``trusted`` holds.

    At most ``buckets`` rows per task are shuffled.  The outer form of explode
    keeps the planner from testing the array for rows below the join, where it
    would be made a second time.
    """
    grams = ngram_buckets(docs.select(text_col, trusted), text_col, buckets).select(F.explode_outer("grams").alias("bucket"), trusted)
    return grams.groupBy("bucket").agg(F.count("bucket").alias("r"), F.count_if(trusted).alias("t")).where("bucket is not null")


def log_ratios(counts: DataFrame, buckets: int, prior: float) -> DataFrame:
    """One row ``ratios``: the log of trusted over raw probability of each bucket in turn.

    The trusted probability of a bucket is (t + prior * p) / (all t + prior), where p is its
    raw one, r / all r: a Dirichlet prior of ``prior`` n-grams dealt as the corpus deals them.
    A bucket without n-grams has 0.
    """
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("t"))
    summed = counts.unionByName(every).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    whole = summed.agg(F.array_sort(F.collect_list(F.struct("bucket", "r", "t"))).alias("b"), F.sum("r").alias("rs"), F.sum("t").alias("ts"))
    more = lambda x: x["t"] / x["r"] * F.col("rs")
    ratio = lambda x: F.when(x["r"] > 0, F.log((more(x) + prior) / (F.col("ts") + prior))).otherwise(0.0)
    return whole.select(F.transform("b", ratio).alias("ratios"))


def _recurring(df: DataFrame, keyed: Column) -> DataFrame:
    """Adds ``_at``: each ``i`` of the structs (k, i) in the array whose k another one has too."""
    df = df.withColumn("_s", F.array_sort(keyed))
    # A key recurs if the one before or after it in this order is the same.
    df = df.withColumn("_eq", F.zip_with(_front("_s", 1), _rest("_s", 1), lambda x, y: x["k"] == y["k"]))
    paired = F.zip_with("_s", F.zip_with(F.concat(F.array(F.lit(False)), F.col("_eq")), F.concat(F.col("_eq"), F.array(F.lit(False))), lambda x, y: x | y), lambda s, r: F.when(r, s["i"]))
    return df.withColumn("_at", F.array_compact(paired))


def rule_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the plain measures; needs the columns of ``ngram_buckets``.

    ``n_repeat_words`` counts the words inside a 5-word window that occurs twice
    or more in the text.  Windows whose hashes are equal are found by sorting these with
    their positions, which costs n log n even for a text of one repeated word;
    texts without an equal pair of hashes skip the sort.  Windows found so are then
    compared by their words in the same way, as different ones may share a hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    # Words keep their case here: rules compare the text as it is.
    df = (
        docs.withColumn("n_words", F.size("_w").cast("bigint"))
        .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("bigint"))
        .withColumn("n_symbols", F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
        .withColumn("_h2", _pairs("_h", "_h", 1))
        .withColumn("_h4", _pairs("_h2", "_h2", 2))
        .withColumn("_h5", _pairs("_h4", "_h", 4))
    )
    keyed = lambda k, i: F.struct(k.alias("k"), i.alias("i"))
    repeats = F.size(F.array_distinct("_h5")) < F.size("_h5")
    df = _recurring(df, F.when(repeats, F.transform("_h5", keyed)))
    df = _recurring(df, F.transform("_at", lambda i: keyed(F.slice("_w", i + 1, F.lit(5)), i))).withColumn("_at", F.array_sort("_at"))
    steps = F.zip_with(_front("_at", 1), _rest("_at", 1), lambda x, y: F.least(y - x, F.lit(5)))
    covered = F.aggregate(steps, F.lit(5), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_at") > 0, covered), F.lit(0)).cast("bigint"))


def quality(docs: DataFrame, trusted_ids: DataFrame, *, buckets: int, prior: float, threshold: float, min_words: int = 10, max_repeat_percent: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rules' measures, ``score`` and ``kept`` for every row of ``docs``.

    ``trusted_ids`` (its column ``id_col``) names the trusted documents.  Their
    n-grams and those of all documents are counted in whole, with partial sums
    over a fixed number of buckets, so neither a frequent word nor a hot source
    makes a large task.  The log ratios are one row of ``buckets`` numbers.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of them in repeated windows.  ``kept``: not so, and a
    score of ``threshold`` or more.  A text without words, or null, scores 0 and
    fails the rules.  ``prior`` is the weight of the raw corpus in the trusted multinomial, in
    n-grams (``log_ratios``); with no trusted document the two are one and all scores 0.
    Null ids are never trusted; repeated rows are judged alike, each on its own.
    ``keep`` names further columns of ``docs`` to return.
    """
    docs = docs.select(*dict.fromkeys([id_col, text_col, *keep]))
    ids = trusted_ids.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct().withColumn("_trusted", F.lit(True))
    # Trusted ids grow with the corpus: they are merged in, never broadcast.
    marked = docs.select(id_col, text_col).join(ids.hint("merge"), id_col, "left").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))
    model = log_ratios(bucket_counts(marked, text_col, buckets, "_trusted"), buckets, prior)
    df = rule_columns(ngram_buckets(docs, text_col, buckets), text_col).withColumn("_ratios", model.scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get("_ratios", b))
    df = df.withColumn("score", F.coalesce(F.try_divide(total, F.size("grams")), F.lit(0.0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    # A filter on the verdict must not be pushed below the columns it is made of: they would be
    # written out in it many times over.  It stops at what depends on the partition.
    here = F.spark_partition_id() >= 0
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & here)
    return df.select(id_col, *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
