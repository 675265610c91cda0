"""A corpus pipeline of five stages over the documents table.

Each stage is one operator, takes all that the stage before kept, and is written
as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import jaccard_join, mixing, quality, queries, secrets, sentencepiece_codec
from seriesmill.llm.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: a null, empty or short text fails them, repeated rows are judged
    alike, no rows keep none; very long texts are judged whole."""
    judged = quality.quality(docs, queries.trusted(spark, sf_dir), keep=COLUMNS[1:], **queries.QUALITY)
    return judged.where("kept").select(*COLUMNS)


def _key() -> Column:
    """What tells a row from others: its id, null or not, and 128 bits of its text."""
    return F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("text"), F.xxhash64(F.lit(1), "text").alias("text2")).alias("_key")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id, null ids last.

    A row is known by its id and text: rows alike in both are one document, and rows that
    share an id only are not.
    """
    docs = docs.select(*COLUMNS, _key())
    groups = jaccard_join.jaccard_join(docs, id_col="_key", **queries.NEAR_STAGE)
    first = groups.where(F.col("_key") == F.col("component_id")).select("_key").distinct()
    return docs.join(first.hint("merge"), "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text.  Null and empty texts stay as they
    are, repeated rows are cleaned alike, very long texts whole."""
    found = secrets.find_secrets(docs, keep=COLUMNS[1:]).withColumn("spans", F.concat("assign", "access", "hex", "random"))
    hit = F.size("spans") > 0
    out = found.withColumn("_clean", F.when(hit, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    n_chars = F.when(hit, F.char_length("_clean").cast("bigint")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("_clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none, once or twice.

    Rows are known by their id and text; rows alike in both are one document
    that is taken as often as they are together.
    """
    docs = docs.select(*COLUMNS, _key())
    mix = mixing.mix_sources(docs, id_col="_key", **queries.MIX).where("taken > 0")
    times = mix.groupBy("_key").agg(F.sum(F.expr("taken div size")).cast("int").alias("_times"))
    out = docs.join(times.hint("merge"), "_key").dropDuplicates(["_key"])
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, round_trip, parity, ids)``: the token ids of every document.  A null or
    empty text has none; repeated rows are rows of their own; very long texts are encoded whole."""
    model = queries.tokenizer_path(queries.PIECE_MODEL)
    out = sentencepiece_codec.encode_documents(docs, model, threads=queries.PIECE_THREADS, keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "round_trip", "parity", "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Hashed buckets, seeded hashes and token ids are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and reread."""
    queries.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
