"""The pipeline's stages one by one, and as a whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from seriesmill.llm import queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The table before the first stage, and after each."""
    queries.prepare(spark)
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in p.STAGES:
        out.append(p.materialize(f(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage(spark, stages):
    docs, good, unique, clean, mixed, encoded = stages
    judged = queries.op4_quality_rules(spark, SF)
    assert ids(good) == ids(judged.where("kept"))
    groups = p.jaccard_join.jaccard_join(good, **queries.NEAR_STAGE)
    assert ids(unique) == ids(groups.where("doc_id = component_id"))
    assert ids(clean) == ids(unique) and clean.where(F.char_length("text") != F.col("n_chars")).count() == 0
    left = secrets.find_secrets(clean)
    assert left.where("size(assign) + size(access) + size(hex) + size(random) > 0").count() == 0
    mix = p.mixing.mix_sources(clean.withColumn("doc_id", F.xxhash64("doc_id", "text")), **queries.MIX)
    assert mixed.count() == mix.agg(F.sum(F.expr("case when size > 0 then taken div size else 0 end"))).first()[0]
    assert all(df.columns == list(p.COLUMNS) for df in (good, unique, clean, mixed))
    assert encoded.count() == mixed.count() and encoded.where("not parity or not round_trip").count() == 0
    assert encoded.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run(spark, stages):
    assert ids(p.run(spark, SF)) == ids(stages[-1])


def test_awkward_documents(spark):
    queries.prepare(spark)
    good = "a plain text with more than ten different words in it, number "
    rows = [(None, good + "x token = abcdefgh1234", "en", None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, good + "y", None, "s", 70), (3, good + "y", None, "s", 70), (4, good + "y", "en", "t", 70), (5, good + "z " * 3, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("extra", F.lit(1))
    for name, f in p.STAGES[:4]:
        docs = p.materialize(f(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == list(p.COLUMNS)
        if name == "n-gram jaccard join":
            assert sorted(map(str, (r.doc_id for r in docs.collect()))) in (["3", "5", "None"], ["3", "None"])
        if name == "secret scan":
            assert docs.where("doc_id is null and text like '%[SECRET]%'").count() == 1
    out = p.encoding_stage(spark, docs, SF)
    assert out.count() == docs.count()
    for _, f in p.STAGES:
        f(spark, spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint"), SF).count()


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Rows are told apart by id and text; a group keeps its least id, null ids last."""
    a, b, c, d = ("some words of text number %s that go on for a while here" % x * 3 for x in "abcd")
    rows = [(1, a), (1, b), (2, b), (None, b), (None, c), (None, c), (3, a + " x"), (1, a), (None, d), (4, d), (5, None), (None, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("bigint")})
    got = p.near_duplicate_stage(spark, docs.repartition(3), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (1, b), (None, c), (4, d), (5, None), (None, ""), (6, "")], key=str)
