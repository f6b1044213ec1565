"""The stages, each on its own input, and what they leave."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality_keeps_clean_documents(spark, docs):
    kept = {r["doc_id"] for r in p.keep_quality(spark, docs, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(d in kept for d in good) / len(good) > 0.97 and sum(d in kept for d in bad) / len(bad) < 0.2


def test_one_of_each_group_stays(spark, docs):
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    kept = p.drop_near_duplicates(spark, twice, DATA)
    assert kept.columns == p.COLUMNS and kept.where("doc_id >= 1000").count() == 0
    assert kept.count() == kept.select("text").distinct().count() > 150


def test_personal_data_goes(spark, docs):
    clean = p.remove_personal_data(spark, docs, DATA)
    assert clean.count() == docs.count() and clean.where(F.col("text").rlike(r"[0-9]{16}|[a-z]@[a-z]")).count() < docs.where(F.col("text").rlike(r"[0-9]{16}|[a-z]@[a-z]")).count()
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0


def test_mix_repeats_documents(spark, docs):
    mixed = p.mix_sources(spark, docs, DATA)
    words = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert mixed.columns == p.COLUMNS and abs(words(mixed) / words(docs) - 1.5) < 0.05
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_run(spark):
    rows = p.run(spark, DATA)
    assert rows.columns == ["doc_id", "source", "lang", "n_tokens", "ids"] and rows.where(F.length("ids") != 4 * F.col("n_tokens")).count() == 0 < rows.count()
    assert [len(p.STAGES), p.ORACLE_SQL] == [5, None]


def test_odd_rows(spark, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, None, None, None, None)], docs.schema)
    for _, stage in p.STAGES:
        assert stage(spark, odd, DATA).count() >= 0 and stage(spark, odd.limit(0), DATA).count() == 0


def test_rows_without_own_id_stay_apart(spark, docs):
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(None, t, "en", "s", 1) for t in texts[:3]] + [(7, t, "en", "s", 1) for t in texts[3:5]] + [(8, texts[5], "en", "s", 1), (None, texts[5], "en", "s", 1), (None, texts[0], "en", "s", 1), (9, texts[1], "en", "s", 1)]
    kept = p.drop_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), DATA).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, texts[0]), (9, texts[1]), (0, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])])
