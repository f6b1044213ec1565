"""The queries of the operators in this folder: each applies one to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.llm.licenses import oracle, scan
from hushspan.llm.topk import ORACLE as TOPK

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=4, radius=4)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.bpe import decode, encode

    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary()).drop("text", "offsets")
    return decode(coded, vocabulary()).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.pii import BASE, find

    own = find(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return own.select("doc_id", *map(count, BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.langid import identify

    return identify(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.minhash import edited_likeness

    return edited_likeness(documents(spark, sf_dir))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hushspan.llm.quality import classify

    return classify(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after a history of batches: all are loaded with no language, the load is sent again (which
    changes nothing), a revision gives each its language, those without one are withdrawn and come back. Tokens are
    counted once. The result is the table's own totals by source, language and tokenizer."""
    from hushspan.llm.bpe import count_tokens
    from hushspan.llm.common import durable, shared_dir
    from hushspan.llm.rollup import Rollup, changes, revised

    totals = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    docs = durable(count_tokens(documents(spark, sf_dir).select("text", "source", "lang"), vocabulary()).drop("text"))
    first = docs.withColumn("lang", F.lit(None).cast("string"))
    batches = [("load", changes(first, VOCABULARY)), ("load", changes(first, VOCABULARY)), ("languages", revised(first, docs, VOCABULARY))]
    batches += [(name, changes(docs.where("lang is null"), VOCABULARY, sign=sign)) for name, sign in (("withdrawn", -1), ("back", 1))]
    for name, batch in batches:
        totals.commit(name, batch)
    totals.compact()
    return totals.totals()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_bpe, op4_pii, op5_langid, op6_minhash, op7_topk, op8_licenses, op9_quality, op10_token_counts)}

ORACLES: dict[str, str] = {"op7_topk": TOPK, "op8_licenses": oracle()}
