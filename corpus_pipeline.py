"""The corpus pipeline: documents in, token ids out, each stage written and read again by the next.

Stages, in order: documents of bad quality go; of each group of near duplicates one document stays; personal data is
replaced by its kind; sources are mixed to their weights, a document appearing as often as the mix takes it; texts are
encoded. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.llm import bpe, mixing, pii, quality, simhash
from hushspan.llm.common import durable, shared_dir
from hushspan.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; those that a table lacks are null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It learns from the stage's own input, without labels."""
    return quality.classify(columns(docs)).where("keep").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id; of rows with that id the least text."""
    return simhash.distinct_documents(columns(docs), words=5, similarity=0.8).select(*COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows the text."""
    return pii.redact(columns(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    own = columns(docs)
    taken = mixing.mix(own, apart=COLUMNS).groupBy("key1", "key2").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = durable(taken.select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "copies", "rows"))
    joined = own.withColumns(dict(zip(("key1", "key2"), mixing.keys(COLUMNS), strict=True))).join(taken, (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")))
    once = joined.where("rows = 1")
    if not taken.where("rows > 1").head(1):
        return once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)
    # rows that are alike in all columns: one of them, as often as the mix takes them together
    same = joined.where("rows > 1").groupBy("key1", "key2").agg(F.first(F.struct(*COLUMNS)).alias("row"), F.first("copies").alias("copies"))
    every = once.select(*COLUMNS, "key1", "key2", "copies").unionByName(same.select("row.*", "key1", "key2", "copies"))
    return mixing.repeated(every, "copies", "copy", ["key1", "key2"]).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the ids; that they decode to the text's bytes is checked here, row by row."""
    coded = bpe.decode(bpe.encode(columns(docs), vocabulary()), vocabulary())
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids = F.when(F.col("decoded") == whole, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")))
    return coded.select("doc_id", "source", "lang", "n_tokens", ids.alias("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", remove_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Trained models, iteration and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
