"""Token counts as delta-maintained rollups.

A batch holds signed changes: +1 for a document that arrives, -1 for one that goes; a revision is both. It is reduced to
additive totals by source, language and tokenizer version, written aside, and taken in by renaming one folder. A batch
whose number is taken in already changes nothing, so a batch that is sent again, or retried after a failure, counts once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Totals kept under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _system(self):
        return self._file().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> set[str]:
        fs, at = self._system(), self._file("batches")
        return {x.getPath().getName() for x in fs.listStatus(at)} if fs.exists(at) else set()

    def _covers(self, base: str) -> set[str]:
        """What a base stands for: batches, and bases before it."""
        return {r["batch"] for r in self.spark.read.parquet(f"{self.path}/batches/{base}/covers").collect()}

    def taken(self) -> list[str]:
        """Names of the batches and bases that count: those which no base covers. A compaction that was broken off after its
        base was taken in leaves covered folders behind, which count for nothing."""
        names = self._names()
        return sorted(names - set().union(*(self._covers(x) for x in names if x.startswith("base-"))))

    def covered(self) -> set[str]:
        """Numbers of all batches taken in, compacted ones included."""
        names = self._names()
        every = names.union(*(self._covers(x) for x in names if x.startswith("base-")))
        return {x for x in every if not x.startswith("base-")}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Takes in changes (source, lang, tokenizer, n_tokens, sign) as the batch of this name; False if it has been."""
        if not batch or "/" in batch or batch.startswith(("base-", "_", ".")):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.covered():
            return False
        total = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        return self._take_in(batch, total.where("n_docs <> 0 or n_tokens <> 0"), None)

    def _take_in(self, name: str, totals: DataFrame, covers: list[str] | None) -> bool:
        """Writes aside, then renames. Of several writers of one batch the first rename counts: a later one fails, or moves
        its folder inside of the first one's, where nothing reads it, and takes it away again. A writer may die anywhere:
        what lies aside counts for nothing, and the batch can be sent again."""
        fs, aside = self._system(), f"aside/{uuid.uuid4().hex}"
        totals.selectExpr("source", "lang", "tokenizer", "CAST(n_docs AS long)", "CAST(n_tokens AS long)").write.parquet(f"{self.path}/{aside}/totals")
        if covers is not None:
            self.spark.createDataFrame([(x,) for x in covers], "batch string").write.parquet(f"{self.path}/{aside}/covers")
        fs.mkdirs(self._file("batches"))
        done = self._file("batches", name)
        if fs.exists(done) or not fs.rename(self._file(aside), done):
            fs.delete(self._file(aside), True)
            return False
        inside = self._file("batches", name, aside[6:])
        return not (fs.exists(inside) and fs.delete(inside, True))

    def totals(self) -> DataFrame:
        """Additive totals of all batches taken in; keys whose documents have all gone are left out."""
        return self._sum(self.taken())

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        parts = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/batches/{x}/totals" for x in names])
        return parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Replaces the batches by one base that remembers their names. Batches may be committed meanwhile; compactions run
        one at a time, but two of the same batches give the same base."""
        names = self.taken()
        if len(names) >= 2:
            base = f"base-{hashlib.sha256(repr(names).encode()).hexdigest()[:32]}"
            self._take_in(base, self._sum(names), sorted({x for n in names if n.startswith("base-") for x in self._covers(n)} | set(names)))
        self._sweep()

    def _sweep(self) -> None:
        """Deletes the folders that a base covers; nothing counts them any more, so it may break off anywhere. A name that
        is covered stays covered: bases list the batches of the bases before them."""
        fs = self._system()
        for x in sorted(self._names() - set(self.taken())):
            fs.delete(self._file("batches", x), True)


def changes(docs: DataFrame, tokenizer: str, count: Callable[[DataFrame], DataFrame] | None = None, sign: int = 1) -> DataFrame:
    """Documents (text, source, lang) as changes; count adds n_tokens, unless docs have them. Null source or lang are keys
    of their own; a null text has 0 tokens and still counts as a document."""
    counted = docs if "n_tokens" in docs.columns else count(docs.select("text", "source", "lang"))
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(sign).alias("sign"))


def revised(old: DataFrame, new: DataFrame, tokenizer: str, count: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Changes that replace old rows by new ones."""
    return changes(old, tokenizer, count, -1).unionByName(changes(new, tokenizer, count, 1))
