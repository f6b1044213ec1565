"""The usage log: what was run and how many entities of each type it met, never a value."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, ts timestamp, mode string, command string, entity_counts map<string,bigint>"
MODES, COMMANDS = ("redact", "pseudonymise"), ("text", "image", "doc", "deid")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines log; those that don't parse or name an unknown command are passed over."""
    rows = spark.read.schema(SCHEMA + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & F.col("id").isNotNull() & F.col("command").isin(*COMMANDS) & F.col("mode").isin(*MODES)).drop("_bad")


def append(log: DataFrame, path: str, enabled: bool = False) -> bool:
    """Nothing is written unless logging was turned on."""
    if enabled:
        log.write.mode("append").json(path)
    return enabled


def retained(log: DataFrame, days: int, now: Column) -> DataFrame:
    return log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, n: a + n)


def by_type(log: DataFrame) -> DataFrame:
    return log.select(F.explode("entity_counts").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))


def clear(spark: SparkSession, path: str) -> None:
    """Deletes the log, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def adopt(source: str, target: str, names: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Copies files of an older place that the new one lacks: (names that failed, names that were there already)."""
    failed, present = [], []
    os.makedirs(target, exist_ok=True)
    for name in names:
        old, new = os.path.join(source, name), os.path.join(target, name)
        if os.path.exists(new):
            present.append(name)
        elif os.path.exists(old):
            try:
                shutil.copy2(old, new)
            except OSError:
                failed.append(name)
    return failed, present
