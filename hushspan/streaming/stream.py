"""The same plans over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushspan.plans.pipeline import Pipeline


def redact_stream(docs: DataFrame, pipeline: Pipeline, mode: str = "redact", key: bytes | None = None) -> DataFrame:
    """Stateless: token numbers are those of each document alone."""
    return pipeline.run(docs, mode, key)


def audit_stream(log: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, type, n): entities by type and window of ts, closed once the watermark has passed."""
    one = log.withWatermark("ts", late).select("ts", F.explode("entity_counts").alias("type", "k"))
    return one.groupBy(F.window("ts", window), "type").agg(F.sum("k").alias("n"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
