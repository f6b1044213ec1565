"""What the operators share: durable tables in the shared folder, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, in local mode only, a new folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hushspan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts reach Python workers in batches of so many rows, unless the session has set a size of its own: Spark's
    default of 10,000 rows of whole documents is more than a worker should hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def trim() -> None:
    """Gives what a Python worker has freed back to the system, where the C library can: workers live on between stages."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def durable(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hushspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside lambdas, where the optimiser would otherwise repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Copies of one row that a task unfolds at once.
UNFOLD = 100_000


def repeated(df: DataFrame, times: str, index: str, spread: list[str]) -> DataFrame:
    """Each row of df as often as `times` says, with its index from 1. Rows that come very often are cut into blocks, which
    are dealt out over tasks, before they are unfolded."""
    some = df.where(F.col(times) <= UNFOLD).withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    blocks = df.where(F.col(times) > UNFOLD).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / UNFOLD))))
    blocks = blocks.repartition(*spread, "_block")
    first, last = F.col("_block") * UNFOLD + 1, F.least(F.col(times), (F.col("_block") + 1) * UNFOLD)
    return some.unionByName(blocks.withColumn(index, F.explode(F.sequence(first, last))).drop("_block"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): one row (node, root) for each linked node, root the smallest of its component.

    Rounds of hooking and contraction: each node hooks to its smallest neighbour below it, chains are flattened by
    pointer doubling, links are contracted to roots. Each round at least halves the roots of a component. All joins are
    plain equi-joins whose hot keys (hubs) adaptive execution may split; minima are combined before the shuffle.
    Null ends and self links count for nothing; no link gives an empty table.
    """
    links = durable(links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) AS hi", "least(a, b) AS lo").distinct())
    whole = None
    while links.head(1):
        tree = durable(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        while True:
            up = tree.select(F.col("node").alias("via"), F.col("root").alias("top"))
            step = durable(tree.join(up, tree["root"] == up["via"], "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
            tree = step.select("node", "root")
            if not step.where("moved").head(1):
                break
        up = tree.select(F.col("node").alias("via"), F.col("root").alias("top"))
        if whole is None:
            low = links.select(F.col("lo").alias("node"))
            whole = tree.unionByName(low.distinct().join(tree, "node", "left_anti").withColumn("root", F.col("node")))
        else:
            whole = whole.join(up, whole["root"] == up["via"], "left").select("node", F.coalesce("top", "root").alias("root"))
        whole = durable(whole)
        out = links.join(up, links["lo"] == up["via"], "left").select("hi", F.coalesce("top", "lo").alias("lo"))
        out = out.join(up, out["hi"] == up["via"], "left").select(F.coalesce("top", "hi").alias("hi"), "lo")
        links = durable(out.where("hi <> lo").selectExpr("greatest(hi, lo) AS hi", "least(hi, lo) AS lo").distinct())
    return links.selectExpr("hi AS node", "lo AS root") if whole is None else whole
