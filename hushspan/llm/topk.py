"""Exact top-k search by inner product: the threshold algorithm over sorted lists of each dimension.

Candidates are dealt into shards by a hash and queries into blocks; each pair of shard and block is one group. A shard
sorts its vectors once in every dimension. A query reads the lists in step, from the end its sign calls for, scores what
it meets in whole, and stops when the best that an unmet vector could reach cannot beat the k-th result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm.common import durable

#: Vectors of a shard, queries of a block, list entries read at a time.
SHARD, BLOCK, STRIDE = 4096, 4096, 16


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows padded with zeros to the width; exact integers held as floats where all sums stay below 2**53, else objects."""
    size = [len(x) for x in rows]
    if size and min(size) == max(size) == width:
        whole = np.stack(rows.to_numpy())
    else:
        whole = np.zeros((len(rows), width), np.int64)
        for i, x in enumerate(rows):
            whole[i, : len(x)] = x
    return whole


def fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    kind = float if most < 2**53 else object
    return a.astype(kind), b.astype(kind)


def search(ids: np.ndarray, own: np.ndarray, order: np.ndarray, name: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one shard for one query, ties to the smaller id; rows with the query's id take no part."""
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(n, bool)
    seen[ids == name] = True
    best_ids, best = np.empty(0, np.int64), np.empty(0, own.dtype)
    at = 0
    while True:
        stop = min(n, at + STRIDE) if len(up) + len(down) else n
        if stop == n:
            new = np.flatnonzero(~seen)
        else:
            met = np.concatenate([order[n - stop : n - at, up].ravel(), order[at:stop, down].ravel()])
            new = np.unique(met[~seen[met]])
        if len(new):
            seen[new] = True
            best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, own[new] @ query])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        at = stop
        if at >= n:
            break
        # what is unmet lies past this place in every list; an equal score could still win by a smaller id
        bound = (own[order[n - at, up], up] * query[up]).sum() + (own[order[at - 1, down], down] * query[down]).sum()
        if len(best) == k and best[-1] > bound:
            break
    return [(int(s), int(i)) for s, i in zip(best, best_ids, strict=True)]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest integer inner products, all if there are fewer.

    vectors: (vec_id long, embedding array of numbers), other columns ignored. A component x counts as floor(scale * x).
    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but those with the query's own vec_id.
    Null vectors, and those holding a null or non-finite component, take no part, nor does a null vec_id. Vectors of
    unequal length are compared as if padded with zeros. Of repeated query ids the smallest vector asks; repeated
    candidates are each returned. A score beyond a long is held at the nearest long.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = durable(vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")))
    asks = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    total, asked, width = rows.agg(F.count("*"), F.sum((F.col("vec_id") % every == 0).cast("int")), F.max(F.size("v"))).first()
    shards, blocks, width = max(1, -(-total // SHARD)), max(1, -(-(asked or 0) // BLOCK)), width or 0
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    # the second key of a candidate spreads copies of one id over the shards too
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    left = rows.select(spread.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), place(blocks, 7).alias("block"), "vec_id", "v")

    def best(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(ask):
            m, q = fit(matrix(own["v"], width), matrix(ask["v"], width))
            ids = own["vec_id"].to_numpy()
            order = np.argsort(m, axis=0, kind="stable")
            low, high = -(2**63), 2**63 - 1
            for name, query in zip(ask["vec_id"], q, strict=True):
                out += [(name, i, min(max(s, low), high)) for s, i in search(ids, m, order, name, query, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""
