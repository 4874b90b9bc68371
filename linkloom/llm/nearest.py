"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards. Each shard builds a KD-tree by median splits on the widest dimension, with a
tight bounding box at every node; leaves hold up to ``LEAF_ROWS`` rows. A query visits a shard's nodes best first, by the largest inner product that a node's box allows, and stops when that bound is
under the query's k-th score. The k-th score found in a first shard is propagated to all others, so that
most of their nodes are never opened. Queries and shards meet in blocks of bounded size.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take
no part; only vectors of one dimension are compared; rows with the query's id are the query's own and are
no candidates for it; repeated rows of other ids are candidates each; ties go to the smaller id; an empty
table, or one without queries, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import cut

SHARD_ROWS = 8_192
QUERY_BLOCK = 2_048
LEAF_ROWS = 512
SCALE = 64


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as doubles, which hold these integers exactly."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.filter(sound).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def split_tree(rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
    """Median-split tree: order of the rows, and arrays of nodes (first row, end, left child, right child),
    children behind their parent; leaves have no children."""
    order = np.arange(len(rows))
    nodes: list[list[int]] = [[0, len(rows), -1, -1]]
    at = 0
    while at < len(nodes):
        a, b = nodes[at][:2]
        if b - a > leaf_rows:
            part = rows[order[a:b]]
            width = part.max(0) - part.min(0)
            axis = int(width.argmax())
            if width[axis] > 0:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
                nodes[at][2:] = [len(nodes), len(nodes) + 1]
                nodes += [[a, a + middle, -1, -1], [a + middle, b, -1, -1]]
        at += 1
    return order, np.array(nodes)


def boxes(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tight lower and upper corner of every node, leaves first and then their parents."""
    low, high = np.empty((2, len(nodes), rows.shape[1]))
    for k in range(len(nodes) - 1, -1, -1):
        a, b, left, right = nodes[k]
        if left < 0:
            low[k], high[k] = rows[a:b].min(0), rows[a:b].max(0)
        else:
            low[k], high[k] = np.minimum(low[left], low[right]), np.maximum(high[left], high[right])
    return low, high


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
    """Best ``k`` rows of one shard for every query, none below the query's ``floor``.
    Yields (query number, ids, scores); the k-th score so far prunes the traversal."""
    order, nodes = split_tree(rows)
    ids, rows = ids[order], rows[order]
    low, high = boxes(rows, nodes)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    links = nodes.tolist()
    for q in range(len(queries)):
        limits, own, query = bound[q].tolist(), query_ids[q], queries[q]
        kth = floor[q]
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        heap = [(-limits[0], 0)]
        while heap and -heap[0][0] >= kth:
            a, b, left, right = links[heapq.heappop(heap)[1]]
            if left >= 0:
                heapq.heappush(heap, (-limits[left], left))
                heapq.heappush(heap, (-limits[right], right))
                continue
            scores = rows[a:b] @ query
            some = (scores >= kth) & (ids[a:b] != own)
            if some.any():
                best_ids, best = np.concatenate([best_ids, ids[a:b][some]]), np.concatenate([best, scores[some]])
                if len(best) >= k:
                    keep = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[keep], best[keep]
                    kth = max(kth, best[-1])
        yield q, best_ids, best


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Per query its ``k`` best rows: query_id, rank, vec_id, score. ``vectors`` has vec_id and v."""
    base = cut(vectors.select("vec_id", "v", F.size("v").alias("d"), is_query.alias("asked")))
    n, asked = base.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / query_block))
    base = base.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(shards)).cast("int"))
    block = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)).cast("int").alias("block")
    queries = base.filter("asked").select("vec_id", "v", "d", "shard", block).distinct()
    found = "query_id long, vec_id long, score double"

    def meet(key: tuple, rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(rows) and len(asking):
            for q, ids, scores in search(rows["vec_id"].to_numpy(), _matrix(rows["v"]), asking["vec_id"].to_numpy(),
                                         _matrix(asking["v"]), asking["floor"].to_numpy(), k):
                parts.append(pd.DataFrame({"query_id": asking["vec_id"].iloc[q], "vec_id": ids, "score": scores}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def joined(asking: DataFrame, rows: DataFrame) -> DataFrame:
        keys = ["d", "shard", "block"]
        return rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(meet, found)

    def ranked(rows: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # A first shard per query, its own: its k-th score is where every other shard may stop.
    to_blocks = base.select("vec_id", "v", "d", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    first = cut(joined(queries.withColumn("floor", F.lit(float("-inf"))), to_blocks))
    kth = ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth"))
    others = queries.join(kth, F.col("vec_id") == F.col("of"), "left").select(
        "vec_id", "v", "d", "block", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))).alias("shard"))
    rest = joined(others.toDF(*others.columns), to_blocks.toDF(*to_blocks.columns))
    return ranked(first.unionByName(rest)).select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast("long"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
