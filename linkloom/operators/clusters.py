"""Connected components of all cases at once, and per-case cluster statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.numbering import id_buckets, number_within
from linkloom.runtime import Appended, cut


# Edges whose components one task works out at a time, in some 100 MB. A case with more is split.
LOCAL_EDGES = 1 << 19


def _both(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) from each end, as (x, y)."""
    return edges.select("case_id", F.inline(F.array(
        F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
        F.struct(F.col("v").alias("x"), F.col("u").alias("y")))))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    # Large star: neighbours above u point at the smallest of u and its neighbours.
    sym = _both(edges)
    low = sym.groupBy("case_id", "x").agg(F.min("y").alias("m")).select(
        "case_id", "x", F.least("m", "x").alias("m"))
    large = sym.filter("y > x").join(low, ["case_id", "x"]).select(
        "case_id", F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    # Small star: u and its smaller neighbours point at the smallest of them.
    low = large.groupBy("case_id", "u").agg(F.min("v").alias("m"))
    joined = large.join(low, ["case_id", "u"])
    return joined.filter("v <> m").select("case_id", F.col("v").alias("u"), F.col("m").alias("v")
                                          ).unionByName(
        low.select("case_id", "u", F.col("m").alias("v"))).distinct()


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, codes = np.unique(values, return_inverse=True)
    return known, codes.reshape(-1)


def _smallest(case: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(case, id, smallest id reachable) for every id of the edges (u, v) but the smallest ones themselves.
    Roots are hooked to the smallest root next to them until no edge is left between two roots."""
    cases, c = _codes(case)
    ids, n = _codes(np.concatenate([u, v]))
    nodes, at = _codes(np.concatenate([c, c]) * len(ids) + n)
    parent = np.arange(len(nodes))
    a, b = at[:len(u)], at[len(u):]
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, hi, lo)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return cases[nodes[below] // len(ids)], ids[nodes[below] % len(ids)], ids[nodes[parent[below]] % len(ids)]


def _local_stars(edges: DataFrame) -> DataFrame:
    """Edges (case_id, part, u, v) replaced by stars (case_id, u, v): every id points at the smallest one it is
    connected to by the edges read with it. Parts are read in order, as many as have ``LOCAL_EDGES`` edges at
    a time and none in two pieces but longer ones."""
    limit = LOCAL_EDGES
    columns = ["case_id", "u", "v", "part"]
    schema = T.StructType([edges.schema[c] for c in columns[:3]])

    def stars(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _smallest(*held[:3])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, n = [], 0
        for batch in batches:
            pieces.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            n += batch.num_rows
            if n <= limit:
                continue
            held = [np.concatenate(x) for x in zip(*pieces)]
            # The last part may go on, so the parts before it go; alone it goes as far as it was read.
            last = (held[0] == held[0][-1]) & (held[3] == held[3][-1])
            at = n if last.all() else int(np.argmax(last))
            yield stars([x[:at] for x in held])
            pieces, n = [[x[at:] for x in held]], n - at
        if n:
            yield stars([np.concatenate(x) for x in zip(*pieces)])

    return edges.select(*columns).repartition("case_id", "part").sortWithinPartitions("case_id", "part").mapInArrow(run, schema)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable entity id per node. Cases of at most ``LOCAL_EDGES`` edges are read whole by one task,
    which finds their components in memory. Larger ones are split by a hash, their parts reduced to stars the
    same way (no more edges than nodes, with the same components), and the stars joined in rounds by
    ``_joined_stars``, so no case has to fit into one task. Repeated edges may come in.
    """
    key = ["case_id", "entity_id"]
    current = cut(edges.select("case_id", F.col("dst").alias("u"), F.col("src").alias("v"))).filter(
        "case_id IS NOT NULL AND u <> v")
    large = cut(current.groupBy("case_id").agg(F.ceil(F.count(F.lit(1)) / LOCAL_EDGES).cast("int").alias("parts")).filter("parts > 1"))
    small = current.join(large.select("case_id"), "case_id", "left_anti").withColumn("part", F.lit(0))
    split = current.join(large, "case_id").withColumn("part", F.pmod(F.xxhash64("u"), "parts").cast("int"))
    found = cut(_local_stars(small)).toDF(*key, "root")
    roots = found.unionByName(_joined_stars(cut(_local_stars(split))))
    return nodes.select(*key).join(roots, key, "left").withColumn("root", F.coalesce("root", "entity_id"))


def _joined_stars(current: DataFrame) -> DataFrame:
    """(case_id, entity_id, root) by alternating large-star and small-star steps
    (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

    Each step is one aggregation for the neighbourhood minimum and one equality join back, so a
    hub's edges are spread over tasks by the adaptive skew join. The number of rounds grows with
    the logarithm of the component diameter. Every round is written to shared storage.

    After a round, nodes whose only neighbour is smaller are taken out: nothing but that neighbour
    depends on them, so later rounds read only what is left. Stars vanish whole, and when
    nothing is left the nodes take the roots of their neighbours, last ones first.
    """
    taken = []
    while not current.isEmpty():
        current = cut(_round(current))
        only = _both(current).groupBy("case_id", "x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("v"))
        leaves = cut(only.filter("n = 1 AND v < x").select("case_id", F.col("x").alias("u"), "v"))
        taken.append(leaves)
        current = cut(current.join(leaves.select("case_id", "u"), ["case_id", "u"], "left_anti"))
    roots = Appended(current.select("case_id", F.col("u").alias("entity_id"), F.col("v").alias("root")))
    for leaves in reversed(taken):
        above = roots.read().select("case_id", F.col("entity_id").alias("v"), "root")
        roots.add(leaves.join(above, ["case_id", "v"], "left").select(
            "case_id", F.col("u").alias("entity_id"), F.coalesce("root", "v").alias("root")))
    return roots.read()


def with_cluster_ids(labelled: DataFrame) -> DataFrame:
    """Cluster size and rank per node: largest cluster first, then smallest member id."""
    labelled = cut(labelled)
    sizes = cut(labelled.groupBy("case_id", "root").agg(F.count(F.lit(1)).alias("cluster_size")))
    ranked = number_within(
        sizes, ["case_id"], [-F.col("cluster_size"), *id_buckets(F.col("root"))],
        [F.col("root")], "cluster_id", start=0)
    return labelled.join(ranked, ["case_id", "root"]).select(
        "case_id", "entity_id", "cluster_id", "cluster_size")


def clusters_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return cut(with_cluster_ids(components(nodes, edges)))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("case_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"))


def median_sizes(clusters: DataFrame) -> DataFrame:
    """Interpolated median cluster size per case, over size counts rather than clusters."""
    sizes = cluster_sizes(clusters)
    counted = sizes.groupBy("case_id", "cluster_size").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("case_id").agg(
        F.sum("n").alias("n_clusters"),
        F.max("cluster_size").alias("largest"),
        F.percentile("cluster_size", 0.5, F.col("n")).alias("median_size"))
