"""Helpers for operators on similar pairs: spanning stars instead of pairs, and bounded blocks of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.clusters import components
from linkloom.runtime import cut


class Union:
    """Union-find over local row numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the ends of links; links inside a set cost nothing."""
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([a[apart], b[apart]], 1), axis=0)
        above = dict.fromkeys(np.unique(pairs).tolist())
        above = {k: k for k in above}

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                above[max(x, y)] = min(x, y)
        move = np.arange(len(self.root))
        for x in above:
            move[x] = top(x)
        self.root = move[self.root]

    def stars(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest id, other id) for every member of a set of two or more."""
        order = np.lexsort((ids, self.root))
        group = self.root[order]
        head = np.ones(len(order), bool)
        head[1:] = group[1:] != group[:-1]
        first = ids[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else ids
        other = ~head & (first != ids[order])
        return first[other], ids[order][other]


def roots(stars: DataFrame) -> DataFrame:
    """(id, root) of all ends of links (a, b): root is the smallest id that links lead to."""
    edges = cut(stars.select(F.lit(0).alias("case_id"), F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    nodes = edges.select("case_id", F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return components(nodes, edges).select(F.col("entity_id").alias("id"), "root")


def in_blocks(rows: DataFrame, group: str, block_rows: int, weight: str | None = None) -> DataFrame:
    """Rows of groups, placed so that any two rows of a group meet in one bounded task: keys ``big``, ``grp``,
    ``bi``, ``bj`` and the row's own ``block``. Groups of up to ``block_rows`` share tasks; a larger one is
    split into blocks by a hash, and each pair of its blocks is a task. ``weight`` counts a row as several."""
    rows = cut(rows)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = rows.groupBy(group).agg(size.alias("size"))
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    large = cut(sizes.filter(F.col("size") > block_rows).select(F.col(group).alias("of"), blocks.alias("blocks")))
    total = rows.agg(F.coalesce(size, F.lit(0))).first()[0]
    shared = int(2 * total // block_rows) + 1
    placed = rows.join(large, F.col(group) == F.col("of"), "left").withColumn("big", F.col("blocks").isNotNull())
    small = placed.filter(~F.col("big")).withColumns({
        "grp": F.pmod(F.xxhash64(group), F.lit(shared)), "bi": F.lit(0), "bj": F.lit(0), "block": F.lit(0)})
    split = placed.filter("big").withColumn("block", F.pmod(F.xxhash64("id", F.lit(17)), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
        "grp": F.col(group).cast("long"), "bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other")
    return small.unionByName(split).drop("of", "blocks")


BLOCK_KEYS = ["big", "grp", "bi", "bj"]
TILE = 1024
"""rows and columns of the largest matrix of links"""


def runs(values: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each distinct value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    yield from np.split(order, cuts) if len(order) else ()


def count_links(block: np.ndarray, bi: int, bj: int, copies: np.ndarray, alike) -> tuple[np.ndarray, Union]:
    """Links of every row of one group in the task of its blocks ``bi`` and ``bj``, and the sets that they form.
    Rows of one block are compared only where both are that block, as a task may have rows of one of two only.
    ``alike(a, b)`` is the matrix of links between two lists of rows, asked for in tiles of ``TILE`` rows a side."""
    links, union = np.zeros(len(block), np.int64), Union(len(block))
    rows, others = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    for i in range(0, len(rows), TILE):
        for j in range(i if bi == bj else 0, len(others), TILE):
            a, b = rows[i:i + TILE], others[j:j + TILE]
            near = alike(a, b)
            same = bi == bj and i == j
            if same:
                np.fill_diagonal(near, False)
            links[a] += near @ copies[b]
            if not same:
                links[b] += near.T @ copies[a]
            x, y = np.nonzero(near)
            union.join(a[x], b[y])
    return links, union
