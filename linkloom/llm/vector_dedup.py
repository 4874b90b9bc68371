"""Near-duplicate vectors by sorted projection passes.

Each pass has random hyperplanes of its own. The signs of a vector's projections, one after the other,
are its key; vectors are ordered by label and key, and each is compared with a bounded window of
neighbours. Pairs at or over the threshold are united, and the sets of all passes are joined into
components. Equal vectors are one vector with a count. Links are then counted exactly inside every
component, in bounded blocks, so that windows limit only what is needed to reach a vector once.

Hyperplanes go through the mean of a label's unit vectors, as embeddings often share a direction. How many
passes there are follows from the first ones: from the key bits that vectors there share with the end of
their window, and their distance from the mean. Where that many passes would compare as much as all pairs of
the largest label and still be short of the recall, which happens to labels too spread out or too uniform for
sorting, the vectors of a label are compared in bounded blocks as well, so that no link is lost.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with
a null label, link with nothing; vectors of other dimensions never link; a null id stays null in its row
and counts as larger than any other; repeated rows are vectors of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.groups import BLOCK_KEYS, Union, count_links, in_blocks, roots, runs
from linkloom.runtime import cut

THRESHOLD = 0.93
BITS = 62
WINDOW = 48
RECALL = 0.999
FIRST_PASSES = 8
BLOCK_ROWS = 1024
SEED = 29


def chance(bits: np.ndarray, spread: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Probability that a vector and another at the threshold agree in their first ``bits`` signs: each agrees with
    probability 1 - angle / pi, the angle at the mean, from which both have the squared distance ``spread``."""
    cosine = 1 - (1 - threshold) / np.maximum(spread, 1e-12)
    return (1 - np.arccos(np.clip(cosine, 0, 1)) / math.pi) ** bits


def passes_for(once: np.ndarray, rows: np.ndarray, most: int, recall: float = RECALL) -> int:
    """Passes until a pair at the threshold has been inside one window with probability ``recall``, over ``rows``
    vectors that one pass gives that probability ``once``; 0 if there would be more than ``most``."""
    passes = FIRST_PASSES
    while (rows * (1 - once) ** passes).sum() > (1 - recall) * rows.sum():
        passes += max(1, passes // 16)
        if passes > most:
            return 0
    return passes


def _planes(dim: int, at: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, at]).normal(size=(BITS, dim))


def _matrix(values: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of the rows ``at``, all of ``dim`` components."""
    ends = np.cumsum(np.diff(values.offsets.to_numpy()))
    return values.flatten().to_numpy(zero_copy_only=False)[(ends[at] - dim)[:, None] + np.arange(dim)]


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def means_of(classes: DataFrame) -> DataFrame:
    """(grp, label, dim, n, mean) of the unit vectors of every label and dimension."""
    def sums(batches):
        for batch in batches:
            values, label = batch.column("v"), pd.factorize(batch.column("label").to_pandas())
            sizes = np.diff(values.offsets.to_numpy())
            out = []
            for at in runs(label[0].astype(np.int64) * (1 << 32) + sizes):
                dim = int(sizes[at[0]])
                out.append((label[1][label[0][at[0]]], dim, len(at), _unit(_matrix(values, at, dim)).sum(0)))
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in out] for i, k in enumerate(("label", "dim", "n", "total"))}, schema=pa.schema(
                [("label", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]))

    parts = classes.select("label", "v").mapInArrow(sums, "label string, dim int, n long, total array<double>")
    cells = parts.select("label", "dim", "n", F.posexplode("total").alias("place", "x")).groupBy("label", "dim", "place").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"))
    means = cells.groupBy("label", "dim").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", F.col("x") / F.col("n")))).alias("cells"))
    return cut(means.select(F.monotonically_increasing_id().alias("grp"), "label", "dim", "n", F.col("cells.col2").alias("mean")))


def _windowed(label: np.ndarray, dim: np.ndarray, vectors: np.ndarray, ids: np.ndarray, threshold: float, window: int):
    """Stars of the pairs within ``window`` places of each other, for rows of one dimension in sorted order."""
    union = Union(len(ids))
    for step in range(1, min(window, len(ids) - 1) + 1):
        open_ = np.flatnonzero((label[:-step] == label[step:]) & (union.root[:-step] != union.root[step:]))
        if len(open_):
            near = np.einsum("nd,nd->n", vectors[open_], vectors[open_ + step]) >= threshold
            union.join(open_[near], open_[near] + step)
    return union.stars(ids)


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"),
                          F.when(F.coalesce(sound, F.lit(False)), x).alias("v"))
    rows = cut(rows.withColumn("same", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("label", "v")), 256))))
    classes = rows.filter("same IS NOT NULL").groupBy("same").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    means = means_of(classes)
    n, largest = means.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = cut(classes.withColumn("dim", F.size("v")).join(means.drop("n"), ["label", "dim"]))

    def keys(first, passes):
        def run(batches):
            for batch in batches:
                ids, labels, values, centres = (batch.column(c) for c in ("id", "label", "v", "mean"))
                sizes = np.diff(values.offsets.to_numpy())
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    moved = _unit(_matrix(values, at, dim)) - _matrix(centres, at, dim)
                    take = pa.array(at)
                    rest = [pa.array(np.full(len(at), dim, np.int32)), ids.take(take), labels.take(take), values.take(take), pa.array((moved ** 2).sum(1))]
                    for k in range(first, passes):
                        codes = (moved @ _planes(dim, k).T > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(codes), *rest],
                                                         names=["pass", "code", "dim", "id", "label", "v", "spread"])
        return run

    def neighbours(measure):
        def run(batches):
            rest = None
            for batch in batches:
                pdf = batch.to_pandas()
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                found, chances = [], [(np.empty(0, np.int64), np.empty(0))]
                for at in runs(pdf["pass"].to_numpy(np.int64) * (1 << 32) + pdf["dim"].to_numpy(np.int64)):
                    matrix = _unit(np.array(pdf["v"].iloc[at].tolist()))
                    label, ids = pd.factorize(pdf["label"].iloc[at])[0], pdf["id"].to_numpy()[at]
                    found.append(_windowed(label, None, matrix, ids, threshold, window))
                    if measure and len(at) > window:
                        # Vectors near to the end of their window are in a dense group, whose members reach each other.
                        code = pdf["code"].to_numpy(np.int64)[at]
                        near = np.einsum("nd,nd->n", matrix[:-window], matrix[window:]) >= threshold
                        open_ = np.flatnonzero((label[:-window] == label[window:]) & ~near)
                        other = code[open_] ^ code[open_ + window]
                        shared = BITS - np.array([x.bit_length() for x in other.tolist()], np.int64)
                        chances.append((ids[open_], chance(shared + 1, pdf["spread"].to_numpy()[at][open_], threshold)))
                a, b = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(2))
                seen, once = (np.concatenate([c[i] for c in chances]) for i in range(2))
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.concatenate([a, seen]), pa.int64()), "b": pa.array(np.concatenate([b, np.full(len(seen), -1)]), pa.int64()),
                    "once": pa.array(np.concatenate([np.zeros(len(a)), once]))})
                rest = pdf.iloc[-window:]
        return run

    def windows(first, passes, measure=False):
        keyed = placed.select("id", "label", "v", "mean").mapInArrow(
            keys(first, passes), "pass int, code long, dim int, id long, label string, v array<double>, spread double")
        order = ["pass", "dim", "label", "code", "id"]
        parts = max(1, math.ceil(n * (passes - first) / 20_000))
        ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return cut(ordered.mapInArrow(neighbours(measure), "a long, b long, once double"))

    stars = windows(0, FIRST_PASSES, True)
    seen = stars.filter("b < 0").groupBy("a").agg(F.avg("once").alias("once"))
    step = F.round(F.log("once") * 20)
    seen = seen.groupBy(step.alias("step")).agg(F.min("once").alias("once"), F.count(F.lit(1)).alias("rows")).toPandas()
    passes = passes_for(seen["once"].to_numpy(float), seen["rows"].to_numpy(float), max(FIRST_PASSES, math.ceil(largest / window)))
    whole = not passes
    if not whole:
        stars = stars.filter("b >= 0").select("a", "b")
        if passes > FIRST_PASSES:
            stars = stars.unionByName(windows(FIRST_PASSES, passes).select("a", "b"))
        reached = cut(roots(stars))
        members = classes.join(reached, "id").select("id", "copies", "v", "root")
    else:
        members = placed.select("id", "copies", "v", F.col("grp").alias("root"))

    def exact(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies, block = (pdf[c].to_numpy() for c in ("id", "copies", "block"))
        parts = []
        for at in runs(pdf["root"].to_numpy()):
            matrix = _unit(np.array(pdf["v"].iloc[at].tolist()))
            links, union = count_links(block[at], *key[2:], copies[at], lambda a, b: matrix[a] @ matrix[b].T >= threshold)
            parts.append(pd.DataFrame({"id": ids[at], "links": links, "to": -1}))
            if whole:
                a, b = union.stars(ids[at])
                parts.append(pd.DataFrame({"id": a, "links": 0, "to": b}))
        return pd.concat(parts) if parts else pd.DataFrame({"id": [], "links": [], "to": []})

    counted = in_blocks(members, "root", BLOCK_ROWS).groupBy(*BLOCK_KEYS).applyInPandas(exact, "id long, links long, to long")
    if whole:
        counted = cut(counted)
        reached = cut(roots(counted.filter("`to` >= 0").select(F.col("id").alias("a"), F.col("to").alias("b"))))
    counted = counted.filter("`to` < 0").groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("id", "same", "first", "copies").join(reached, "id", "left").join(counted, "id", "left")
    named = cut(named.select("same", "first", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("same").alias("of"), "component_id", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = rows.select("vec_id", "same").join(named, F.col("same") == F.col("of"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = low.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM low
"""
