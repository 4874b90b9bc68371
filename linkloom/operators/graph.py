"""Confidence-weighted graph of a case as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import vocab as V
from linkloom.functions import labels
from linkloom.runtime import cut


def nodes_of(entities: DataFrame) -> DataFrame:
    return entities.select("case_id", "entity_id", "entity_type", "value", "first_seen_at")


def link_weight(enforce_rules: bool = True) -> Column:
    """Rule-table weight, or the stored score when rules are not enforced and it is set."""
    rule = labels.link_weight(F.col("link_type"))
    return rule if enforce_rules else F.coalesce(F.col("confidence_score").cast("double"), rule)


def compound(weights: Column) -> Column:
    """1 - prod(1 - w) over an array of weak weights, rounded to 4; one weight stays as it is."""
    missed = F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (
        1.0 - F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))))
    return F.when(F.size(weights) == 0, F.lit(0.0)).when(
        F.size(weights) == 1, F.element_at(weights, 1)).otherwise(F.round(1.0 - missed, 4))


def combine(weights: Column) -> Column:
    """Combined confidence of all links of one pair given as an array."""
    weak = compound(F.filter(weights, lambda w: w < V.WEAK_BELOW))
    strong = F.array_max(F.filter(weights, lambda w: w >= V.WEAK_BELOW))
    return F.when(F.size(weights) == 1, F.element_at(weights, 1)).otherwise(
        F.greatest(F.coalesce(strong, F.lit(0.0)), weak))


PAIR = ["case_id", "src", "dst"]


def _weight_parts() -> list[Column]:
    """What the combined weight of a pair is made of, as partial aggregates of fixed width."""
    w = F.col("w")
    weak = w < V.WEAK_BELOW
    return [
        F.count(F.lit(1)).alias("link_count"),
        F.max(F.when(~weak, w)).alias("__strong"),
        F.count_if(weak).alias("__weak_n"),
        F.max(F.when(weak, w)).alias("__weak_one"),
        F.product(F.when(weak, 1.0 - F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))).alias("__miss")]


def _grouped(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(
        *_weight_parts(),
        F.max_by("link_type", F.struct("w", -F.col("link_id"))).alias("link_type"),
        F.sort_array(F.collect_set("link_type")).alias("link_types"))


def _grouped_by_rules(pairs: DataFrame) -> DataFrame:
    """``_grouped`` where the weight follows from the link type. The smallest link id of each type of the rule
    table then says which types a pair has and which decides, so that every aggregate is a number and pairs are
    hashed, not sorted. Pairs with a link of any other type, if there are any, are found first and grouped the
    general way."""
    types = list(V.LINK_WEIGHTS)
    unlisted = ~F.coalesce(F.col("link_type").isin(types), F.lit(False))
    other = cut(pairs.filter(unlisted).select(*PAIR).distinct())
    none = other.isEmpty()

    def joined(how: str) -> DataFrame:
        o = other.toDF("__case", "__src", "__dst")
        return pairs.join(o, F.col("case_id").eqNullSafe(F.col("__case")) & (F.col("src") == F.col("__src"))
                          & (F.col("dst") == F.col("__dst")), how)

    # A link without an id comes after all others.
    least = [F.min(F.when(F.col("link_type") == t, F.coalesce("link_id", F.lit((1 << 63) - 1)))).alias(f"__{t}")
             for t in types]
    present = F.array_compact(F.array(*[
        F.when(F.col(f"__{t}").isNotNull(), F.lit(t)) for t in sorted(types)]))
    first = F.greatest(*[F.when(F.col(f"__{t}").isNotNull(), F.struct(
        F.lit(V.LINK_WEIGHTS[t]).alias("w"), (-F.col(f"__{t}")).alias("n"), F.lit(t).alias("t"))) for t in types])
    listed = (pairs if none else joined("left_anti")).groupBy(*PAIR).agg(*_weight_parts(), *least).select(
        *PAIR, "link_count", "__strong", "__weak_n", "__weak_one", "__miss",
        first["t"].alias("link_type"), present.alias("link_types"))
    return listed if none else listed.unionByName(_grouped(joined("left_semi")))


def consolidate(links: DataFrame, nodes: DataFrame | None = None,
                enforce_rules: bool = True) -> DataFrame:
    """One edge per unordered pair. Works on partial aggregates only, so a pair with very many
    links is never gathered in one place.

    With ``nodes``, edges to ids that are no node are left out. Such ids are found first, from the distinct
    ends of the links, and written; they are few or none, so the edges themselves seldom travel for them.
    """
    pairs = links.filter("entity_a_id <> entity_b_id").select(
        "case_id", F.least("entity_a_id", "entity_b_id").alias("src"),
        F.greatest("entity_a_id", "entity_b_id").alias("dst"), "link_id", "link_type",
        link_weight(enforce_rules).alias("w"))
    grouped = _grouped_by_rules(pairs) if enforce_rules else _grouped(pairs)
    compounded = F.when(F.col("__weak_n") == 0, F.lit(0.0)).when(
        F.col("__weak_n") == 1, F.col("__weak_one")).otherwise(
        F.round(1.0 - F.col("__miss"), 4))
    edges = grouped.withColumn(
        "confidence", F.when((F.col("link_count") == 1), F.coalesce("__strong", "__weak_one"))
        .otherwise(F.greatest(F.coalesce("__strong", F.lit(0.0)), compounded)))
    edges = edges.select(
        "case_id", "src", "dst", "confidence", "link_type", "link_types", "link_count",
        (1.0 / F.greatest("confidence", F.lit(V.MIN_CONFIDENCE))).alias("inverse_confidence"))
    if nodes is not None:
        ends = pairs.select("case_id", F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
        strange = cut(ends.join(nodes.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti"))
        edges = edges.filter("case_id IS NOT NULL")
        for end in ("src", "dst"):
            edges = edges.join(
                strange.withColumnRenamed("entity_id", end), ["case_id", end], "left_anti")
    return edges


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from each end: ``node``, ``peer`` and the edge attributes."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("peer")),
                   F.struct(F.col("dst").alias("node"), F.col("src").alias("peer")))
    rest = [c for c in edges.columns if c not in ("case_id", "src", "dst")]
    return edges.select("case_id", *rest, F.inline(ends))


def neighbourhood(edges: DataFrame, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """One-hop neighbours with edge attributes, for all nodes or those in ``of``
    (``case_id, node``)."""
    near = both_ways(edges)
    if of is not None:
        near = near.join(of.select("case_id", "node"), ["case_id", "node"], "left_semi")
    peers = nodes.select("case_id", F.col("entity_id").alias("peer"),
                         F.col("entity_type").alias("peer_type"), F.col("value").alias("peer_value"))
    return near.join(peers, ["case_id", "peer"]).select(
        "case_id", "node", "peer", "peer_type", "peer_value", "link_type",
        F.round("confidence", 4).alias("confidence"),
        labels.confidence_label(F.round("confidence", 4)).alias("confidence_label"))


def serialized_nodes(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    return nodes.join(clusters.select("case_id", "entity_id", "cluster_id"),
                      ["case_id", "entity_id"]).select(
        "case_id", F.col("entity_id").alias("id"), "entity_type", "value", "cluster_id"
    ).orderBy("case_id", "id")


def serialized_edges(edges: DataFrame) -> DataFrame:
    shown = F.round("confidence", 4)
    return edges.select(
        "case_id", F.col("src").alias("source"), F.col("dst").alias("target"),
        shown.alias("confidence"), "link_type",
        labels.confidence_label(shown).alias("confidence_label")
    ).orderBy("case_id", "source", "target")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graph document as line-delimited JSON: node rows and edge rows in two ordered datasets,
    split over as many files as the sort produces, instead of one document per case."""
    nodes.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")
