"""Strongest paths: least sum of inverse confidence, for a batch of node pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.graph import both_ways
from linkloom.runtime import Appended, cut

PAIR = ["case_id", "source", "target"]
LABEL = [*PAIR, "side", "node", "cost", "hops", "pred"]
FORWARD, BACKWARD = 0, 1


def strongest_paths(edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (case_id, source, target) with ``path``, ``cost`` and ``hops``; nulls when one
    end is missing or no path exists. A node's path to itself is the node alone. Among equal costs
    fewer hops decide, then smaller ids of the nodes where the searches met and came from.

    All pairs are searched at once, each from both ends, in bands of cost. No edge of a case costs less than
    its ``band``, so labels within one band of the least open label of their side are final: they are written
    once, relaxed once and never written again. A pair is done when its least open labels from
    both sides together cost no less than the best meeting found; open labels that cannot beat it go. Labels
    hold the node they came from instead of a path, and the paths of the answers alone are walked back.
    """
    known = nodes.select("case_id", "entity_id")
    asked = pairs.select(*PAIR).distinct()
    start = asked.join(known.withColumnRenamed("entity_id", "source"), ["case_id", "source"],
                       "left_semi").join(
        known.withColumnRenamed("entity_id", "target"), ["case_id", "target"], "left_semi")
    adjacent = cut(both_ways(edges.select("case_id", "src", "dst", "inverse_confidence")).join(
        start.select("case_id").distinct(), "case_id", "left_semi"))
    bands = cut(adjacent.groupBy("case_id").agg(F.min("inverse_confidence").alias("band")))
    none = F.lit(None).cast("long")
    ends = F.array(F.struct(F.lit(FORWARD).alias("side"), F.col("source").alias("node")),
                   F.struct(F.lit(BACKWARD).alias("side"), F.col("target").alias("node")))
    open_ = cut(start.select(*PAIR, F.inline(ends)).select(
        "*", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), none.alias("pred")))
    met = open_.filter("source = target AND side = 0").select(*PAIR, _meeting(
        F.lit(0.0), F.lit(0), F.col("node"), none, none).alias("met"))
    state = _state(open_, met, bands)
    settled = Appended(open_.select(*LABEL))
    covered = None
    while going := state.filter("searching").count():
        if covered is not None and 2 * going <= covered:
            # Most pairs are done: later rounds read only the edges of cases that are still searched.
            adjacent = cut(adjacent.join(state.filter("searching").select("case_id").distinct(), "case_id", "left_semi"))
        if covered is None or 2 * going <= covered:
            covered = going
        labels = open_.join(state.filter("searching").drop("searching"), PAIR)
        forward = F.col("side") == FORWARD
        own, other = F.when(forward, F.col("f")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("f"))
        labels = labels.filter(F.col("met").isNull() | (F.col("cost") + other < F.col("met.cost")))
        final = F.col("cost") < own + F.col("band")
        fresh = settled.add(labels.filter(final).select(*LABEL))
        step = fresh.join(adjacent, ["case_id", "node"]).select(
            *PAIR, "side", F.col("peer").alias("node"), (F.col("cost") + F.col("inverse_confidence")).alias("cost"),
            (F.col("hops") + 1).alias("hops"), F.col("node").alias("pred"))
        changing = labels.filter(~final).select(*LABEL).unionByName(step).withColumn("final", F.lit(False))
        done = settled.read().join(state.filter("searching").select(*PAIR), PAIR, "left_semi")
        merged = cut(_by_node(changing.unionByName(done.withColumn("final", F.lit(True)))))
        open_ = merged.select(*PAIR, "node", F.inline(F.filter(F.array(
            F.struct(F.lit(FORWARD).alias("side"), "f.*", F.col("f_final").alias("final")),
            F.struct(F.lit(BACKWARD).alias("side"), "b.*", F.col("b_final").alias("final"))),
            lambda x: ~x["final"]))).select(*LABEL)
        meetings = merged.filter("f IS NOT NULL AND b IS NOT NULL").select(*PAIR, _meeting(
            F.col("f.cost") + F.col("b.cost"), F.col("f.hops") + F.col("b.hops"), F.col("node"),
            F.col("f.pred"), F.col("b.pred")).alias("met"))
        state = _state(open_, state.filter("met IS NOT NULL").select(*PAIR, "met").unionByName(meetings), bands)
    found = cut(state.filter("met IS NOT NULL").select(*PAIR, "met.*"))
    return asked.join(_walked(found, settled), PAIR, "left")


def _meeting(cost: Column, hops: Column, node: Column, before: Column, after: Column) -> Column:
    return F.struct(cost.alias("cost"), hops.alias("hops"), node.alias("node"), before.alias("before"), after.alias("after"))


def _state(open_: DataFrame, met: DataFrame, bands: DataFrame) -> DataFrame:
    """Per pair: least open cost of each side, best meeting so far, band, and whether to go on."""
    least = open_.groupBy(*PAIR).agg(F.min(F.when(F.col("side") == FORWARD, F.col("cost"))).alias("f"),
                                     F.min(F.when(F.col("side") == BACKWARD, F.col("cost"))).alias("b"))
    best = met.groupBy(*PAIR).agg(F.min("met").alias("met"))
    unbeaten = F.col("met").isNull() | (F.col("f") + F.col("b") < F.col("met.cost"))
    going = F.col("f").isNotNull() & F.col("b").isNotNull() & F.col("band").isNotNull() & unbeaten
    return cut(least.join(best, PAIR, "full").join(bands, "case_id", "left").withColumn("searching", going))


def _by_node(labels: DataFrame) -> DataFrame:
    """Best label of each side per node, for nodes with an open label; final ones are the best of their node."""
    label = F.struct("cost", "hops", "pred")

    def side(k: int) -> list[Column]:
        here = F.col("side") == k
        return [F.min(F.when(here, label)).alias("fb"[k]), F.max(F.when(here, F.col("final"))).alias("fb"[k] + "_final")]

    return labels.groupBy(*PAIR, "node").agg(*side(FORWARD), *side(BACKWARD)).filter(
        "NOT f_final OR NOT b_final")


def _walked(found: DataFrame, settled: Appended) -> DataFrame:
    """Paths of the answers: from the meeting node back to both ends along the nodes that labels came from."""
    came = cut(settled.read().filter("pred IS NOT NULL").join(found.select(*PAIR), PAIR, "left_semi").select(
        *PAIR, "side", "node", "pred"))
    sides = F.array(F.struct(F.lit(FORWARD).alias("side"), F.lit(-1).alias("at"), F.col("before").alias("node")),
                    F.struct(F.lit(BACKWARD).alias("side"), F.lit(1).alias("at"), F.col("after").alias("node")))
    here = found.select(*PAIR, F.inline(sides)).filter("node IS NOT NULL")
    steps = Appended(here)
    while not (here := steps.add(here)).isEmpty():
        here = here.join(came, [*PAIR, "side", "node"]).select(
            *PAIR, "side", (F.col("at") + F.signum("at").cast("int")).alias("at"), F.col("pred").alias("node"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda s: s["node"])
    places = steps.read().select(*PAIR, "at", "node").unionByName(found.select(*PAIR, F.lit(0).alias("at"), "node"))
    return found.select(*PAIR, "cost", "hops").join(places.groupBy(*PAIR).agg(path.alias("path")), PAIR)
