"""Explainable risk rules over the case graph, and the scores they add up to.

Modes: ``reference`` reproduces the published behaviour of the time-window rules, in which the
window start never restricts; ``windowed`` applies the window on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom import vocab as V
from linkloom.functions import labels
from linkloom.operators.clusters import median_sizes
from linkloom.operators.graph import both_ways
from linkloom.operators.numbering import id_buckets, number_within
from linkloom.operators.reach import reachable
from linkloom.runtime import cut, micros

KEY = ["case_id", "entity_id"]
RULE_ORDER = list(V.REASON_WEIGHTS)


def _window_counts(stamps: DataFrame, group: list[str], width_us: int) -> DataFrame:
    """For each distinct time of a group, how many stamps lie in [time, time + width].

    Stamps are first counted per distinct time. Time is then cut into slices of one window
    width; a slice also sees the next slice, so one busy group is spread over many tasks.
    """
    counted = stamps.groupBy(*group, "us").agg(F.count(F.lit(1)).alias("n"))
    slice_no = F.floor(F.col("us") / width_us)
    spread = counted.select(*group, "us", "n", F.inline(F.array(
        F.struct(slice_no.alias("slice"), F.lit(True).alias("own")),
        F.struct((slice_no - 1).alias("slice"), F.lit(False).alias("own")))))
    ahead = Window.partitionBy(*group, "slice").orderBy("us").rangeBetween(0, width_us)
    return spread.withColumn("in_window", F.sum("n").over(ahead)).filter("own").select(
        *group, "us", "in_window")


def velocity(nodes: DataFrame, edges: DataFrame, mode: str = "reference",
             window_minutes: int = V.VELOCITY_WINDOW_MINUTES) -> DataFrame:
    """Entities with at least three hops to neighbours first seen within the window."""
    near = both_ways(edges.select("case_id", "src", "dst"))
    if mode == "reference":
        # Every neighbour counts, also one whose evidence carries no time, as often as it is a node. Those that are
        # none, or several, are found from the distinct ends and written; they are few or none, so that
        # the hops are counted without a join of every edge with its end.
        times = nodes.groupBy("case_id", F.col("entity_id").alias("peer")).agg(F.count(F.lit(1)).alias("n"))
        peers = near.select("case_id", "peer").distinct().filter("case_id IS NOT NULL AND peer IS NOT NULL")
        odd = cut(peers.join(times, ["case_id", "peer"], "left").select(
            "case_id", "peer", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1"))
        counted = near.filter("case_id IS NOT NULL AND peer IS NOT NULL").join(odd, ["case_id", "peer"], "left")
        hops = counted.groupBy("case_id", F.col("node").alias("entity_id")).agg(
            F.coalesce(F.sum(F.coalesce("n", F.lit(1))), F.lit(0)).cast("long").alias("n_hops"))
    else:
        peers = nodes.filter("first_seen_at IS NOT NULL").select(
            "case_id", F.col("entity_id").alias("peer"), micros(F.col("first_seen_at")).alias("us"))
        seen = near.join(peers, ["case_id", "peer"])
        stamps = seen.select("case_id", F.col("node").alias("entity_id"), "us").unionByName(
            peers.withColumnRenamed("peer", "entity_id"))
        hops = _window_counts(stamps, KEY, window_minutes * 60_000_000).groupBy(*KEY).agg(
            (F.max("in_window") - 1).alias("n_hops"))
    return hops.filter(F.col("n_hops") >= V.VELOCITY_MIN_HOPS)


def _device_phones(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Each shared-device link between a device and a phone, with the value of the device, the time of the phone
    and the end at which the phone is stored (0: first)."""
    shared = links.filter(F.col("link_type") == "shared_imei")
    ends = F.array(
        F.struct(F.col("entity_a_id").alias("phone"), F.col("entity_b_id").alias("device"), F.lit(0).alias("side")),
        F.struct(F.col("entity_b_id").alias("phone"), F.col("entity_a_id").alias("device"), F.lit(1).alias("side")))
    both = shared.select("case_id", "link_id", F.inline(ends))
    devices = nodes.filter(F.col("entity_type") == V.IMEI).select(
        "case_id", F.col("entity_id").alias("device"), F.col("value").alias("imei"))
    phones = nodes.filter(F.col("entity_type") == V.PHONE).select(
        "case_id", F.col("entity_id").alias("phone"), micros(F.col("first_seen_at")).alias("us"))
    return both.join(devices, ["case_id", "device"]).join(phones, ["case_id", "phone"])


def sim_switch_devices(nodes: DataFrame, links: DataFrame, mode: str = "reference",
                       window_hours: int = V.SIM_WINDOW_HOURS) -> DataFrame:
    """Devices tied to three or more phones first seen within the window, with the count."""
    return _switching(_device_phones(nodes, links), mode, window_hours)


def _switching(tied: DataFrame, mode: str, window_hours: int) -> DataFrame:
    width = window_hours * 3_600_000_000
    phones = tied.select("case_id", F.col("device").alias("entity_id"), F.col("phone").alias("peer"), "us").distinct()
    if mode == "windowed":
        hits = _window_counts(phones, KEY, width).filter(
            F.col("in_window") >= V.SIM_MIN_PHONES)
        return hits.groupBy(*KEY).agg(F.min_by("in_window", "us").alias("n_phones"))
    phones = cut(phones)  # read twice
    # The count that decides takes every phone up to window end, so only the three earliest
    # times matter for where the scan stops; a top-k window keeps just those per device.
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("us"))
    first = phones.filter("us IS NOT NULL").withColumn("k", rank).filter(F.col("k") <= V.SIM_MIN_PHONES).groupBy(*KEY).agg(
        F.sort_array(F.collect_list("us")).alias("t")).filter(F.size("t") == V.SIM_MIN_PHONES)
    third = F.element_at("t", V.SIM_MIN_PHONES)
    stop = F.element_at(F.filter("t", lambda x: x >= third - width), 1)
    first = first.select(*KEY, (stop + width).alias("until"))
    return phones.join(first, KEY).groupBy(*KEY).agg(
        F.count_if(F.col("us") <= F.col("until")).alias("n_phones"))


def sim_switch(nodes: DataFrame, links: DataFrame, mode: str = "reference",
               window_hours: int = V.SIM_WINDOW_HOURS) -> DataFrame:
    """Switching devices and the phones that inherit the flag from their first such device."""
    tied = cut(_device_phones(nodes, links))
    devices = cut(_switching(tied, mode, window_hours).join(
        nodes.select(*KEY, "value"), KEY))
    firing = devices.select("case_id", F.col("entity_id").alias("device"))
    inherited = tied.join(firing, ["case_id", "device"], "left_semi").groupBy(
        "case_id", F.col("phone").alias("entity_id")).agg(
        F.min_by("imei", F.struct("side", "link_id")).alias("imei"))
    return devices.select(*KEY, F.col("value").alias("imei"), "n_phones").unionByName(
        inherited.select(*KEY, "imei", F.lit(V.SIM_MIN_PHONES).cast("long").alias("n_phones")))


def _device_peers(links: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("entity_a_id").alias("entity_id"), F.col("entity_b_id").alias("peer"),
                 F.lit(0).alias("side")),
        F.struct(F.col("entity_b_id").alias("entity_id"), F.col("entity_a_id").alias("peer"),
                 F.lit(1).alias("side")))
    return links.filter(F.col("link_type").isin("shared_imei", "shared_mac")).select(
        "case_id", "link_id", F.inline(ends))


def max_history(risk_scores: DataFrame) -> DataFrame:
    return risk_scores.groupBy(*KEY).agg(F.max("score").alias("history"))


def flagged_peer(links: DataFrame, history: DataFrame, base: DataFrame | None = None
                 ) -> DataFrame:
    """Entities sharing a device with a flagged one, with the first such peer and its score.

    Without ``base`` only stored scores count (snapshot, order-free). With ``base`` (score of
    the other rules per entity) entities are taken to be scored in id order, so scores of this
    pass reach peers with larger ids; chains of entities that hand the flag on take logarithmically
    many rounds.
    """
    peers = _device_peers(links)
    hist = history.select("case_id", F.col("entity_id").alias("peer"), "history")
    if base is None:
        known = peers.join(hist, ["case_id", "peer"]).withColumn("peer_score", F.col("history"))
        return _first_flagged(known)

    peers = cut(peers)
    scores = cut(base.select(*KEY, F.col("score").alias("base")))
    upward = peers.filter("peer < entity_id").select("case_id", "peer", "entity_id").distinct()
    by_history = peers.join(hist.filter(F.col("history") >= V.FLAGGED_MIN_SCORE),
                            ["case_id", "peer"], "left_semi").select(*KEY).distinct()
    # A scored entity passes the flag on if it scores enough by itself, or if it is flagged and
    # at least one other rule fired (every rule weight lifts the flag weight past the limit).
    strong = cut(scores.filter(F.col("base") >= V.FLAGGED_MIN_SCORE).select(*KEY))
    relays = cut(scores.filter((F.col("base") > 0) & (F.col("base") < V.FLAGGED_MIN_SCORE)).select(*KEY))
    upward = cut(upward)

    def above(givers: DataFrame) -> DataFrame:
        return upward.join(givers.withColumnRenamed("entity_id", "peer"), ["case_id", "peer"], "left_semi")

    first = above(strong).select(*KEY).unionByName(by_history).join(relays, KEY, "left_semi")
    between = above(relays).join(relays, KEY, "left_semi").select(
        "case_id", F.col("peer").alias("src"), F.col("entity_id").alias("dst"))
    givers = strong.unionByName(reachable(between, first))
    flagged = cut(by_history.unionByName(above(givers).select(*KEY)).distinct())
    lift = V.REASON_WEIGHTS[V.FLAGGED_PEER]
    this_pass = scores.join(flagged.withColumn("f", F.lit(1)), KEY, "left").select(
        "case_id", F.col("entity_id").alias("peer"),
        F.least(F.lit(V.MAX_SCORE), F.col("base") + lift * F.coalesce("f", F.lit(0))).alias("now"))
    known = peers.join(this_pass, ["case_id", "peer"], "left").join(
        hist, ["case_id", "peer"], "left").withColumn(
        "peer_score", F.greatest("history", F.when(F.col("peer") < F.col("entity_id"), F.col("now"))))
    return _first_flagged(known)


def _first_flagged(known: DataFrame) -> DataFrame:
    return known.filter(F.col("peer_score") >= V.FLAGGED_MIN_SCORE).groupBy(*KEY).agg(
        F.min_by(F.struct("peer", "peer_score"), F.struct("side", "link_id")).alias("p")).select(
        *KEY, F.col("p.peer").alias("peer_id"), "p.peer_score")


def oversized_cluster(clusters: DataFrame) -> DataFrame:
    """Members of clusters at least 1.5 times the median cluster size of their case."""
    medians = median_sizes(clusters).select("case_id", "median_size")
    ratio = F.col("cluster_size") / F.col("median_size")
    return clusters.join(medians, "case_id").withColumn("ratio", ratio).filter(
        F.col("ratio") >= V.OVERSIZED_MIN_RATIO).select(
        *KEY, "cluster_size", "median_size", "ratio")


def transaction_hub(links: DataFrame) -> DataFrame:
    """Entities with three or more distinct transaction counterparties, direction ignored."""
    near = both_ways(links.filter("link_type = 'transaction'").select(
        "case_id", F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst")))
    return near.groupBy("case_id", F.col("node").alias("entity_id")).agg(
        F.count_distinct("peer").alias("n_senders")).filter(
        F.col("n_senders") >= V.HUB_MIN_PARTIES)


def directed_hub(link_candidates: DataFrame) -> DataFrame:
    """Receivers with three or more distinct senders, from undeduplicated sender->receiver refs."""
    sent = link_candidates.filter("link_type = 'transaction'").filter(
        F.struct("a_type", "a_value") != F.struct(
            F.col("b_type").alias("a_type"), F.col("b_value").alias("a_value")))
    return sent.groupBy("case_id", F.col("b_type").alias("entity_type"),
                        F.col("b_value").alias("value")).agg(
        F.count_distinct("a_type", "a_value").alias("n_senders")).filter(
        F.col("n_senders") >= V.HUB_MIN_PARTIES)


def _fired(df: DataFrame, code: str, *args: Column) -> DataFrame:
    return df.select(*KEY, F.lit(RULE_ORDER.index(code)).alias("rule_no"), F.lit(code).alias("code"),
                     F.format_string(V.REASON_TEXTS[code], *args).alias("message"))


def fired_rules(nodes: DataFrame, edges: DataFrame, links: DataFrame, clusters: DataFrame,
                mode: str = "reference", window_minutes: int = V.VELOCITY_WINDOW_MINUTES,
                window_hours: int = V.SIM_WINDOW_HOURS) -> DataFrame:
    """All rules but the flagged-peer rule, one row per fired rule."""
    return (
        _fired(velocity(nodes, edges, mode, window_minutes), V.VELOCITY,
               F.col("n_hops"), F.lit(window_minutes))
        .unionByName(_fired(sim_switch(nodes, links, mode, window_hours), V.SIM_SWITCH,
                            F.col("imei"), F.col("n_phones"), F.lit(window_hours)))
        .unionByName(_fired(oversized_cluster(clusters), V.OVERSIZED,
                            F.col("cluster_size"), F.bround("median_size", 1), F.bround("ratio", 1)))
        .unionByName(_fired(transaction_hub(links), V.HUB, F.col("n_senders"))))


def total(nodes: DataFrame, fired: DataFrame) -> DataFrame:
    """Capped weight sum, reasons in rule order and advice for every node."""
    summed = fired.groupBy(*KEY).agg(
        F.sum(labels.reason_weight(F.col("code"))).alias("raw"),
        F.sort_array(F.collect_list(F.struct("rule_no", "code", "message"))).alias("rules"))
    score = F.least(F.coalesce("raw", F.lit(0)), F.lit(V.MAX_SCORE)).cast("int")
    none = F.array().cast("array<string>")
    return nodes.select(*KEY, "entity_type", "value").join(summed, KEY, "left").select(
        *KEY, "entity_type", "value", score.alias("score"),
        F.coalesce(F.transform("rules", lambda r: r["code"]), none).alias("reason_codes"),
        F.coalesce(F.transform("rules", lambda r: r["message"]), none).alias("reason_messages"),
        labels.advice(score).alias("recommendation"))


def assess(nodes: DataFrame, edges: DataFrame, links: DataFrame, clusters: DataFrame,
           history: DataFrame | None = None, peers: str = "snapshot", **windows) -> DataFrame:
    """Score every node of every case in one pass.

    ``history`` is ``max_history`` of stored scores. ``peers='sequential'`` lets scores of this
    pass flag peers with larger ids, ``'snapshot'`` uses stored scores only.
    """
    fired = cut(fired_rules(nodes, edges, links, clusters, **windows))
    if history is None and peers == "snapshot":
        return total(nodes, fired)
    if history is None:
        history = nodes.select(*KEY, F.lit(0).alias("history")).filter(F.lit(False))
    base = total(nodes, fired).select(*KEY, "score") if peers == "sequential" else None
    flagged = flagged_peer(links, history, base)
    return total(nodes, fired.unionByName(_fired(
        flagged, V.FLAGGED_PEER, F.col("peer_id"), F.col("peer_score"))))


def scores_for(requested: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of requested ids; an id outside the graph gets 0 and the low-risk note."""
    got = requested.select(*KEY).join(scores, KEY, "left")
    none = F.array().cast("array<string>")
    return got.select(
        *KEY, F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("reason_codes", none).alias("reason_codes"),
        F.coalesce("recommendation", F.lit(V.LOW_RISK_ADVICE)).alias("recommendation"))


def history_rows(scores: DataFrame, run_id: str, computed_at: Column) -> DataFrame:
    """Rows to append to the score history; earlier rows are never updated."""
    return scores.select(*KEY, "score", "reason_codes", computed_at.alias("computed_at"),
                         F.lit(run_id).alias("run_id"))


def ranked(scores: DataFrame) -> DataFrame:
    """Rank inside the case by score, then id."""
    return number_within(scores, ["case_id"], [-F.col("score"), *id_buckets(F.col("entity_id"))],
                         [F.col("entity_id")], "rank")


def risk_list(scores: DataFrame, entity_type: str | None = None, by: str = "score") -> DataFrame:
    """Risk list of a screen: optional type filter, ordered by score or by type. The rows are written first, as
    the sort reads them once for its ranges and once more to deal them out."""
    rows = cut(scores if entity_type is None else scores.filter(F.col("entity_type") == entity_type))
    order = [F.desc("score")] if by == "score" else [F.asc("entity_type")]
    return rows.orderBy("case_id", *order, "entity_id")


def listed_types(scores: DataFrame) -> DataFrame:
    return scores.select("case_id", "entity_type").distinct()
