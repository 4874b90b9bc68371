"""Graph, paths, rules and ledger on small scenes, and numbering against brute force."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import brief, checks, clusters, custody, graph, numbering, paths, reach, records, risk

T0 = "2024-03-15 10:00:00"


def scene(spark, entities, links, case_id=1):
    """Nodes (id, type, minute) and links (a, b, type) of one case."""
    nodes = spark.createDataFrame(
        [(case_id, i, t, f"v{i}", m) for i, t, m in entities],
        "case_id long, entity_id long, entity_type string, value string, m int").withColumn(
        "first_seen_at", F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("m"))).drop("m")
    rows = spark.createDataFrame(
        [(case_id, n + 1, min(a, b), max(a, b), t) for n, (a, b, t) in enumerate(links)],
        "case_id long, link_id long, entity_a_id long, entity_b_id long, link_type string").withColumn(
        "confidence_score", F.lit(0.9))
    return nodes, rows, graph.consolidate(rows, nodes)


def test_numbering(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abbbb"), rng.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = numbering.number_within(df, ["g"], [F.floor(F.col("k") / 50000), F.floor(F.col("k") / 500)],
                                  [F.col("k"), F.col("i")], "no").collect()
    want = {}
    for g in "ab":
        for no, r in enumerate(sorted((k, i) for gg, k, i in rows if gg == g), 1):
            want[r[1]] = no
    assert {r.i: r.no for r in got} == want


def test_correlation_scene(spark):
    nodes, links, edges = scene(
        spark, [(1, "phone", 0), (2, "account", 0), (3, "account", 0), (4, "account", 0),
                (5, "phone", 0), (6, "device_imei", 0), (7, "ip_address", 0)],
        [(1, 2, "transaction"), (2, 3, "transaction"), (2, 4, "transaction"), (3, 4, "transaction"),
         (5, 6, "shared_imei"), (1, 5, "shared_ip_subnet"), (5, 7, "shared_ip_subnet")])
    assert edges.count() == 7
    assert clusters.clusters_of(nodes, edges).select("cluster_id").distinct().count() == 1
    asked = spark.createDataFrame([(1, 1, 4), (1, 3, 3), (1, 1, 99)], "case_id long, source long, target long")
    got = {(r.source, r.target): r.path for r in paths.strongest_paths(edges, nodes, asked).collect()}
    assert got == {(1, 4): [1, 2, 4], (3, 3): [3], (1, 99): None}
    near = graph.neighbourhood(edges, nodes, spark.createDataFrame([(1, 7)], "case_id long, node long"))
    assert [(r.peer, r.confidence_label) for r in near.collect()] == [(5, "Weak")]


def test_strong_detour_beats_weak_shortcut(spark):
    nodes, links, edges = scene(spark, [(i, "phone", 0) for i in (1, 2, 3)], [
        (1, 3, "shared_ip_subnet"), (1, 2, "shared_imei"), (2, 3, "shared_imei")])
    asked = spark.createDataFrame([(1, 1, 3)], "case_id long, source long, target long")
    assert paths.strongest_paths(edges, nodes, asked).first().path == [1, 2, 3]


def test_strongest_paths_against_dijkstra(spark):
    """Random graphs in two cases, all pairs of some nodes: cost, a real path of that cost, and no path."""
    rng = random.Random(4)
    rows, weight = [], {}
    for case in (1, 2):
        for _ in range(90):
            a, b = sorted(rng.sample(range(1, 50), 2))
            weight[case, a, b] = weight[case, b, a] = w = rng.choice([1.25, 1.25, 1.5, 2.0, 7.0, 30.0])
            rows.append((case, a, b, w))
    edges = spark.createDataFrame(rows, "case_id long, src long, dst long, inverse_confidence double").groupBy(
        "case_id", "src", "dst").agg(F.last("inverse_confidence").alias("inverse_confidence"))
    weight = {}
    for r in edges.collect():
        weight[r.case_id, r.src, r.dst] = weight[r.case_id, r.dst, r.src] = r.inverse_confidence
    nodes = spark.createDataFrame([(c, i) for c in (1, 2) for i in range(1, 60)], "case_id long, entity_id long")
    ends = [(c, s, t) for c in (1, 2) for s in (1, 2, 3, 55) for t in range(1, 60, 3)]
    got = {(r.case_id, r.source, r.target): r for r in paths.strongest_paths(edges, nodes, spark.createDataFrame(
        ends, "case_id long, source long, target long")).collect()}
    assert set(got) == set(ends)
    for case, s, t in ends:
        cost, todo = {s: 0.0}, [s]
        while todo:
            x = todo.pop()
            for (c, a, b), w in weight.items():
                if c == case and a == x and cost[x] + w < cost.get(b, 1e9) - 1e-9:
                    cost[b] = cost[x] + w
                    todo.append(b)
        r = got[case, s, t]
        if t not in cost:
            assert r.path is None and r.cost is None
            continue
        assert abs(r.cost - cost[t]) < 1e-9 and (r.path[0], r.path[-1], len(r.path)) == (s, t, r.hops + 1)
        assert abs(sum(weight[case, a, b] for a, b in zip(r.path, r.path[1:])) - cost[t]) < 1e-9


def test_components_match_union_find(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(1, 400), rng.randrange(1, 400)) for _ in range(260)]
    chain = [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)]
    pairs = [p for p in pairs + chain if p[0] != p[1]]
    ids = sorted({x for p in pairs for x in p} | set(range(1, 400)))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    sizes = {}
    for i in ids:
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    rank = {r: n for n, r in enumerate(sorted(sizes, key=lambda r: (-sizes[r], r)))}
    nodes, links, edges = scene(spark, [(i, "account", 0) for i in ids],
                                [(a, b, "transaction") for a, b in pairs])
    got = {r.entity_id: (r.cluster_id, r.cluster_size) for r in clusters.clusters_of(nodes, edges).collect()}
    assert got == {i: (rank[find(i)], sizes[find(i)]) for i in ids}


def test_rules(spark):
    # Entity 1 has four neighbours far apart in time; device 10 has three phones within an hour.
    nodes, links, edges = scene(
        spark, [(1, "account", 0)] + [(i, "account", 100 * i) for i in range(2, 6)]
        + [(10, "device_imei", 0), (11, "phone", 1), (12, "phone", 2), (13, "phone", 3), (14, "phone", 3000)],
        [(1, i, "transaction") for i in range(2, 6)] + [(10, i, "shared_imei") for i in range(11, 15)])
    assert {r.entity_id: r.n_hops for r in risk.velocity(nodes, edges).collect()} == {1: 4, 10: 4}
    assert {r.entity_id: r.n_hops for r in risk.velocity(nodes, edges, "windowed").collect()} == {10: 3}
    ref = {r.entity_id: (r.imei, r.n_phones) for r in risk.sim_switch(nodes, links).collect()}
    assert ref == {10: ("v10", 3), **{i: ("v10", 3) for i in range(11, 15)}}
    assert {r.entity_id: r.n_senders for r in risk.transaction_hub(links).collect()} == {1: 4}
    found = clusters.clusters_of(nodes, edges)
    assert risk.oversized_cluster(found).count() == 0
    scores = {r.entity_id: r for r in risk.assess(nodes, edges, links, found).collect()}
    assert scores[1].score == 75 and scores[10].score == 85 and scores[2].score == 0
    assert scores[2].recommendation.startswith("No significant") and scores[1].recommendation.startswith("Recomm")
    got = risk.scores_for(spark.createDataFrame([(1, 1), (1, 77)], "case_id long, entity_id long"),
                          risk.assess(nodes, edges, links, found))
    assert {r.entity_id: r.score for r in got.collect()} == {1: 75, 77: 0}


@pytest.mark.parametrize("score,hit", [(50, True), (30, False)])
def test_flagged_peer(spark, score, hit):
    nodes, links, _ = scene(spark, [(1, "phone", 0), (2, "device_imei", 0)], [(1, 2, "shared_imei")])
    history = spark.createDataFrame([(1, 1, score), (1, 1, 10)], "case_id long, entity_id long, score int")
    got = risk.flagged_peer(links, risk.max_history(history)).collect()
    assert [(r.entity_id, r.peer_id, r.peer_score) for r in got] == ([(2, 1, 50)] if hit else [])


def test_sequential_flags_against_loop(spark):
    rng = random.Random(3)
    ids = list(range(1, 60))
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(70)})
    base = {i: rng.choice([0, 0, 20, 30, 45]) for i in ids}
    hist = {i: 60 for i in rng.sample(ids, 3)}
    nodes, links, _ = scene(spark, [(i, "phone", 0) for i in ids], [(a, b, "shared_mac") for a, b in pairs])
    stored, want = dict(hist), {}
    for e in ids:  # one scoring pass in id order
        order = [b for a, b in pairs if a == e] + [a for a, b in pairs if b == e]
        peer = next((p for p in order if stored.get(p, 0) >= 40), None)
        now = min(100, base[e] + (35 if peer else 0))
        if peer:
            want[e] = (peer, stored[peer])
        stored[e] = max(stored.get(e, 0), now)
    scores = spark.createDataFrame([(1, i, s) for i, s in base.items()], "case_id long, entity_id long, score int")
    history = spark.createDataFrame([(1, i, s) for i, s in hist.items()], "case_id long, entity_id long, history int")
    got = {r.entity_id: (r.peer_id, r.peer_score) for r in risk.flagged_peer(links, history, scores).collect()}
    assert got == want


def test_reachable_against_search(spark):
    rng = random.Random(8)
    edges = {(c, *sorted(rng.sample(range(400), 2))) for c in (1, 2) for _ in range(380)}
    edges |= {(1, 1000 + i, 1001 + i) for i in range(200)} | {(1, 5, 1000), (2, 1000, 1001)}
    seeds = {(1, 3), (1, 5), (1, 1150), (2, 7), (2, 9), (3, 1)}
    want, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for c, a, b in edges:
            if (c, a) == x and (c, b) not in want:
                want.add((c, b))
                todo.append((c, b))
    frame = spark.createDataFrame(sorted(edges), "case_id long, src long, dst long")
    got = reach.reachable(frame, spark.createDataFrame(sorted(seeds), "case_id long, entity_id long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert reach.reachable(frame, spark.createDataFrame([], "case_id long, entity_id long")).count() == 0


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """5,000 entities of which each shares a device with the next: the flag reaches the last one."""
    n, rounds = 5000, []
    plain = reach.cut
    monkeypatch.setattr(reach, "cut", lambda df: rounds.append(1) or plain(df))
    links = spark.range(1, n).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("link_id"), F.col("id").alias("entity_a_id"),
                                     (F.col("id") + 1).alias("entity_b_id"), F.lit("shared_mac").alias("link_type"))
    base = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("entity_id"),
                                        F.when(F.col("id") == 1, 45).otherwise(20).alias("score"))
    none = base.select("case_id", "entity_id", F.col("score").alias("history")).filter("false")
    got = risk.flagged_peer(links, none, base)
    assert got.count() == n - 1 and got.agg(F.min("peer_score"), F.max("peer_score")).first() == (45, 55)
    assert len(rounds) <= 20


def ledger(spark, n=5):
    files = spark.createDataFrame([(1, i, f"{i:064d}") for i in range(1, n + 1)],
                                  "case_id long, evidence_file_id long, file_hash string")
    entries = custody.extend_chain(files.withColumn("entry_id", F.col("evidence_file_id") * 70_000)).drop("case_id")
    return files, entries


def report(spark, files, entries):
    return custody.verify(spark.createDataFrame([(1,)], "case_id long"), files, entries).first()


def test_ledger_checks(spark):
    files, entries = ledger(spark)
    assert report(spark, files, entries).is_valid
    third = F.col("entry_id") == 210_000
    bad = report(spark, files, entries.withColumn("file_hash", F.when(third, "x").otherwise(F.col("file_hash"))))
    assert (bad.broken_index, bad.broken_entry_id) == (2, 210_000) and bad.reason.startswith("hash mismatch")
    gone = report(spark, files, entries.filter(~third))
    assert gone.broken_index == 2 and gone.reason.startswith("missing entry or broken link")
    first = report(spark, files, entries.filter("entry_id > 70000"))
    assert first.broken_index == 0 and first.reason.startswith("Genesis entry")
    last = report(spark, files, entries.filter("entry_id < 350000"))
    assert not last.is_valid and last.broken_index is None and last.unlogged_files == 1
    empty = report(spark, files, entries.filter("false"))
    assert not empty.is_valid and empty.reason.endswith("custody log is empty")
    none = report(spark, files.filter("false"), entries.filter("false"))
    assert none.is_valid and none.total_entries == 0


def test_violations(spark):
    nodes, links, _ = scene(spark, [(1, "phone", 0), (2, "phone", 0)], [(1, 2, "transaction"), (1, 9, "transaction")])
    got = checks.violations(nodes, links.withColumn("confidence_score", F.lit(1.5))).collect()
    assert {(r.violation, r.n) for r in got} == {("link_endpoint_b_missing", 1), ("confidence_out_of_range", 2)}


def test_all_seven_violations(spark):
    """Ids are held per case, null references are missing, stored null ids hold nothing, null values are in range."""
    entities = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, None)], "case_id long, entity_id long")
    links = spark.createDataFrame([(1, 1, 2, 0.5, 10), (1, None, 2, 1.0, 10), (2, 1, 2, -0.1, 11), (1, 2, 1, None, None), (1, 3, 3, 1.1, 12)],
                                  "case_id long, entity_a_id long, entity_b_id long, confidence_score double, source_evidence_file_id long")
    scores = spark.createDataFrame([(1, 1, 100), (1, 7, 101), (2, 2, -1), (2, 1, None)], "case_id long, entity_id long, score int")
    files = spark.createDataFrame([(1, 10), (2, 11), (3, 13)], "case_id long, evidence_file_id long")
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    got = {(r.case_id, r.violation): r.n for r in checks.violations(entities, links, scores, files, cases).collect()}
    assert got == {(1, "link_endpoint_a_missing"): 2, (1, "link_endpoint_b_missing"): 1, (2, "link_endpoint_b_missing"): 1,
                   (1, "confidence_out_of_range"): 1, (2, "confidence_out_of_range"): 1, (1, "link_file_missing"): 2,
                   (1, "score_entity_missing"): 1, (2, "score_entity_missing"): 1, (1, "score_out_of_range"): 1,
                   (2, "score_out_of_range"): 1, (3, "file_case_missing"): 1}
    assert checks.violations(entities.limit(0), links.limit(0), scores.limit(0), files.limit(0), cases.limit(0)).count() == 0


def test_sinks_write_json_rows(spark, tmp_path):
    nodes, links, edges = scene(spark, [(1, "phone", 0), (2, "phone", 0)], [(1, 2, "transaction")])
    found = clusters.clusters_of(nodes, edges)
    graph.write_graph(graph.serialized_nodes(nodes, found), graph.serialized_edges(edges), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "edges")).first().confidence_label == "Medium"
    assert [r.id for r in spark.read.json(str(tmp_path / "g" / "nodes")).orderBy("id").collect()] == [1, 2]
    scores = risk.assess(nodes, edges, links, found)
    cases = spark.createDataFrame([(1, "Case A")], "case_id long, name string")
    files, entries = ledger(spark)
    metrics = brief.case_metrics(cases, files, nodes, links, found)
    sections = brief.brief_sections(
        metrics, custody.verify(cases, files, entries), brief.top_entities(scores, mask_pii=False),
        brief.cluster_summary(nodes, found, scores), F.current_timestamp())
    brief.write_brief(sections, str(tmp_path / "b"))
    rows = spark.read.json(str(tmp_path / "b")).collect()
    assert sorted(r.section for r in rows) == ["case_summary", "clusters", "custody_chain",
                                               "top_entities", "top_entities"]
    head = json.loads(next(r.body for r in rows if r.section == "case_summary"))
    assert (head["name"], head["total_entities"], head["total_clusters"]) == ("Case A", 2, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_hashed_by_numbers(spark):
    # Known types in both orders, a type outside the rule table, none at all, a case without id.
    links = spark.createDataFrame([
        (1, 4, 1, 2, "shared_imei"), (1, 2, 2, 1, "direct_communication"), (1, 3, 1, 2, "shared_imei"),
        (1, 5, 1, 3, "co_occurrence"), (1, 6, 1, 3, "shared_ip_subnet"), (1, 7, 1, 3, "co_occurrence"),
        (1, 8, 2, 3, "unheard"), (1, 9, 2, 3, "shared_mac"), (1, 10, 3, 4, None), (1, 11, 4, 4, "shared_imei"),
        (None, 1, 5, 6, "unheard"), (None, 2, 5, 6, "shared_imei"), (2, None, 1, 2, "shared_mac")],
        "case_id long, link_id long, entity_a_id long, entity_b_id long, link_type string").withColumn(
        "confidence_score", F.lit(0.9))
    edges = graph.consolidate(links)
    got = {(r.case_id, r.src, r.dst): (r.confidence, r.link_type, r.link_types, r.link_count) for r in edges.collect()}
    assert got == {
        (1, 1, 2): (0.85, "shared_imei", ["direct_communication", "shared_imei"], 3),
        (1, 1, 3): (0.748, "co_occurrence", ["co_occurrence", "shared_ip_subnet"], 3),
        (1, 2, 3): (0.6, "shared_mac", ["shared_mac", "unheard"], 2), (1, 3, 4): (0.5, None, [], 1),
        (None, 5, 6): (0.85, "shared_imei", ["shared_imei", "unheard"], 2), (2, 1, 2): (0.6, "shared_mac", ["shared_mac"], 1)}
    listed = links.filter("link_type IN ('shared_imei', 'co_occurrence')")
    assert "min(CASE WHEN" in _plan(graph.consolidate(listed))
    assert "min(CASE WHEN" not in _plan(graph.consolidate(listed, enforce_rules=False))


def test_call_rows_name_each_once(spark):
    rows = spark.createDataFrame([
        (1, 1, 1, "p1", "p2", "i1", "a1"), (1, 1, 2, "p1", "p1", "i1", None), (1, 1, 3, None, "p2", None, "a1"),
        (1, 1, 4, None, None, None, None)],
        "case_id long, evidence_file_id long, rec_no long, caller string, callee string, imei string, ip string"
    ).withColumn("event_ts", F.lit(T0).cast("timestamp_ntz"))
    mentions, links = records.call_evidence(rows)
    named = {}
    for r in sorted(mentions.collect(), key=lambda r: (r.rec_no, r.pos)):
        named.setdefault(r.rec_no, []).append((r.pos, r.value))
    assert named == {1: [(0, "p1"), (1, "i1"), (2, "p2"), (3, "a1")], 2: [(0, "p1"), (1, "i1")],
                     3: [(0, "p2"), (1, "a1")]}
    got = sorted((r.rec_no, r.pos, r.a_value, r.b_value, r.link_type, r.confidence) for r in links.collect())
    assert got == [(1, 0, "p1", "i1", "shared_imei", 0.95), (1, 1, "p1", "p2", "direct_communication", 0.9),
                   (1, 2, "p1", "a1", "shared_ip_subnet", 0.85), (2, 0, "p1", "i1", "shared_imei", 0.95),
                   (2, 1, "p1", "p1", "direct_communication", 0.9)]
    for df in (mentions, links):
        assert "array_distinct" not in _plan(df) and "lambda" not in _plan(df)


def test_sim_switch_joins_ends_once(spark):
    nodes, links, _ = scene(
        spark, [(1, "phone", 1), (2, "device_imei", 0), (3, "phone", 2), (4, "phone", 3), (5, "device_imei", 0),
                (6, "ip_address", 0)],
        [(2, 1, "shared_imei"), (2, 3, "shared_imei"), (2, 4, "shared_imei"), (5, 1, "shared_imei"),
         (5, 3, "shared_imei"), (5, 4, "shared_imei"), (2, 5, "shared_imei"), (2, 6, "shared_imei")])
    for mode in ("reference", "windowed"):
        got = {r.entity_id: (r.imei, r.n_phones) for r in risk.sim_switch(nodes, links, mode).collect()}
        assert got == {2: ("v2", 3), 5: ("v5", 3), 1: ("v2", 3), 3: ("v5", 3), 4: ("v5", 3)}
    # The links are joined with the nodes in one place; what follows reads the written rows.
    assert "shared_imei" not in _plan(risk.sim_switch(nodes, links))
