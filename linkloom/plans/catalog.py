"""Registered queries: every job of the library over the sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import vocab as V
from linkloom.functions import hashing, labels, mask
from linkloom.functions import normalize as N
from linkloom.operators import brief as BR
from linkloom.operators import cases as CS
from linkloom.operators import checks, clusters, custody, graph, paths, records, resolve, risk
from linkloom.plans import bindings as B
from linkloom.runtime import cut, micros, scratch_root
from linkloom.sources import artifacts, device_log, mail, tabular
from linkloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- shared stages ----------------------------------------------------------

def call_tables(spark, sf, hourly=True, scope="case"):
    return resolve.resolve(records.call_evidence(cut(B.calls(spark, sf, hourly))), scope)


def ledger_tables(spark, sf):
    return resolve.resolve(records.ledger_evidence(cut(B.transfers(spark, sf))))


def _graph(tables):
    entities, links = tables
    nodes = graph.nodes_of(entities)
    return nodes, cut(graph.consolidate(links, nodes)), links


# --- scalar functions --------------------------------------------------------

@query
def normalize_phone(spark, sf):
    n = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    form = F.col("c_custkey") % 8
    raw = (F.when(form == 0, F.concat(F.lit("9"), n))
           .when(form == 1, F.concat(F.lit("+91 9"), F.left(n, F.lit(4)), F.lit("-"), F.right(n, F.lit(5))))
           .when(form == 2, F.concat(F.lit("0044 (20) "), n))
           .when(form == 3, F.concat(F.lit("919"), n))
           .when(form == 4, F.concat(F.lit("2."), n))
           .when(form == 5, F.right(n, F.lit(5)))
           .when(form == 6, F.concat(F.lit("  1"), n, F.lit(".0 ")))
           .otherwise(F.concat(F.lit("mule"), n)))
    rows = B.table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))
    return rows.select("c_custkey", "raw", N.phone(F.col("raw")).alias("phone"),
                       N.phone(F.col("raw"), strict=True).alias("strict_phone"),
                       N.phone_of_handle(F.concat("raw", F.lit("@bank"))).alias("handle_phone"))


@query
def normalize_imei(spark, sf):
    rows = B.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("86-"), F.lpad(F.col("event_id").cast("string"), 10, "0"),
                             F.repeat(F.lit("7"), (F.col("event_id") % 6).cast("int"))).alias("raw"))
    return rows.select("event_id", N.imei(F.col("raw")).alias("imei"))


@query
def normalize_account(spark, sf):
    rows = B.table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Cust-"), F.col("o_custkey").cast("string"),
                                               F.lit("@OkBank")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" acc "), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("a-"), (F.col("o_custkey") % 100).cast("string"))).alias("raw"))
    return rows.select("o_orderkey", N.account(F.col("raw")).alias("account"))


@query
def normalize_email(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", N.email(F.col("text")).alias("email"))


@query
def normalize_mac(spark, sf):
    h = F.lpad(F.hex("p_partkey"), 6, "0")
    raw = F.concat(F.lit("if0 00-1a:"), F.left(h, F.lit(2)), F.lit("-"), F.substring(h, 3, 2),
                   F.lit(":"), F.right(h, F.lit(2)), F.lit(":5e up"))
    return B.table(spark, sf, "part").select("p_partkey", N.mac(raw).alias("mac"))


@query
def normalize_ip(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    form = F.col("event_id") % 4
    raw = (F.when(form == 0, F.concat(F.lit("2001:0DB8:0:0:0000:0:0:"), F.lower(F.hex(k + 1))))
           .when(form == 1, F.concat(F.lit("10.1."), k.cast("string"), F.lit(".7")))
           .when(form == 2, F.concat(F.lit("from 10.2.0."), k.cast("string"), F.lit(":443")))
           .otherwise(F.concat(F.lit("300.1.1."), k.cast("string"))))
    return B.table(spark, sf, "events").select("event_id", N.ip(raw).alias("ip"))


@query
def parse_amount(spark, sf):
    price = F.format_number("l_extendedprice", 2)
    form = F.col("l_orderkey") % 4
    raw = (F.when(form == 0, F.concat(F.lit("INR "), price)).when(form == 1, F.concat(F.lit("₹"), price))
           .when(form == 2, F.concat(F.lit("$ "), price)).otherwise(F.concat(price, F.lit(" x"))))
    return B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", N.amount(raw).alias("amount"))


@query
def parse_event_time(spark, sf):
    form = F.col("event_id") % 5
    ts = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    raw = (F.when(form == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
           .when(form == 1, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
           .when(form == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
           .when(form == 3, F.floor(micros(ts) / 1_000_000).cast("string"))
           .otherwise(F.floor(micros(ts) / 1_000).cast("string")))
    rows = B.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", micros(N.event_time(F.col("raw"))).alias("event_us"))


@query
def mask_identifiers(spark, sf):
    key = F.col("c_custkey").cast("string")
    digits = F.lpad(key, 9, "0")
    kinds = F.array(*[F.struct(F.lit(t).alias("entity_type"), v.alias("value")) for t, v in (
        (V.PHONE, F.concat(F.lit("+919"), digits)), (V.PHONE, F.concat(F.lit("+1"), digits, F.lit("5"))),
        (V.ACCOUNT, F.concat(F.lit("CUST"), key)), (V.ACCOUNT, F.concat(key, F.lit("@okbank"))),
        (V.IMEI, F.concat(F.lit("86"), F.lpad(key, 13, "0"))),
        (V.EMAIL, F.concat(F.lit("u"), key, F.lit("@mail.example"))),
        (V.IP, F.concat(F.lit("10.0.0."), key)))])
    rows = B.table(spark, sf, "customer").select("c_custkey", F.inline(kinds))
    v, t = F.col("value"), F.col("entity_type")
    return rows.select("c_custkey", "entity_type", "value", mask.identifier(v, t).alias("masked"),
                       mask.identifier(v).alias("masked_by_look"), mask.console(v).alias("console"))


@query
def guess_source(spark, sf):
    return B.table(spark, sf, "pages").select(
        "page_id", labels.source_of_filename(F.col("url")).alias("source_type"))


@query
def label_bands(spark, sf):
    q = F.col("l_quantity").cast("int") * 2
    c = F.round(F.col("l_quantity") / 50, 2)
    return B.table(spark, sf, "lineitem").select("l_quantity").distinct().select(
        q.alias("score"), labels.score_tier(q).alias("tier"), labels.severity_band(q).alias("severity"),
        c.alias("confidence"), labels.confidence_label(c).alias("confidence_label"),
        labels.advice(q - 50).alias("advice"))


@query
def reason_labels(spark, sf):
    code = F.when(F.col("event_type") == "click", F.lit(V.VELOCITY)).when(
        F.col("event_type") == "view", F.lit(V.SIM_SWITCH)).otherwise(
        F.concat(F.upper("event_type"), F.lit("_SEEN")))
    return B.table(spark, sf, "events").groupBy(code.alias("code")).agg(
        F.count(F.lit(1)).alias("n")).select(
        "code", "n", labels.plain_reason(F.col("code")).alias("plain"),
        labels.reason_weight(F.col("code")).alias("weight"))


@query
def artifact_hashes(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", hashing.file_digest(
        F.col("text").cast("binary")).alias("file_hash"))


# --- records, entities, links ------------------------------------------------

@query
def call_refs(spark, sf):
    return records.refs_of(records.with_records(
        B.calls(spark, sf), V.CALL_RULES, V.CALL_ROLE_TYPES)).drop("event_ts")


@query
def ledger_refs(spark, sf):
    """Reference counts and confidence range per root and target type and link type."""
    refs = records.refs_of(records.with_records(
        B.transfers(spark, sf), V.LEDGER_RULES, V.LEDGER_ROLE_TYPES))
    return refs.groupBy("case_id", "root_no", "ref_no", "root_type", "target_type", "link_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("root_value").alias("roots"),
        F.count_distinct("target_value").alias("targets"), F.min("confidence").alias("lo"),
        F.max("confidence").alias("hi"))


def _entity_rows(entities):
    return entities.select("case_id", "entity_id", "entity_type", "value",
                           micros(F.col("first_seen_at")).alias("first_seen_us"), "first_file_id")


@query
def entities_calls(spark, sf):
    return _entity_rows(resolve.resolve_entities(records.call_evidence(cut(B.calls(spark, sf)))[0]))


@query
def entities_ledger(spark, sf):
    return _entity_rows(resolve.resolve_entities(records.ledger_evidence(cut(B.transfers(spark, sf)))[0]))


@query
def entity_counts_per_file(spark, sf):
    return resolve.created_per_file(*call_tables(spark, sf))


@query
def entity_links_calls(spark, sf):
    return call_tables(spark, sf)[1]


@query
def entity_links_ledger(spark, sf):
    return ledger_tables(spark, sf)[1]


@query
def entity_lookup(spark, sf):
    """Suppliers' accounts looked up in every ledger case: one entity per case and value."""
    entities = resolve.first_mentions(records.ledger_evidence(cut(B.transfers(spark, sf)))[0])
    wanted = B.table(spark, sf, "supplier").select(
        F.lit(V.ACCOUNT).alias("entity_type"), N.account(F.concat(
            F.lit("SUPP-ACC-"), F.col("s_suppkey").cast("string"))).alias("value"), "s_suppkey")
    cases = entities.select("case_id", "entity_type", "value", F.lit(1).alias("one"))
    return cases.join(wanted, ["entity_type", "value"]).groupBy("s_suppkey").agg(
        F.count_distinct("case_id").alias("cases"), F.sum("one").alias("entities"))


@query
def incremental_resolve(spark, sf):
    """Ledger rows shipped before 1999 first, the rest resolved against the stored result."""
    rows = cut(B.transfers(spark, sf))
    early = rows.filter("event_ts < TIMESTAMP_NTZ '1999-01-01 00:00:00'")
    late = rows.filter("event_ts >= TIMESTAMP_NTZ '1999-01-01 00:00:00'")
    m1, l1 = records.ledger_evidence(early)
    e1 = resolve.resolve_entities(m1)
    k1 = resolve.resolve_links(l1, e1)
    m2, l2 = records.ledger_evidence(late)
    e2 = resolve.resolve_entities(m2, e1)
    k2 = resolve.resolve_links(l2, e1.unionByName(e2), k1)
    e = e1.withColumn("batch", F.lit(1)).unionByName(e2.withColumn("batch", F.lit(2)))
    k = k1.withColumn("batch", F.lit(1)).unionByName(k2.withColumn("batch", F.lit(2)))
    return e.groupBy("case_id", "batch").agg(
        F.count(F.lit(1)).alias("entities"), F.min("entity_id").alias("lowest_id"),
        F.max("entity_id").alias("highest_id")).join(
        k.groupBy("case_id", "batch").agg(F.count(F.lit(1)).alias("links"),
                                          F.max("link_id").alias("highest_link")),
        ["case_id", "batch"], "left")


# --- graph --------------------------------------------------------------------

def _edge_rows(edges):
    return edges.select(
        "case_id", "src", "dst", F.round("confidence", 4).alias("confidence"), "link_type",
        F.array_join("link_types", ",").alias("link_types"), "link_count",
        F.round("inverse_confidence", 6).alias("inverse_confidence"),
        labels.confidence_label(F.round("confidence", 4)).alias("confidence_label"))


@query
def graph_edges(spark, sf):
    nodes, edges, _ = _graph(call_tables(spark, sf))
    return _edge_rows(edges)


@query
def graph_edges_ledger(spark, sf):
    nodes, edges, _ = _graph(ledger_tables(spark, sf))
    return _edge_rows(edges)


@query
def graph_edges_stored_scores(spark, sf):
    """Edges weighed by the stored parser confidences."""
    entities, links = ledger_tables(spark, sf)
    return _edge_rows(graph.consolidate(links, graph.nodes_of(entities), enforce_rules=False))


@query
def graph_edges_corroborated(spark, sf):
    """Daily cases with one link per evidence file, so repeated weak links compound."""
    nodes, edges, _ = _graph(call_tables(spark, sf, False, "evidence"))
    return _edge_rows(edges)


@query
def graph_clusters(spark, sf):
    nodes, edges, _ = _graph(ledger_tables(spark, sf))
    return clusters.clusters_of(nodes, edges)


@query
def cluster_medians(spark, sf):
    nodes, edges, _ = _graph(call_tables(spark, sf))
    return clusters.median_sizes(clusters.clusters_of(nodes, edges))


@query
def strongest_paths(spark, sf):
    """From the first to the last entity of each ledger case."""
    nodes, edges, _ = _graph(ledger_tables(spark, sf))
    ends = nodes.groupBy("case_id").agg(F.min("entity_id").alias("source"),
                                        F.max("entity_id").alias("target"))
    found = cut(paths.strongest_paths(edges, nodes, ends))
    # The cost once more from the edges on the path: each step must be an edge, and their sum the cost.
    pair = ["case_id", "source", "target"]
    steps = found.select(*pair, F.explode(F.arrays_zip(
        F.slice("path", 1, F.size("path") - 1).alias("x"), F.slice("path", 2, F.size("path")).alias("y"))).alias("s"))
    walked = steps.select(*pair, F.least("s.x", "s.y").alias("src"), F.greatest("s.x", "s.y").alias("dst")).join(
        edges.select("case_id", "src", "dst", "inverse_confidence"), ["case_id", "src", "dst"]).groupBy(*pair).agg(
        F.sum("inverse_confidence").alias("walked"), F.count(F.lit(1)).alias("n"))
    found = found.join(walked, pair, "left")
    return found.select("case_id", "source", "target", F.round("cost", 6).alias("cost"),
                        F.when(F.col("n") == F.col("hops"), F.round("walked", 6)).alias("path_cost"),
                        F.col("path").isNotNull().alias("connected"),
                        F.element_at("path", 1).alias("path_start"),
                        F.element_at("path", -1).alias("path_end"))


@query
def neighbourhood(spark, sf):
    nodes, edges, _ = _graph(call_tables(spark, sf))
    return graph.neighbourhood(edges, nodes)


@query
def serialized_graph(spark, sf):
    nodes, edges, _ = _graph(call_tables(spark, sf))
    n = graph.serialized_nodes(nodes, clusters.clusters_of(nodes, edges))
    e = graph.serialized_edges(edges)
    return n.select("case_id", F.lit("node").alias("kind"), F.col("id").alias("first_id"),
                    F.col("cluster_id").alias("second"), "entity_type", "value",
                    F.lit(None).cast("double").alias("confidence"),
                    F.lit(None).cast("string").alias("label")).unionByName(
        e.select("case_id", F.lit("edge").alias("kind"), F.col("source").alias("first_id"),
                 F.col("target").alias("second"), F.col("link_type").alias("entity_type"),
                 F.lit(None).cast("string").alias("value"), "confidence",
                 F.col("confidence_label").alias("label")))


# --- risk ------------------------------------------------------------------------

@query
def risk_velocity(spark, sf):
    nodes, edges, _ = _graph(call_tables(spark, sf))
    return risk.velocity(nodes, edges)


@query
def risk_velocity_windowed(spark, sf):
    nodes, edges, _ = _graph(call_tables(spark, sf))
    return risk.velocity(nodes, edges, "windowed")


@query
def risk_sim_switch(spark, sf):
    entities, links = call_tables(spark, sf, False)
    return risk.sim_switch(graph.nodes_of(entities), links, window_hours=6)


@query
def risk_sim_switch_windowed(spark, sf):
    entities, links = call_tables(spark, sf, False)
    return risk.sim_switch(graph.nodes_of(entities), links, "windowed", window_hours=6)


def _call_history(nodes, edges, links):
    """A stored history for the flagged-peer rule: the scores of rules 1, 2 and 5."""
    fired = (risk._fired(risk.velocity(nodes, edges), V.VELOCITY, F.col("n_hops"), F.lit(10))
             .unionByName(risk._fired(risk.sim_switch(nodes, links), V.SIM_SWITCH, F.col("imei"),
                                      F.col("n_phones"), F.lit(24))))
    return cut(risk.max_history(risk.total(nodes, fired)))


@query
def risk_flagged_peer(spark, sf):
    nodes, edges, links = _graph(call_tables(spark, sf))
    return risk.flagged_peer(links, _call_history(nodes, edges, links))


@query
def risk_flagged_peer_sequential(spark, sf):
    """No stored history; entities are scored in id order and flag their later peers."""
    nodes, edges, links = _graph(call_tables(spark, sf))
    fired = risk._fired(risk.velocity(nodes, edges), V.VELOCITY, F.col("n_hops"), F.lit(10))
    base = risk.total(nodes, fired)
    none = base.select("case_id", "entity_id", F.col("score").alias("history")).filter(F.lit(False))
    return risk.flagged_peer(links, none, base)


@query
def risk_oversized_cluster(spark, sf):
    nodes, edges, _ = _graph(ledger_tables(spark, sf))
    return risk.oversized_cluster(clusters.clusters_of(nodes, edges)).select(
        "case_id", "entity_id", "cluster_size", "median_size", F.round("ratio", 6).alias("ratio"))


@query
def risk_transaction_hub(spark, sf):
    return risk.transaction_hub(ledger_tables(spark, sf)[1])


@query
def risk_hub_directed(spark, sf):
    return risk.directed_hub(records.ledger_evidence(B.transfers(spark, sf))[1])


def _scores(tables, **kw):
    nodes, edges, links = _graph(tables)
    found = clusters.clusters_of(nodes, edges)
    return nodes, edges, links, found, cut(risk.assess(nodes, edges, links, found, **kw))


def _score_rows(scores):
    return risk.ranked(scores).select(
        "case_id", "entity_id", "entity_type", "value", "score",
        F.array_join("reason_codes", ",").alias("reason_codes"), "rank",
        F.array_join("reason_messages", " | ").alias("reason_messages"),
        labels.score_tier(F.col("score")).alias("tier"))


@query
def risk_ranked(spark, sf):
    return _score_rows(_scores(call_tables(spark, sf))[4])


@query
def risk_ranked_ledger(spark, sf):
    return _score_rows(_scores(ledger_tables(spark, sf))[4])


@query
def risk_requested(spark, sf):
    """Scores by requested id; the ids just past the end of each case are unknown."""
    nodes, edges, links, _, scores = _scores(ledger_tables(spark, sf))
    ask = nodes.select("case_id", (F.col("entity_id") + 1).alias("entity_id"))
    return risk.scores_for(ask, scores).select(
        "case_id", "entity_id", "score", F.size("reason_codes").alias("n_reasons"))


@query
def risk_types(spark, sf):
    entities, _ = call_tables(spark, sf)
    return risk.listed_types(entities)


# --- custody ----------------------------------------------------------------------

@query
def custody_build(spark, sf):
    return custody.extend_chain(B.artifact_digests(spark, sf))


@query
def custody_extend(spark, sf):
    """The chain in two instalments, the second continuing from the stored heads."""
    files = B.artifact_digests(spark, sf)
    half = F.col("entry_id") < files.agg((F.max("entry_id") / 2).alias("m")).scalar()
    first = cut(custody.extend_chain(files.filter(half)))
    second = custody.extend_chain(files.filter(~half), custody.heads(first))
    return first.unionByName(second)


def _tampered(spark, sf, removed=True):
    """Ledger with altered digests, cut links and, where asked, removed entries, by order key."""
    files = B.artifact_digests(spark, sf)
    built = custody.extend_chain(files)
    k = F.col("entry_id")
    entries = built.withColumn("file_hash", F.when(k % 97 == 0, F.sha2(F.lit("altered").cast("binary"), 256))
                               .otherwise(F.col("file_hash")))
    entries = entries.withColumn("previous_hash", F.when(k % 101 == 1, F.lit("cut"))
                                 .otherwise(F.col("previous_hash")))
    if removed:
        entries = entries.filter((k % 89 != 2) & (F.col("case_id") % 50 != 7))
    return files, entries.drop("case_id")


@query
def custody_verify(spark, sf):
    files, entries = _tampered(spark, sf)
    cases = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    report = custody.verify(cases, files, entries)
    shown = F.array_sort(F.transform(F.map_entries("details"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return report.withColumn("details", F.array_join(shown, ","))


@query
def custody_unlogged(spark, sf):
    files, entries = _tampered(spark, sf)
    return custody.unlogged_files(files, custody.case_ledger(entries, files))


@query
def custody_drift(spark, sf):
    files, entries = _tampered(spark, sf, removed=False)
    return custody.hash_drift(entries, files).select("case_id", "evidence_file_id")


@query
def custody_heads(spark, sf):
    return custody.heads(custody.extend_chain(B.artifact_digests(spark, sf)))


# --- reports -----------------------------------------------------------------------

def _cases(spark, sf):
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", month.alias("m"))
    customer = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    files = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("c_nationkey") * 1_000_000 + F.col("m")).cast("long").alias("case_id"),
        F.col("o_orderkey").alias("evidence_file_id"))
    return files.select("case_id").distinct(), files


@query
def case_metrics(spark, sf):
    cases, files = _cases(spark, sf)
    entities, links = ledger_tables(spark, sf)
    nodes, edges, links = _graph((entities, links))
    return BR.case_metrics(cases, files, entities, links, clusters.clusters_of(nodes, edges))


@query
def top_entities(spark, sf):
    return BR.top_entities(_scores(call_tables(spark, sf))[4]).select(
        "case_id", "rank", "entity_id", "entity_type", "identifier", "score")


@query
def cluster_summary(spark, sf):
    nodes, _, _, found, scores = _scores(ledger_tables(spark, sf))
    out = BR.cluster_summary(nodes, found, scores)
    return out.withColumn("entity_types", F.array_join("entity_types", ","))


def _brief_inputs(spark, sf):
    """Metrics, custody report, top entities and cluster summary of the ledger cases."""
    cases, files = _cases(spark, sf)
    tables = ledger_tables(spark, sf)
    nodes, edges, links, found, scores = _scores(tables)
    metrics = BR.case_metrics(cases, files, tables[0], links, found)
    hashed = files.withColumn("entry_id", F.col("evidence_file_id")).withColumn(
        "file_hash", F.sha2(F.col("evidence_file_id").cast("string"), 256))
    entries = custody.extend_chain(hashed).drop("case_id")
    report = cut(custody.verify(cases, files, cut(entries)))
    return metrics, report, BR.top_entities(scores), BR.cluster_summary(nodes, found, scores)


@query
def brief_digest(spark, sf):
    d = BR.digest(*_brief_inputs(spark, sf))
    first = F.get("entities", F.lit(0))
    return d.select(
        "case_id", F.size("entities").alias("shown_entities"), F.size("clusters").alias("shown_clusters"),
        "more_entities", "more_clusters", "custody_status", "head_hash_shown",
        first["identifier"].alias("first_identifier"), first["score"].alias("first_score"),
        first["severity"].alias("first_severity"),
        F.get("clusters", F.lit(0))["node_count"].alias("largest_cluster"))


@query
def brief_sections(spark, sf):
    metrics, report, top, summary = _brief_inputs(spark, sf)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return BR.brief_sections(metrics, report, top, summary, stamp).select(
        "case_id", "section", "item_no",
        F.coalesce(F.get_json_object("body", "$.node_count"), F.get_json_object("body", "$.score"),
                   F.get_json_object("body", "$.total_entries"),
                   F.get_json_object("body", "$.total_links")).cast("long").alias("figure"))


@query
def brief_documents(spark, sf):
    """The whole JSON of every section of every brief; a case's document is its rows in order."""
    metrics, report, top, summary = _brief_inputs(spark, sf)
    named = metrics.select("case_id", F.concat(F.lit("Ledger "), F.col("case_id")).alias("name"),
                           F.when(F.col("case_id") % 2 == 0, "active").otherwise("archived").alias("status"),
                           *[c for c in metrics.columns if c != "case_id"])
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return BR.brief_sections(named, report, top, summary, stamp).select("case_id", "section", "item_no", "body")


@query
def custody_statements(spark, sf):
    files, entries = _tampered(spark, sf)
    cases = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return BR.custody_statement(custody.verify(cases, files, entries)).select(
        "case_id", "is_valid", "statutory_statement")


@query
def case_list(spark, sf):
    """Suppliers as case envelopes: half stored, all seeded by name, listed newest first."""
    s = B.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    empty = s.select(F.col("s_suppkey").alias("case_id"), "name").filter(F.lit(False))
    stored = cut(CS.create_cases(empty, s.filter("s_suppkey % 2 = 0").select(
        "name", F.lit("active").alias("status")), stamp))
    added = CS.seed_cases(stored, s.select("name", F.lit("archived").alias("status")), stamp)
    both = CS.list_cases(stored.unionByName(added))
    return both.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("case_id").alias("lowest"), F.max("case_id").alias("highest"),
        F.count_distinct("case_id").alias("ids"), F.count_distinct("name").alias("names"))


@query
def integrity_violations(spark, sf):
    """Call links with dangling ends and impossible confidences put in by link id."""
    entities, links = call_tables(spark, sf)
    k = F.col("link_id")
    bad = links.withColumn("entity_b_id", F.when(k % 7 == 3, F.col("entity_b_id") + 1_000_000)
                           .otherwise(F.col("entity_b_id"))).withColumn(
        "confidence_score", F.when(k % 5 == 1, F.col("confidence_score") + 1)
        .otherwise(F.col("confidence_score")))
    return checks.violations(entities, bad)


@query
def integrity_all_rules(spark, sf):
    """Every rule broken on purpose: dangling ends, files, cases and scored entities, values out of range."""
    entities, links = call_tables(spark, sf)
    k, far = F.col("link_id"), 1_000_000
    bad = links.withColumns({
        "entity_a_id": F.when(k % 11 == 2, F.col("entity_a_id") + far).otherwise(F.col("entity_a_id")),
        "entity_b_id": F.when(k % 7 == 3, F.lit(None)).otherwise(F.col("entity_b_id")),
        "confidence_score": F.when(k % 5 == 1, -F.col("confidence_score")).otherwise(F.col("confidence_score"))})
    e = F.col("entity_id")
    scores = entities.select("case_id", F.when(e % 9 == 4, e + far).otherwise(e).alias("entity_id"),
                             F.when(e % 13 == 5, 101).when(e % 13 == 6, -1).otherwise(100).alias("score"))
    files = links.select("case_id", F.col("source_evidence_file_id").alias("evidence_file_id")).distinct()
    cases = files.select("case_id").distinct().filter("case_id % 4 <> 1")
    return checks.violations(entities, bad, scores, files.filter("evidence_file_id % 3 <> 1"), cases)


# --- evidence files built from the tables ---------------------------------------------

@query
def csv_call_rows(spark, sf):
    lines = B.call_files(spark, sf)
    headers = tabular.headers_of(lines, V.CALL_ALIASES, V.CALL_REQUIRED)
    rows = tabular.call_rows(tabular.rows_of(lines, headers, list(V.CALL_ALIASES)))
    return rows.select("case_id", "evidence_file_id", "row_ref", "caller", "callee", "imei", "ip",
                       micros(F.col("event_ts")).alias("event_us"), "n_cells", "skipped_reason")


@query
def csv_ledger_rows(spark, sf):
    lines = B.ledger_files(spark, sf)
    headers = tabular.headers_of(lines, V.LEDGER_ALIASES, V.LEDGER_REQUIRED)
    rows = tabular.ledger_rows(tabular.rows_of(lines, headers, list(V.LEDGER_ALIASES)))
    return rows.select("evidence_file_id", "row_no", "sender", "receiver", "upi", "amount",
                       micros(F.col("event_ts")).alias("event_us"), "skipped_reason")


@query
def csv_rejections(spark, sf):
    lines = B.ledger_files(spark, sf, header_only=True)
    headers = cut(tabular.headers_of(lines, V.LEDGER_ALIASES, V.LEDGER_REQUIRED))
    rows = tabular.ledger_rows(tabular.rows_of(lines, headers, list(V.LEDGER_ALIASES)))
    files = B.table(spark, sf, "customer").select(
        F.lit(1).cast("long").alias("case_id"), F.col("c_custkey").alias("evidence_file_id"))
    return tabular.rejected(files, headers, rows)


@query
def csv_ingestion_summary(spark, sf):
    lines = B.call_files(spark, sf)
    headers = cut(tabular.headers_of(lines, V.CALL_ALIASES, V.CALL_REQUIRED))
    rows = cut(tabular.call_rows(tabular.rows_of(lines, headers, list(V.CALL_ALIASES))))
    files = lines.filter("line_no = 0").select("case_id", "evidence_file_id")
    entities, links = resolve.resolve(records.call_evidence(rows))
    return resolve.ingestion_summary(files, rows, entities, links)


@query
def mail_messages(spark, sf):
    read = mail.messages(B.mails(spark, sf))
    return read.select("case_id", "evidence_file_id", "sender",
                       F.array_join("recipients", ",").alias("recipients"),
                       F.array_join("hops", ",").alias("hops"), "row_ref",
                       micros(F.col("event_ts")).alias("event_us"), "error_class")


@query
def mail_links(spark, sf):
    entities, links = resolve.resolve(records.mail_evidence(mail.messages(B.mails(spark, sf))))
    names = entities.select("case_id", "entity_id", "value")
    return links.join(names.toDF("case_id", "entity_a_id", "a"), ["case_id", "entity_a_id"]).join(
        names.toDF("case_id", "entity_b_id", "b"), ["case_id", "entity_b_id"]).select(
        "case_id", "entity_a_id", "entity_b_id", "a", "b", "link_type", "confidence_score")


@query
def json_identifiers(spark, sf):
    docs = cut(B.json_dumps(spark, sf)).withColumn("json", device_log.is_json(F.col("text")))
    return device_log.distinct_identifiers(device_log.json_identifiers(docs.filter("json")))


@query
def json_packages(spark, sf):
    found = cut(device_log.json_identifiers(B.json_dumps(spark, sf)))
    return device_log.json_outcomes(found).join(device_log.packages(found), device_log.KEYS)


@query
def extract_identifiers(spark, sf):
    return device_log.distinct_identifiers(device_log.line_identifiers(
        device_log.text_lines(B.text_dumps(spark, sf))))


@query
def log_line_outcomes(spark, sf):
    return device_log.line_outcomes(device_log.line_identifiers(
        device_log.text_lines(B.text_dumps(spark, sf))))


@query
def device_cross_links(spark, sf):
    """Pairs of identifiers that occur in one JSON dump, per hourly case."""
    found = device_log.distinct_identifiers(device_log.json_identifiers(B.json_dumps(spark, sf)))
    return resolve.resolve(records.device_evidence(cut(found)))[1]


@query
def device_cross_links_text(spark, sf):
    found = device_log.distinct_identifiers(device_log.line_identifiers(
        device_log.text_lines(B.text_dumps(spark, sf))))
    return resolve.resolve(records.device_evidence(cut(found)))[1]


@query
def stream_calls(spark, sf):
    """The event table as a stream of call records resolved into a store."""
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    store = ingest.Store(spark, f"{root}/store")
    schema = B.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ingest.stream_records(
        stream, lambda b: records.call_evidence(B.calls(b.sparkSession, sf, events=b)), store,
        f"{root}/checkpoint").awaitTermination()
    return _entity_rows(store.read(spark, "entity"))


def _parsed_folder(spark, lines, source_type):
    """An evidence folder written from ``lines``, scanned, registered and parsed."""
    root = f"{scratch_root(spark)}/folder-{uuid.uuid4().hex}"
    B.write_folder(lines, root, source_type)
    files = artifacts.register(artifacts.scan(spark, root))
    return files, artifacts.parse_folder(spark, root, files)


def _named(mentions):
    """How often, in how many files and in which rows each value is named."""
    return mentions.groupBy("case_id", "entity_type", "value").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("evidence_file_id").alias("n_files"),
        F.sum("rec_no").alias("row_sum"), micros(F.min("event_ts")).alias("first_seen_us"))


def _daily_call_lines(spark, sf):
    return B.call_files(spark, sf, False).withColumnRenamed("evidence_file_id", "part")


@query
def csv_folder_calls(spark, sf):
    """All events as CSV files, read back from the folder."""
    return _named(_parsed_folder(spark, _daily_call_lines(spark, sf), "cdr")[1].mentions)


@query
def csv_folder_ledger(spark, sf):
    """All orders as CSV files: rows used and skipped, mentions and links per file, and refusals."""
    files, parsed = _parsed_folder(spark, B.order_files(spark, sf), "bank_upi")

    def per_file(df, name):
        return df.groupBy("evidence_file_id").agg(F.count(F.lit(1)).alias(name))

    out = files.select("case_id", B.part_of(F.col("path")).alias("part"), "evidence_file_id")
    for side in (parsed.outcomes.drop("case_id"), parsed.rejected.drop("case_id"),
                 per_file(parsed.mentions, "mentions"), per_file(parsed.links, "links")):
        out = out.join(side, "evidence_file_id", "left")
    return out.drop("evidence_file_id")


@query
def mail_folder(spark, sf):
    """All conversation turns as mail files, read back from the folder."""
    lines = B.mails(spark, sf).select(
        "case_id", F.col("evidence_file_id").alias("part"), F.lit(0).cast("long").alias("line_no"), F.col("content").cast("string").alias("value"))
    return _named(_parsed_folder(spark, lines, "email")[1].mentions).drop("row_sum")


@query
def dump_folder(spark, sf):
    """Device dumps of all suppliers, read back from the folder: identifiers, outcomes and refusals by file."""
    files, parsed = _parsed_folder(spark, B.supplier_dumps(spark, sf), "android_log")
    part = files.select("evidence_file_id", B.part_of(F.col("path")).alias("part"))
    none = F.lit(None).cast("string")
    rows = parsed.mentions.select("evidence_file_id", "case_id", "entity_type", "value").unionByName(
        parsed.rejected.select("evidence_file_id", "case_id", F.col("error_class").alias("entity_type"), none.alias("value"))
    ).unionByName(parsed.outcomes.select(
        "evidence_file_id", "case_id", F.lit("outcome").alias("entity_type"),
        F.format_string("%d/%d", "rows_processed", "rows_skipped").alias("value")))
    return rows.join(part, "evidence_file_id").drop("evidence_file_id")


@query
def entities_dumps(spark, sf):
    """Entities of text dumps, whose first time is that of the upload."""
    dumps = B.text_dumps(spark, sf)
    files = dumps.select("evidence_file_id", (
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("evidence_file_id").cast("int"))
    ).alias("uploaded_at"))
    found = cut(device_log.distinct_identifiers(device_log.line_identifiers(device_log.text_lines(dumps))))
    return _entity_rows(resolve.resolve_entities(artifacts.dated(records.device_evidence(found)[0], files)))


def _streamed_folder(spark, sf, score=False, epoch_batches=ingest.EPOCH_BATCHES):
    """Call files of all events as a folder that arrives in at least three micro-batches."""
    root = f"{scratch_root(spark)}/arrivals-{uuid.uuid4().hex}"
    B.write_folder(_daily_call_lines(spark, sf), f"{root}/in", "cdr")
    n = artifacts.scan(spark, f"{root}/in").drop("content").count()
    store = ingest.Store(spark, f"{root}/store", epoch_batches)
    ingest.stream_folder(spark, f"{root}/in", store, f"{root}/checkpoint", score=score, peers=None,
                         files_per_batch=max(1, -(-n // 3))).awaitTermination()
    return store


@query
def stream_folder_entities(spark, sf):
    """Entities after three micro-batches, with times and numbers of links."""
    store = _streamed_folder(spark, sf)
    files = store.read(spark, "evidence_file")
    cases = files.select("case_id").distinct()
    entities = cut(store.entities(spark, 1 << 60, cases))
    ends = F.explode(F.array("entity_a_id", "entity_b_id")).alias("entity_id")
    links = store.read(spark, "entity_link").select("case_id", ends).groupBy("case_id", "entity_id").agg(
        F.count(F.lit(1)).alias("n_links"))
    key = ["case_id", "entity_id"]
    return entities.join(links, key, "left").select(
        "case_id", "entity_type", "value", micros(F.col("first_seen_at")).alias("first_seen_us"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query
def stream_folder_custody(spark, sf):
    """Chains over three micro-batches: valid, and one entry for every file."""
    store = _streamed_folder(spark, sf)
    files = store.read(spark, "evidence_file")
    report = custody.verify(files.select("case_id").distinct(), files, store.read(spark, "custody_log_entry"))
    return report.select("case_id", "is_valid", "total_entries", "unlogged_files")


@query
def stream_folder_scores(spark, sf):
    """Last scores, reasons and cluster sizes after three micro-batches, the last of them upon a snapshot: cases
    whose files arrive in several batches are scored again over components merged from batch to batch."""
    store = _streamed_folder(spark, sf, True, epoch_batches=2)
    key = ["case_id", "entity_id"]
    last = store.read(spark, "risk_score").groupBy(*key).agg(
        F.max_by(F.struct("score", "reason_codes"), "run_id").alias("s"))
    sizes = store.latest(spark, "component", None, None)
    sizes = sizes.join(sizes.groupBy("case_id", "root").agg(F.count(F.lit(1)).alias("cluster_size")), ["case_id", "root"])
    return store.read(spark, "entity").join(last, key, "left").join(sizes, key, "left").select(
        "case_id", "entity_type", "value", "s.score", F.array_join("s.reason_codes", ",").alias("reasons"), "cluster_size")


@query
def risk_list_phones(spark, sf):
    """The risk list filtered to phones, with rules 1 and 2."""
    nodes, edges, links = _graph(call_tables(spark, sf))
    fired = (risk._fired(risk.velocity(nodes, edges), V.VELOCITY, F.col("n_hops"), F.lit(10))
             .unionByName(risk._fired(risk.sim_switch(nodes, links), V.SIM_SWITCH, F.col("imei"),
                                      F.col("n_phones"), F.lit(24))))
    return risk.risk_list(risk.total(nodes, fired), V.PHONE).select(
        "case_id", "entity_id", "value", "score", "recommendation")


@query
def hash_sync(spark, sf):
    """Stored digests replaced by computed ones for the files that were read again."""
    files = B.artifact_digests(spark, sf)
    stale = files.withColumn("file_hash", F.when(F.col("entry_id") % 3 == 0, F.lit("stale"))
                             .otherwise(F.col("file_hash")))
    again = files.join(B.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("evidence_file_id")), "evidence_file_id", "left_semi")
    return custody.sync_hashes(stale, again)
