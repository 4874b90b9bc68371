"""What plans evaluate and read: expensive expressions once, rows written once, only the parsers that are needed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from linkloom import vocab as V
from linkloom.operators import clusters, custody, graph, numbering, records, resolve, risk
from linkloom.plans import bindings
from linkloom.sources import artifacts, device_log


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_evaluate_a_party_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1, 2, 3, "s-marker", "r", None, None), (1, 2, 4, None, None, None, None)],
                          "case_id long, evidence_file_id long, rec_no long, sender string, receiver string, upi string, phone string"
                          ).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("sender", F.regexp_replace("sender", "-marker", "")).withColumn(
        "event_ts", F.lit(None).cast("timestamp_ntz"))
    refs = records.refs_of(records.with_records(rows, V.LEDGER_RULES, V.LEDGER_ROLE_TYPES))
    assert optimized(refs).count("-marker") == 1
    assert sorted((r.rec_no, r.root_no, r.ref_no, r.root_value, r.target_value) for r in refs.collect()) == [
        (3, 0, 0, "s", "r"), (3, 1, 0, "r", "s")]


def test_identifiers_are_found_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, 2, "10.0.0.1"), (1, 3, "-marker")], "case_id long, evidence_file_id long, text string").write.parquet(path)
    value = F.nullif(F.regexp_replace("text", "-marker", ""), F.lit(""))
    found = spark.read.parquet(path).withColumn("found", F.filter(F.array(F.struct(
        F.lit(V.IP).alias("entity_type"), value.alias("value"))), lambda x: x["value"].isNotNull()))
    got = device_log.distinct_identifiers(found)
    assert optimized(got).count("-marker") == 1
    assert [tuple(r) for r in got.collect()] == [(1, 2, V.IP, "10.0.0.1")]


def test_numbers_need_no_window_over_the_rows(spark):
    rows = [(g, k, 10) for g in (1, 2, None) for k in (5, 1, 9, None)]
    df = spark.createDataFrame(rows, "g long, k long, start long")
    got = numbering.number_within(df, ["g"], [F.floor(F.col("k") / 4)], [F.col("k")], "no", F.col("start"))
    assert "Window" not in optimized(got)
    assert sorted((r.g, r.k, r.no - r.start) for r in got.collect()) == [
        (g, k, n) for g in (1, 2) for n, k in enumerate((1, 5, 9), 1)]


def test_only_the_parsers_of_delivered_types_run(spark, monkeypatch):
    ran = []
    for name in ("parse_calls", "parse_ledgers", "parse_mail", "parse_dumps"):
        real = getattr(artifacts, name)
        monkeypatch.setattr(artifacts, name, lambda *a, real=real, name=name, **k: (ran.append(name), real(*a, **k))[1])
    schema = "case_id long, evidence_file_id long, source_type string, content binary"
    mail = (1, 1, "email", bytearray(b"From: a@x.example\r\nTo: b@y.example\r\n\r\nhello"))
    parsed = artifacts.parse_uploads(spark.createDataFrame([mail, (1, 2, "fax", bytearray(b"x"))], schema))
    assert ran == ["parse_mail"]
    assert parsed.links.count() == 1 and parsed.skipped.count() == 0
    assert [r.error_class for r in parsed.rejected.collect()] == [V.UNSUPPORTED]
    nothing = artifacts.parse_uploads(spark.createDataFrame([(1, 2, "fax", bytearray(b"x"))], schema))
    assert nothing.mentions.count() == 0 and nothing.outcomes.count() == 0


def test_edges_do_not_travel_to_the_nodes(spark):
    links = spark.createDataFrame(
        [(1, 1, 1, 2), (1, 2, 2, 9), (1, 3, 8, 3), (1, 4, 2, 3), (2, 5, 1, 2), (None, 6, 1, 2), (1, 7, None, 2)],
        "case_id long, link_id long, entity_a_id long, entity_b_id long").withColumns(
        {"link_type": F.lit("transaction"), "confidence_score": F.lit(0.9)})
    nodes = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (2, 2), (None, 1), (None, 2)], "case_id long, entity_id long")
    edges = graph.consolidate(links, nodes)
    assert "LeftSemi" not in optimized(edges)
    assert sorted((r.case_id, r.src, r.dst) for r in edges.collect()) == [(1, 1, 2), (1, 2, 3)]


def test_rounds_read_only_what_is_left(spark, monkeypatch):
    """Stars hang on a chain: after the first round most nodes are out, and at last nothing is left."""
    written, plain = [], clusters.cut
    monkeypatch.setattr(clusters, "cut", lambda df: written.append(plain(df)) or written[-1])
    pairs = [(i, i + 1) for i in range(1, 20)] + [(i, 100 * i + k) for i in range(1, 21) for k in range(20)] + [(5, 6), (70, 71)]
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "case_id long, src long, dst long")
    nodes = spark.createDataFrame([(1, i) for i in sorted({x for p in pairs for x in p} | {99})], "case_id long, entity_id long")
    got = {r.entity_id: r.root for r in clusters.components(nodes, edges).collect()}
    assert got == {i: i if i in (70, 99) else 70 if i == 71 else 1 for i in got} and len(got) == 424 - 1
    sizes = [df.count() for df in written]
    assert sizes[0] == len(pairs) and sizes[-1] == 0 and sizes[3] < 50


def test_verification_keeps_hashes_of_few_entries(spark, monkeypatch):
    """Of a chain only entries at bucket borders and broken ones keep hashes in what is written."""
    written, plain = [], custody.cut
    monkeypatch.setattr(custody, "cut", lambda df: written.append(plain(df)) or written[-1])
    files = spark.range(1, 61).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("evidence_file_id"),
                                      (F.col("id") * 5000).alias("entry_id"), F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    entries = custody.extend_chain(files).drop("case_id").withColumn(
        "file_hash", F.when(F.col("evidence_file_id") == 40, F.lit("altered")).otherwise(F.col("file_hash")))
    report = custody.verify(files.select("case_id").distinct(), files, entries).first()
    assert (report.total_entries, report.broken_index, report.broken_entry_id, report.reason) == (60, 39, 200_000, V.BREAK_HASH)
    hashes = [c for c in written[0].columns if "hash" in c or c == "entry"]
    assert written[0].count() == 60 and written[0].filter(" OR ".join(f"{c} IS NOT NULL" for c in hashes)).count() <= 12


def test_components_of_cases_in_parts(spark, monkeypatch):
    """Cases that tasks read whole and cases split over several parts give the same components, with one written table
    each of small cases and no round over their edges."""
    rng = random.Random(5)
    pairs = {(case, *sorted(rng.sample(range(1, 90), 2))) for case in (1, 2, 3) for _ in range(40 + 30 * case)}
    pairs |= {(4, i, i + 1) for i in range(1, 60)} | {(None, 1, 2), (5, 7, 7)}
    edges = spark.createDataFrame([*pairs, (1, *min(pairs - {(None, 1, 2)})[1:])], "case_id long, src long, dst long")
    nodes = spark.createDataFrame([(c, i) for c in range(1, 6) for i in range(1, 95)], "case_id long, entity_id long")

    def run():
        return {(r.case_id, r.entity_id): r.root for r in clusters.components(nodes, edges).collect()}

    want = {k: k[1] for k in run()}
    for _ in range(90):
        for c, a, b in pairs - {(None, 1, 2)}:
            want[c, a] = want[c, b] = min(want[c, a], want[c, b])
    rounds, plain = [], clusters._round
    monkeypatch.setattr(clusters, "_round", lambda e: rounds.append(1) or plain(e))
    assert run() == want and not rounds
    for limit in (7, 80):
        monkeypatch.setattr(clusters, "LOCAL_EDGES", limit)
        assert run() == want and rounds


def test_first_appearances_are_hashed(spark, monkeypatch):
    """The first appearance of a key is the least number, found without a sort; where the values do not fit into one
    long or some are null it is the least structure, with the same rows."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.randrange(-3, 9) * 10**9, rng.randrange(-5, 5), rng.randrange(3), "account", rng.choice("abc"),
             "account", rng.choice("cde"), rng.choice(["transaction", "shared_imei"]), rng.choice([0.9, 0.95])) for _ in range(400)]
    schema = ("case_id long, evidence_file_id long, rec_no long, pos int, a_type string, a_value string, b_type string, "
              "b_value string, link_type string, confidence double")

    def both(rows):
        links = spark.createDataFrame(rows, schema)
        mentions = links.select("case_id", "evidence_file_id", "rec_no", "pos", F.col("a_type").alias("entity_type"),
                                F.col("a_value").alias("value"), F.lit(None).cast("timestamp_ntz").alias("event_ts"))
        return resolve.first_mentions(mentions), resolve.first_links(links), resolve.first_links(links, "evidence")

    def shown(frames):
        return [sorted(map(repr, f.collect())) for f in frames]

    got = both(rows)
    for f in got:
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    hashed = shown(got)
    far = [(None, (1 << 62), -(1 << 62), 0, "account", "far", "account", "off", "transaction", 0.9)]
    wide = [(1, None, 4, 0, "account", "far", "account", "off", "transaction", 0.9)]
    for more in (far, wide):
        odd = both(rows + more)
        assert all("SortAggregate" in f._jdf.queryExecution().executedPlan().toString() for f in odd)
        assert [[r for r in f if "far" not in r] for f in shown(odd)] == hashed


def test_many_small_files_share_tasks(spark, tmp_path):
    """Small files are written by several tasks, and folders of many folders are listed by few tasks each."""
    lines = spark.range(90).select((F.col("id") % 2).alias("case_id"), F.col("id").alias("part"), F.lit(0).alias("line_no"),
                                   F.col("id").cast("string").alias("value"))
    bindings.write_folder(lines, str(tmp_path), "email")
    assert len({p.name[:10] for p in tmp_path.rglob("part-*.txt")}) > 8
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(setting), spark.sparkContext
    context.setJobGroup("listing", "listing")
    rows = artifacts.scan(spark, str(tmp_path))
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism and spark.conf.get(setting) == before
    assert sorted(int(bytes(r.content)) for r in rows.select("content").collect()) == list(range(90))


def test_hops_are_counted_without_a_join_of_all_ends(spark):
    """Neighbours that are no node do not count, repeated nodes count as often; edges join only with such ends."""
    pairs = [(1, 1, i) for i in range(2, 7)] + [(1, 2, i) for i in range(3, 6)] + [(None, 1, 9), (2, 1, None), (2, 1, 2), (2, 1, 3)]
    edges = spark.createDataFrame(pairs, "case_id long, src long, dst long")
    rows = [(1, i) for i in (1, 2, 3, 4, 4, 6)] + [(2, i) for i in (1, 2, 3, 3)] + [(None, 1)]
    nodes = spark.createDataFrame(rows, "case_id long, entity_id long").withColumn("first_seen_at", F.lit(None).cast("timestamp_ntz"))
    got = risk.velocity(nodes, edges)
    assert "Join Inner" not in optimized(got)
    both = [(c, a, b) for c, a, b in pairs] + [(c, b, a) for c, a, b in pairs]
    want = {}
    for c, a, b in both:
        if c is not None and b is not None:
            want[c, a] = want.get((c, a), 0) + rows.count((c, b))
    assert {(r.case_id, r.entity_id): r.n_hops for r in got.collect()} == {k: n for k, n in want.items() if n >= 3}
