"""Evidence folders end to end: parsing, resolution, graph, scores, custody, refusals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkloom.operators import clusters, custody, graph, resolve, risk
from linkloom.sources import artifacts as A
from linkloom.sources import device_log, mail, tabular
from tests import evidence_samples as S


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("evidence"))
    S.write_case(root, S.FOUR)
    files = A.register(A.scan(spark, root))
    parsed = A.parse_folder(spark, root, files)
    entities, links = resolve.resolve((parsed.mentions, parsed.links))
    return {"root": root, "files": files, "parsed": parsed, "entities": entities, "links": links}


def test_summary_counts(case):
    created = resolve.created_per_file(case["entities"], case["links"])
    rows = A.summary(case["files"], case["parsed"], created).orderBy("evidence_file_id").collect()
    assert [tuple(r)[2:] for r in rows] == [(4, 1, 5, 5), (3, 1, 5, 8), (1, 0, 3, 2), (4, 0, 1, 6)]
    assert case["parsed"].rejected.count() == 0
    skipped = {r.skipped_reason for r in case["parsed"].skipped.collect()}
    assert skipped == {"Row 3 skipped: no valid phone, IMEI, or IP found.",
                       "Row 4 skipped: missing valid sender, receiver, or UPI."}


def test_links_by_type_and_edges(case):
    got = {r.link_type: r["count"] for r in case["links"].groupBy("link_type").count().collect()}
    assert got == {"shared_upi_handle": 5, "shared_imei": 4, "direct_communication": 4,
                   "transaction": 3, "shared_ip_subnet": 3, "shared_mac": 2}
    edges = graph.serialized_edges(graph.consolidate(case["links"], graph.nodes_of(case["entities"])))
    labels = {r.confidence_label: r["count"] for r in edges.groupBy("confidence_label").count().collect()}
    assert labels == {"Strong": 9, "Medium": 8, "Weak": 1}


def test_first_scoring_pass(case):
    nodes = graph.nodes_of(case["entities"])  # the address in the dump has the time of its upload
    edges = graph.consolidate(case["links"], nodes)
    found = clusters.clusters_of(nodes, edges)
    assert found.select("cluster_id", "cluster_size").distinct().collect() == [(0, 14)]
    seq = {r.entity_id: r for r in risk.assess(
        nodes, edges, case["links"], found, peers="sequential").collect()}
    assert {i: r.score for i, r in seq.items()} == {
        5: 80, 13: 80, 7: 75, 1: 45, 3: 45, 6: 45, 8: 45, 2: 35, 14: 35, 4: 0, 9: 0, 10: 0, 11: 0, 12: 0}
    assert seq[7].value == "BOSAVINGS"
    assert seq[7].reason_codes == ["HIGH_VELOCITY_ROUTING", "MULTI_ACCOUNT_TRANSACTION_HUB"]
    assert any("(risk score 45)" in m for m in seq[2].reason_messages)
    # On a second pass stored scores count too: entity 3 now sees the tablet, entity 5.
    history = risk.max_history(spark_rows(case, seq))
    again = {r.entity_id: r.score for r in risk.assess(
        nodes, edges, case["links"], found, history=history, peers="sequential").collect()}
    assert again == {**{i: r.score for i, r in seq.items()}, 3: 80}
    snap = {r.entity_id: r.score for r in risk.assess(nodes, edges, case["links"], found).collect()}
    assert (snap[5], snap[13], snap[2], snap[14]) == (45, 45, 0, 0)


def spark_rows(case, scored):
    spark = case["files"].sparkSession
    return spark.createDataFrame([(1, i, r.score) for i, r in scored.items()],
                                 "case_id long, entity_id long, score int")


def test_custody_of_folder(case):
    files = case["files"]
    entries = custody.extend_chain(files.select(
        "case_id", "evidence_file_id", F.col("evidence_file_id").alias("entry_id"), "file_hash",
        custody.handling_note(F.col("original_filename"), F.col("source_type")).alias("handling_note")))
    report = custody.verify(files.select("case_id").distinct(), files, entries.drop("case_id")).first()
    assert report.is_valid and report.total_entries == 4
    assert report.details == {"head_hash": report.head_hash}
    assert entries.filter("entry_id = 1").first().handling_note == (
        "Forensic ingestion and cryptographic verification for calls.csv (source: cdr)")


def test_mail_fields(case):
    row = mail.messages(A.scan(case["files"].sparkSession, case["root"]).filter(
        "source_type = 'email'").withColumn("evidence_file_id", F.lit(1).cast("long"))).first()
    assert row.sender == "gate@depot.example"
    assert row.recipients == ["ines@post.example"]
    assert row.hops == [S.DEPOT_IP]
    assert row.row_ref == "<ramp4@depot.example>" and str(row.event_ts) == "2023-11-02 20:15:00"


def test_refusals(spark, tmp_path):
    good = S.call_csv()
    S.write_case(str(tmp_path), [
        ("cdr", "a_headers.csv", "foo,bar\n1,2\n"), ("cdr", "b_empty.csv", ""),
        ("cdr", "c_header_only.csv", "caller,callee\n"), ("ipdr", "d_ok.csv", good),
        ("bank_upi", "e_city.csv", "city,state\nx,y\n"), ("email", "f_text.eml", "no headers here\nFrom: a@b.co\n"),
        ("email", "g_blank.eml", "  \n"), ("android_log", "h_silent.txt", "nothing\nhere\n"),
        ("android_log", "i_blank.log", ""), ("fax", "j.bin", "x"),
        ("cdr", "k_ragged.csv", "caller,callee\n9730044455,9876543210\n9730044455,9876543210,1\n"),
        ("cdr", "l_bytes.csv", b"caller,callee\n9730044455,\xe9\xff\n")])
    files = A.register(A.scan(spark, str(tmp_path)))
    parsed = A.parse_folder(spark, str(tmp_path), files)
    got = {r.original_filename[0]: r.error_class for r in parsed.rejected.join(
        files.select("evidence_file_id", "original_filename"), "evidence_file_id").collect()}
    assert got == {"a": "MissingColumnError", "c": "EmptyFileError",
                   "e": "MissingColumnError", "f": "CorruptedFileError", "g": "EmptyFileError",
                   "h": "CorruptedFileError", "j": "UnsupportedFormatError",
                   "k": "CorruptedFileError", "l": "CorruptedFileError"}
    outcomes = {r.evidence_file_id: (r.rows_processed, r.rows_skipped) for r in parsed.outcomes.collect()}
    assert list(outcomes.values()) == [(4, 1)]
    delivered = spark.createDataFrame(
        [(1, "cdr", "b_empty.csv"), (1, "android_log", "i_blank.log"), (1, "ipdr", "d_ok.csv")],
        "case_id long, source_type string, original_filename string")
    empty = A.empty_files(delivered, files).collect()
    assert {(r.original_filename, r.error_class) for r in empty} == {
        ("b_empty.csv", "EmptyFileError"), ("i_blank.log", "EmptyFileError")}


def test_uploads_refused(spark):
    ups = spark.createDataFrame(
        [(1, 1, "cdr", b""), (1, 2, "android_log", b" \n"), (1, 3, "email", b""), (1, 4, "fax", b"x")],
        "case_id long, evidence_file_id long, source_type string, content binary")
    parsed = A.parse_uploads(ups)
    assert {r.evidence_file_id: r.error_class for r in parsed.rejected.collect()} == {
        1: "EmptyFileError", 2: "EmptyFileError", 3: "EmptyFileError", 4: "UnsupportedFormatError"}
    assert parsed.mentions.count() == 0


def test_latin1_retry(spark, tmp_path):
    S.write_case(str(tmp_path), [("cdr", "l.csv", b"caller,callee\n9730044455,\xe9 9876543210\n")])
    files = A.register(A.scan(spark, str(tmp_path)))
    lines = A._with_ids(tabular.scan_lines(spark, str(tmp_path), ["cdr"]), files)
    assert A.parse_calls(files, lines).rejected.first().error_class == "CorruptedFileError"
    kept = A.parse_calls(files, lines, "latin1")
    assert kept.rejected.count() == 0
    assert "+é9876543210" in {r.value for r in kept.mentions.collect()}


def test_uploads_equal_folder(spark, case):
    whole = A.scan(spark, case["root"]).join(case["files"].select("path", "evidence_file_id"), "path")
    up = A.parse_uploads(whole)
    entities, links = resolve.resolve((up.mentions, up.links))
    assert entities.exceptAll(case["entities"]).count() == 0
    assert entities.count() == case["entities"].count()
    assert links.exceptAll(case["links"]).count() == 0 and links.count() == case["links"].count()


def test_csv_quoting_and_line_numbers_across_splits(spark, tmp_path):
    body = "".join(f'98111{i:05d},"note ""x"", y{chr(10) if i % 10 == 3 else " "}z",20{i:08d}\n'
                   for i in range(400))
    S.write_case(str(tmp_path), [("cdr", "q.csv", "caller,memo,callee\n\n" + body)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        files = A.register(A.scan(spark, str(tmp_path)))
        lines = tabular.scan_lines(spark, str(tmp_path), ["cdr"])
        assert lines.select("block").distinct().count() > 3
        parsed = A.parse_calls(files, A._with_ids(lines, files))
        got = parsed.mentions.filter("pos = 0").orderBy("rec_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.rec_no, r.value) for r in got] == [(i + 1, f"+9198111{i:05d}"[:13]) for i in range(400)]
    assert parsed.rejected.count() == 0


def test_cells(spark):
    row = spark.createDataFrame([('a,,"b,""c""",,',), (",x",), ("",), ('"q"tail,5" disk',)], "v string")
    assert [r.c for r in row.select(tabular.cells(F.col("v")).alias("c")).collect()] == [
        ["a", "", 'b,"c"', "", ""], ["", "x"], [""], ["qtail", '5" disk']]


def test_text_dump(spark):
    text = ("I net: ip=198.51.100.23 mac=00:1a:2B:3c:4d:5e\nimei=351111222233334 phone=+919730044455 tel: 9876543210\n"
            "\nplain line\n8.8.8.8 then 10.0.0.1 and 8.8.8.8\n")
    docs = spark.createDataFrame([(1, 1, text)], "case_id long, evidence_file_id long, text string")
    found = device_log.line_identifiers(device_log.text_lines(docs))
    assert tuple(device_log.line_outcomes(found).first())[2:] == (3, 1)
    got = {(r.entity_type, r.value) for r in device_log.distinct_identifiers(found).collect()}
    assert got == {("ip_address", "198.51.100.23"), ("ip_address", "8.8.8.8"), ("ip_address", "10.0.0.1"),
                   ("mac_address", "00:1A:2B:3C:4D:5E"), ("device_imei", "351111222233334"),
                   ("phone", "+919730044455")}


def test_json_dump(spark):
    text = ('{"a": {"b": [{"IMEI_no": 351111222233334, "x": [["see 8.8.8.8 and 9.9.9.9"]]}]},'
            ' "recipient": "10.0.0.7:80", "msisdn\\u0031": "97300\\u002044455", "note": "\\"imei\\": {",'
            ' "app": "com.x.y", "mac": null}')
    docs = spark.createDataFrame([(1, 1, text)], "case_id long, evidence_file_id long, text string")
    assert docs.select(device_log.is_json(F.col("text"))).first()[0]
    found = device_log.json_identifiers(docs)
    got = {(r.entity_type, r.value) for r in device_log.distinct_identifiers(found).collect()}
    assert got == {("device_imei", "351111222233334"), ("ip_address", "8.8.8.8"),
                   ("ip_address", "10.0.0.7"), ("phone", "+919730044455")}
    assert tuple(device_log.json_outcomes(found).first())[2:] == (3, 0)
    assert [r.package for r in device_log.packages(found).collect()] == ["com.x.y"]
