"""The table scan keeps every row: split plans, quotes inside cells, quoted line breaks, uploads, odd values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.operators import risk
from linkloom.sources import artifacts as A
from linkloom.sources import device_log, tabular
from tests import evidence_samples as S
from tests.test_functions import apply

ODD = ('caller,callee,note\n9700000001,9700000002,5" disk\n9700000003,9700000004,"two\nlines, ""quoted"""\n'
       '9700000005,9700000006,plain\n"9700000007",9700000008,"a"b\n')


def test_replanned_splits_keep_all_lines(spark, tmp_path):
    rows = "".join(f"97{i:08d},98{i:08d}\n" for i in range(60_000))
    S.write_case(str(tmp_path), [("cdr", "big.csv", "caller,callee\n" + rows)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        lines = tabular.scan_lines(spark, str(tmp_path), ["cdr"])
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        got = lines.agg(F.count(F.lit(1)), F.count_distinct("line_no"), F.max("line_no")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tuple(got) == (60_001, 60_001, 60_000)


@pytest.mark.parametrize("size", ["4", "128m"])
def test_quotes_and_line_breaks(spark, tmp_path, size):
    S.write_case(str(tmp_path), [("cdr", "odd.csv", ODD)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16b" if size == "4" else size)
        lines = tabular.scan_lines(spark, str(tmp_path), ["cdr"]).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line_no for r in lines] == [0, 1, 2, 3, 4]
    assert lines[2].value == '9700000003,9700000004,"two\nlines, ""quoted"""'
    ups = spark.createDataFrame([(1, 7, "cdr", ODD.encode())], "case_id long, evidence_file_id long, source_type string, content binary")
    again = tabular.lines_of_content(ups).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in again] == [(r.line_no, r.value) for r in lines]


def test_unclosed_quote_refuses_the_file(spark, tmp_path):
    S.write_case(str(tmp_path), [("cdr", "open.csv", 'caller,callee\n9700000001,"9700000002\n9700000003,9700000004\n')])
    files = A.register(A.scan(spark, str(tmp_path)))
    parsed = A.parse_folder(spark, str(tmp_path), files)
    assert [r.error_class for r in parsed.rejected.collect()] == ["CorruptedFileError"]


def test_json_test_is_the_same_at_any_size(spark):
    small, large = '{"a": {"imei": "1"}}', '{"a": "' + "x" * (17 << 20) + '"}'
    texts = [small, small[:-1], "[1, 2]", "[1, 2", large, large[:-1], '"text"', "12", "IMEI 12", ""]
    got = apply(spark, texts, lambda c: device_log.is_json(c))
    assert got == [True, False, True, False, True, False, True, True, False, False]


def test_long_values_do_not_break(spark):
    assert apply(spark, ["ab:" * 4000, "::1"], N.ip) == [None, "::1"]
    docs = spark.createDataFrame([(1, 1, '{"app": "' + "a." * 6000 + 'b"}')], "case_id long, evidence_file_id long, text string")
    assert device_log.packages(device_log.json_identifiers(docs)).count() == 1


def test_more_time_forms(spark):
    cases = {"03/15/2024 02:30:00 PM": "2024-03-15 14:30:00", "15/03/24 10:00": "2024-03-15 10:00:00",
             "March 15, 2024 10:05": "2024-03-15 10:05:00", "20240315T101500": "2024-03-15 10:15:00",
             "2024-03-15 12:10 am": "2024-03-15 00:10:00", "2024-03-151": None, "15/03/20249": None,
             "2024-03-15 10:05:00.1234567": "2024-03-15 10:05:00.123456"}
    got = apply(spark, list(cases), lambda c: N.event_time(c).cast("string"))
    assert got == list(cases.values())


def test_untimed_phone_does_not_silence_the_device(spark):
    nodes = spark.createDataFrame(
        [(1, 1, risk.V.IMEI, "350000000000001", None)] + [(1, i, risk.V.PHONE, f"+9{i}", None if i == 2 else f"2024-03-15 10:0{i}:00") for i in range(2, 6)],
        "case_id long, entity_id long, entity_type string, value string, t string").withColumn("first_seen_at", F.col("t").cast("timestamp_ntz"))
    links = spark.createDataFrame([(1, i, 1, i, "shared_imei") for i in range(2, 6)],
                                  "case_id long, link_id long, entity_a_id long, entity_b_id long, link_type string")
    assert [r.n_phones for r in risk.sim_switch_devices(nodes, links).collect()] == [3]


def test_phone_lists_in_dumps(spark):
    texts = ['{"sim": {"Phones": ["9700000001", "+49 1520 1110001"], "n": [1]}}', '{"msisdn": [9700000002]}', '{"phones": []}']
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "case_id long, evidence_file_id long, text string")
    got = device_log.distinct_identifiers(device_log.json_identifiers(docs)).filter("entity_type = 'phone'")
    assert {(r.evidence_file_id, r.value) for r in got.collect()} == {
        (0, "+919700000001"), (0, "+4915201110001"), (1, "+919700000002")}
