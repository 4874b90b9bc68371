"""Scalar normalizers, masks and labels against fixed expectations."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from linkloom.functions import labels, mask
from linkloom.functions import normalize as N
from linkloom.functions.hashing import chained_digest, file_digest
from linkloom.operators.graph import combine, compound


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_phone(spark):
    cases = {"9730044455": "+919730044455", "919730044455": "+919730044455",
             "0044 20 7946 0958": "+442079460958", "2025550123": "+12025550123", "12345": None,
             "harbour_office": None, "node12345678": "+node12345678", None: None,
             "+91 (973) 004-4455": "+919730044455", "9876543210.0": "+919876543210",
             "1234567890": "+1234567890"}
    assert apply(spark, list(cases), N.phone) == list(cases.values())
    assert apply(spark, ["node12345678"], lambda c: N.phone(c, strict=True)) == [None]


def test_ip_forms(spark):
    texts = ["2001:0DB8:0:0:0:0:0:1", "::1", "fe80::1:0:0:2", "1:0:0:2:0:0:0:3", "::", "1:2:3:4:5:6:7::",
             "1:0:2:0:3:0:4:5", "0:0:1:0:0:1:0:0"]
    assert apply(spark, texts, N.ip) == [str(ipaddress.ip_address(t)) for t in texts]
    assert apply(spark, ["10.0.0.1:443", "x 1.2.3.4", "abc:def", "256.1.1.1", "1::2::3"], N.ip) == [
        "10.0.0.1", "1.2.3.4", None, None, None]


def test_times(spark):
    cases = {"2024-03-15 10:05:00": "2024-03-15 10:05:00", "15/03/2024 10:12:30": "2024-03-15 10:12:30",
             "2024-03-15T10:18:00Z": "2024-03-15 10:18:00", "15-03-2024 11:15:00": "2024-03-15 11:15:00",
             "03/04/2024": "2024-03-04 00:00:00", "1710496800": "2024-03-15 10:00:00",
             "1710496800000": "2024-03-15 10:00:00", "20240315": "1970-08-23 06:18:35",
             "Fri, 15 Mar 2024 10:15:02 +0530": "2024-03-15 10:15:02", "garbage": None, "": None}
    got = apply(spark, list(cases), lambda c: N.event_time(c).cast("string"))
    assert got == list(cases.values())


def test_amounts_and_accounts(spark):
    assert apply(spark, ["INR 50,000", "25000.00", "₹25,000", "abc", None], N.amount) == [
        50000.0, 25000.0, 25000.0, None, None]
    assert apply(spark, [" pier-acc 1 ", "A@B", "ab", None], N.account) == ["PIERACC1", "a@b", None, None]


def starred(text):
    """All but the last four characters as stars."""
    return "*" * max(0, len(text) - 4) + text[-4:]


def test_masks(spark):
    """Inputs are made from the rules: every user length from none to six, digit runs around the limits of 5 and of
    14 to 16 digits, numbers with no, one-digit and two-digit country prefixes."""
    digits = "8046213957208461"
    cases = []
    for n in range(0, 7):
        user = "quartz"[:n]
        cases.append((f"{user}@bay", "account", ("*" if n <= 1 else "*" * (n - 1) + user[-1] if n <= 4 else starred(user)) + "@bay"))
        cases.append((f"{user}@bay.example", "email_address",
                      ("*" * n if n <= 2 else user[0] + "*" * (n - 2) + user[-1]) + "@bay.example"))
    for n in range(1, 17):
        cases += [(digits[:n], kind, starred(digits[:n])) for kind in ("phone", "account", "device_imei")]
        prefix = "+80" if n > 2 else "+8" if n > 1 else "+"
        cases.append(("+" + digits[:n], "phone", prefix + starred(digits[len(prefix) - 1:n])))
    for country in ("1", "7"):
        for n in (9, 10):
            cases.append((f"+{country}{digits[:n]}", "phone", f"+{country}" + starred(digits[:n])))
    cases += [("", kind, "") for kind in ("phone", "account", "email_address")]
    cases += [("203.0.113.77", "ip_address", "203.0.113.77"), ("no at sign", "email_address", "no at sign")]
    df = spark.createDataFrame(cases, "v string, t string, want string")
    for r in df.select("v", "t", "want", mask.identifier(F.col("v"), F.col("t")).alias("got")).collect():
        assert r.got == r.want, r
    # Without a type the look decides: a plus sign and a digit, an at sign, then the number of digits.
    looks = ["+33" + digits[:8], "quartz@bay.example", *(digits[:n] for n in (4, 5, 13, 14, 16)), "plain words"]
    assert apply(spark, looks, lambda c: mask.identifier(c)) == [
        "+33" + starred(digits[:8]), "q****z@bay.example", digits[:4], *(starred(digits[:n]) for n in (5, 13, 14, 16)), "plain words"]


def test_compounding(spark):
    weights = [[.3], [.3, .3], [.3] * 3, [.3] * 5, [.3, .4], [], [.85, .3, .3], [.75], [.5] + [.4] * 4]
    assert apply(spark, weights, combine, "array<double>") == [
        .3, .51, .657, .8319, .58, 0.0, .85, .75, .8704]
    assert apply(spark, [[]], compound, "array<double>") == [0.0]


def test_labels(spark):
    assert apply(spark, [.85, .8, .65, .5, .35], labels.confidence_label, "double") == [
        "Strong", "Strong", "Medium", "Medium", "Weak"]
    assert apply(spark, ["shared_imei", "carrier_pigeon"], labels.link_weight) == [.85, .5]
    names = ["A.EML", "gmail.csv", "upi_log.txt", "ipdr1.csv", "dump.log", "calls.csv"]
    assert apply(spark, names, labels.source_of_filename) == [
        "email", "email", "bank_upi", "ipdr", "android_log", "cdr"]


def test_digests(spark):
    assert apply(spark, [bytearray(b"")], file_digest, "binary")[0].startswith("e3b0c442")
    assert apply(spark, ["ab"], lambda c: chained_digest(c, F.lit(None))) == apply(
        spark, ["ab:GENESIS"], lambda c: F.sha2(c, 256))
