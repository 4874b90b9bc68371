"""Identifier, date and amount normalizers as native column expressions.

Each normalizer is one linear chain: every step consumes the previous one exactly once, so the
generated code does not re-evaluate regular expressions per branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import vocab as V

_BLANKS = " \t\n\r\x0b\x0c"


def first_match(text: Column, pattern: str) -> Column:
    """First match of ``pattern``, null without one; evaluates ``text`` once."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(1))


def clean_text(raw: Column) -> Column:
    """Trimmed text, '' for null, whole numbers without a trailing ``.0``."""
    trimmed = F.btrim(F.coalesce(raw.cast("string"), F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed.endswith(".0"), F.regexp_replace(trimmed, r"^([0-9]+)\.0$", "$1")
                  ).otherwise(trimmed)


def blank_na(cell: Column) -> Column:
    """Null for the cell texts that table readers treat as missing."""
    return F.when(~cell.isin(V.NA_TOKENS), cell)


def phone(raw: Column, strict: bool = False) -> Column:
    c = F.regexp_replace(clean_text(raw), r"[\s\-().]", "")
    c = F.regexp_replace(c, r"^00", "+")
    c = F.regexp_replace(c, r"(?s)^(91.{10})$", "+$1")
    c = F.regexp_replace(c, r"(?s)^([6-9].{9})$", "+91$1")
    c = F.regexp_replace(c, r"(?s)^([2-5].{9})$", "+1$1")
    c = first_match(c, r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$")
    if strict:
        c = first_match(c, r"^\+?[0-9]+$")
    return F.regexp_replace(c, r"(?s)^([^+])", "+$1")


def email(raw: Column) -> Column:
    return F.lower(first_match(clean_text(raw), V.EMAIL_RE))


def imei(raw: Column) -> Column:
    digits = F.regexp_replace(clean_text(raw), r"[^0-9]", "")
    return first_match(digits, r"^[0-9]{14,16}$")


def mac(raw: Column) -> Column:
    return F.upper(F.translate(first_match(clean_text(raw), V.MAC_RE), "-", ":"))


def ipv4(raw: Column) -> Column:
    return first_match(clean_text(raw), V.IPV4_RE)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use in several places of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _quad_tail_to_hex(text: Column) -> Column:
    """Dotted-quad tail of an IPv6 text as two hexadecimal groups."""
    found = F.regexp_extract(text, rf"^[0-9a-f:]*:({V._OCTET}(?:\.{V._OCTET}){{3}})$", 1)

    def rebuilt(quad: Column) -> Column:
        def pair(i: int) -> Column:
            return F.lower(F.hex(F.element_at(quad, i).cast("int") * 256
                                 + F.element_at(quad, i + 1).cast("int")))

        return F.when(F.size(quad) == 4, F.concat(
            F.regexp_extract(text, "^(.*:)", 1), pair(1), F.lit(":"), pair(3))).otherwise(text)

    return _let(F.split(found, r"\."), rebuilt)


def _ipv6(raw_text: Column) -> Column:
    """Compressed lower-case form of an IPv6 text, null if it is not one."""
    group = "[0-9a-f]{1,4}"
    side = f"(?:{group}(?::{group})*+)?+"

    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":"), lambda g: g != "")

    def expanded(halves: Column) -> Column:
        """All eight groups, with the '::' gap filled; null when the count cannot be eight."""
        def joined(sides: Column) -> Column:
            gap = 8 - F.size(sides["l"]) - F.size(sides["r"])
            filled = F.concat(sides["l"], F.array_repeat(F.lit("0"), gap), sides["r"])
            return F.when(F.when(F.size(halves) == 2, gap >= 1).otherwise(gap == 0), filled)

        right = F.when(F.size(halves) == 2, groups(F.element_at(halves, -1))).otherwise(
            F.array().cast("array<string>"))
        return _let(F.struct(groups(F.element_at(halves, 1)).alias("l"), right.alias("r")), joined)

    def canonical(text: Column) -> Column:
        out = F.array_join(F.transform(
            expanded(F.split(text, "::")), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
        # The longest run of zero groups, leftmost first, collapses; later steps then see '::'.
        for run in range(8, 1, -1):
            out = F.regexp_replace(
                out, rf"^(?!.*::)((?:[0-9a-f]+:)*?)0(?::0){{{run - 1}}}((?::[0-9a-f]+)*)$",
                "$1::$2")
        return F.when(text.rlike(f"^{side}(?:::{side})?$"), F.regexp_replace(out, ":{3,}", "::"))

    return _let(_quad_tail_to_hex(F.lower(raw_text)), canonical)


def ip(raw: Column) -> Column:
    """Whole-text IPv6 in canonical form, else the first IPv4 inside the text."""
    text = clean_text(raw)
    # No IPv6 text is longer than 45 characters.
    return F.when(text.contains(":") & (F.length(text) <= 45), F.coalesce(_ipv6(text), ipv4(raw))).otherwise(ipv4(raw))


def account(raw: Column) -> Column:
    text = clean_text(raw)
    plain = F.upper(F.regexp_replace(text, r"[\s\-]", ""))
    return F.when(text.contains("@"), F.lower(text)).otherwise(first_match(plain, r"(?s)^.{4,}$"))


def phone_of_handle(handle: Column, strict: bool = False) -> Column:
    """Phone number used as the user part of a payment handle (``number@bank``)."""
    return F.when(handle.contains("@"), phone(F.substring_index(handle, "@", 1), strict))


def amount(raw: Column) -> Column:
    text = F.regexp_replace(clean_text(raw), r"[₹$,\sINRinrUSDusd]", "")
    number = F.regexp_extract(text, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$", 0)
    return number.try_cast("double")


def event_time(raw: Column) -> Column:
    """Zone-less timestamp from epoch, ISO, slash, dash or month-name text, else null.

    A zone suffix is dropped, not applied; day and month are read month first unless that is
    impossible; all-digit text is epoch seconds, or milliseconds above 10^12.
    """
    # Digits beyond microseconds are dropped; digits anywhere else make the text no time.
    clock = r"(?:[T ]+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6}(?=[0-9]*$))?)?)(?:(?<=\.[0-9]{6})[0-9]*)?)?$"
    ymd = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + clock
    xxy = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})" + clock
    zone = r"(?i)(?<=[0-9])\s*(?:Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})$"
    compact = r"^([0-9]{4})([0-9]{2})([0-9]{2})[T ]([0-9]{2})([0-9]{2})([0-9]{2})$"
    named = [f"{day}{time}" for day in ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy")
             for time in (" HH:mm:ss", " HH:mm", "")]
    half_day = r"(?i)\s*([ap])\.?m\.?$"

    def from_epoch(number: Column) -> Column:
        us = F.when(number > 1_000_000_000_000, number * 1000).otherwise(number * 1_000_000)
        return F.timestamp_add(
            "MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))

    def compose(y: Column, m: Column, d: Column, time: Column) -> Column:
        century = F.when(F.length(y) > 2, F.lit("")).when(y.cast("int") < 69, F.lit("20")).otherwise(F.lit("19"))
        stamp = F.concat_ws("-", F.concat(century, y), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        hms = F.coalesce(F.nullif(time, F.lit("")), F.lit("00:00:00"))
        return F.concat_ws(" ", stamp, hms).try_cast("timestamp_ntz")

    def of_text(t: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.regexp_extract(t, pattern, group)

        def month_first(pair: Column) -> Column:
            swap = pair["a"].cast("int") > 12
            return compose(part(xxy, 3), F.when(swap, pair["b"]).otherwise(pair["a"]),
                           F.when(swap, pair["a"]).otherwise(pair["b"]), part(xxy, 4))

        def by_name(bare: Column) -> Column:
            return F.coalesce(*[
                F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in named])

        return (F.when(t.rlike("^[0-9]{1,17}$"), from_epoch(t.cast("long")))
                .when(t.rlike(ymd), compose(part(ymd, 1), part(ymd, 2), part(ymd, 3), part(ymd, 4)))
                .when(t.rlike(xxy), _let(F.struct(part(xxy, 1).alias("a"), part(xxy, 2).alias("b")),
                                         month_first))
                .when(t.rlike(compact), compose(part(compact, 1), part(compact, 2), part(compact, 3), F.concat_ws(
                    ":", part(compact, 4), part(compact, 5), part(compact, 6))))
                .when(t.rlike("[A-Za-z]{3}"), _let(
                    F.regexp_replace(t, r"^[A-Za-z]{3,9},\s*", ""), by_name)))

    def of_clock(text: Column) -> Column:
        """Twelve-hour clocks: 12 is the first hour of its half day."""
        half = F.lower(F.regexp_extract(text, half_day, 1))
        hour = F.regexp_extract(text, r"([0-9]{1,2}):[0-9]{2}", 1).cast("int")
        shift = F.when((half == "p") & (hour < 12), 12).when((half == "a") & (hour == 12), -12).otherwise(0)
        return F.timestamp_add("HOUR", shift, of_text(F.regexp_replace(text, half_day, "")))

    # Only a text with a clock time can carry a zone or a half day.
    return _let(clean_text(raw), lambda text: F.when(text.rlike("[0-9]:[0-9]"), F.when(
        text.rlike(half_day), _let(text, of_clock)).otherwise(_let(F.regexp_replace(text, zone, ""), of_text))).otherwise(of_text(text)))
