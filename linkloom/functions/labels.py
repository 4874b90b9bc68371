"""Constant lookups and bands: link weights, labels, tiers, reason texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import vocab as V


def _lookup(key: Column, table: dict, default: Column) -> Column:
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), table.items(), F)
    return out.otherwise(default)


def _band(x: Column, bands: list, lowest: str) -> Column:
    out = reduce(lambda acc, b: acc.when(x >= b[0], F.lit(b[1])), bands, F)
    return out.otherwise(F.lit(lowest))


def link_weight(link_type: Column) -> Column:
    return _lookup(F.lower(link_type), V.LINK_WEIGHTS, F.lit(V.DEFAULT_LINK_WEIGHT))


def confidence_label(confidence: Column) -> Column:
    return _band(confidence, V.CONFIDENCE_BANDS, V.LOWEST_CONFIDENCE_BAND)


def score_tier(score: Column) -> Column:
    return _band(score, V.SCORE_TIERS, V.LOWEST_SCORE_TIER)


def severity_band(score: Column) -> Column:
    return _band(score, V.SEVERITY_BANDS, V.LOWEST_SEVERITY_BAND)


def plain_reason(code: Column) -> Column:
    return _lookup(code, V.PLAIN_REASONS, F.lower(F.translate(code, "_", " ")))


def reason_weight(code: Column) -> Column:
    return _lookup(code, V.REASON_WEIGHTS, F.lit(0))


def advice(score: Column) -> Column:
    return F.when(score > 0, F.lit(V.REVIEW_ADVICE)).otherwise(F.lit(V.LOW_RISK_ADVICE))


def source_of_filename(name: Column) -> Column:
    """Guess the evidence source from a file name; earlier rules win."""
    low = F.lower(name)

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(w) for w in words])

    return (
        F.when(low.endswith(".eml") | has("email", "mail"), F.lit("email"))
        .when(has("bank", "upi", "transaction", "ledger"), F.lit("bank_upi"))
        .when(has("ipdr"), F.lit("ipdr"))
        .when(has("android", "log") | low.endswith(".txt") | low.endswith(".log"),
              F.lit("android_log"))
        .otherwise(F.lit("cdr")))
