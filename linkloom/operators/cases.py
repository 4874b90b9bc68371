"""Case envelopes: create, find, list and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import vocab as V
from linkloom.operators.numbering import SUPER_BUCKET, number_within


def create_cases(stored: DataFrame, wanted: DataFrame, created_at: Column) -> DataFrame:
    """New case rows for ``wanted`` (name, status), numbered after the stored ones."""
    last = stored.agg(F.coalesce(F.max("case_id"), F.lit(0))).scalar()
    status = F.when(F.col("status").isin(V.CASE_STATUSES), F.col("status")).otherwise(
        F.lit(V.CASE_STATUSES[0]))
    rows = wanted.withColumns({"__all": F.lit(0), "__last": last})
    return number_within(rows, ["__all"], [F.pmod(F.xxhash64("name"), F.lit(SUPER_BUCKET))],
                         [F.col("name")], "case_id", F.col("__last") + 1).select(
        "case_id", "name", created_at.alias("created_at"), status.alias("status"))


def get_case(stored: DataFrame, case_id: int) -> DataFrame:
    return stored.filter(F.col("case_id") == case_id)


def list_cases(stored: DataFrame) -> DataFrame:
    """Newest case first."""
    return stored.orderBy(F.desc("case_id"))


def seed_cases(stored: DataFrame, wanted: DataFrame, created_at: Column) -> DataFrame:
    """Only those wanted cases whose name is not stored yet."""
    return create_cases(stored, wanted.join(stored.select("name"), "name", "left_anti"), created_at)
