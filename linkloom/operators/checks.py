"""Referential and range checks over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY, FILE, CASE, RANGE = "entity", "file", "case", "range"


def _present(table: DataFrame, kind: str, scope: Column | None, key: str) -> DataFrame:
    """One row per stored id. A null id is no row to refer to."""
    return table.filter(F.col(key).isNotNull()).select(
        F.lit(kind).alias("kind"), (F.lit(None) if scope is None else scope).cast("long").alias("scope"),
        F.col(key).cast("long").alias("id"), F.lit(None).cast("long").alias("case_id"), F.lit(None).cast("string").alias("violation"))


def _claims(table: DataFrame, *claims: Column) -> DataFrame:
    """What the rows of a table ask for, from one pass over it; null claims ask for nothing."""
    return table.select(F.explode(F.array_compact(F.array(*claims))).alias("c")).select("c.*")


def _refers(kind: str, scope: Column | None, key: str, violation: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if scope is None else scope).cast("long").alias("scope"),
                    F.col(key).cast("long").alias("id"), F.col("case_id").cast("long").alias("case_id"), F.lit(violation).alias("violation"))


def _outside(value: str, low: float, high: float, violation: str) -> Column:
    """A claim on an id that no table holds, for values out of range."""
    return F.when(~F.col(value).between(low, high), F.struct(
        F.lit(RANGE).alias("kind"), F.col("case_id").cast("long").alias("scope"), F.lit(None).cast("long").alias("id"),
        F.col("case_id").cast("long").alias("case_id"), F.lit(violation).alias("violation")))


def violations(entities: DataFrame, links: DataFrame, scores: DataFrame | None = None,
               files: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Counts per case and violated rule; rules of tables that are not given are left out.

    Stored ids and the references to them are one tagged union: references are counted per id, case and rule
    first, so an id that a third of all rows refer to is a few rows when ids and references meet. Every table is read
    once per role, whatever the number of its rules. A null reference is missing; a null value is in range.
    """
    case = F.col("case_id")
    asked = [_refers(ENTITY, case, "entity_a_id", "link_endpoint_a_missing"),
             _refers(ENTITY, case, "entity_b_id", "link_endpoint_b_missing"),
             _outside("confidence_score", 0.0, 1.0, "confidence_out_of_range")]
    if files is not None:
        asked.append(_refers(FILE, None, "source_evidence_file_id", "link_file_missing"))
    parts = [_present(entities, ENTITY, case, "entity_id"), _claims(links, *asked)]
    if scores is not None:
        parts.append(_claims(scores, _refers(ENTITY, case, "entity_id", "score_entity_missing"),
                             _outside("score", 0, 100, "score_out_of_range")))
    if files is not None:
        parts.append(_present(files, FILE, None, "evidence_file_id"))
        if cases is not None:
            parts += [_present(cases, CASE, None, "case_id"), _claims(files, _refers(CASE, None, "case_id", "file_case_missing"))]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    key = ["kind", "scope", "id"]
    counted = union.groupBy(*key, "case_id", "violation").agg(F.count(F.lit(1)).alias("n"))
    held = F.max(F.col("violation").isNull()).over(Window.partitionBy(*key))
    missing = counted.withColumn("held", held).filter(~F.col("held"))
    return missing.groupBy("case_id", "violation").agg(F.sum("n").alias("n"))
