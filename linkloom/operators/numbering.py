"""Dense numbering inside groups of any size.

A plain ``row_number() over (partition by case ...)`` sorts a whole case in one task. Here the rows of all
groups are sorted together in ranges and written once with their place in the sorted part; a group that runs
over several parts is shifted by the row counts of the parts before, so that only counts travel per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.runtime import cut

BUCKET = 1 << 16
SUPER_BUCKET = 1 << 12


def number_within(df: DataFrame, group: list[str], buckets: list[Column], order: list[Column],
                  out: str, start: int | Column = 1) -> DataFrame:
    """Add ``out``: start, start+1, ... within ``group``, by ``buckets`` then ``order``.

    Rows with a null in ``group`` or in a bucket are left out; those with a null bucket still take the first
    numbers. The result is a scan of the written rows joined with few counts, so it needs no further cut.
    """
    begin = F.lit(start) if isinstance(start, int) else start
    known = df.withColumn("__start", begin)
    for g in group:
        known = known.filter(F.col(g).isNotNull())
    keys = [*[F.col(g) for g in group], *buckets, *order]
    # The id counts the rows of a part, with the number of the part in the bits above.
    ordered = cut(known.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = ordered.groupBy(*group, part.alias("__part")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut(parts.select(*group, "__part", (
        F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")))
    numbered = ordered.withColumn("__part", part).join(shift, [*group, "__part"])
    for b in buckets:
        numbered = numbered.filter(b.isNotNull())
    return numbered.withColumn(
        out, (F.col("__at") + F.col("__shift") + F.col("__start")).cast("long")).drop(
        "__part", "__at", "__shift", "__start")


def id_buckets(c: Column) -> list[Column]:
    """Two-level ascending buckets for a dense-ish integer key."""
    return [F.floor(c / (BUCKET * SUPER_BUCKET)), F.floor(c / BUCKET)]
