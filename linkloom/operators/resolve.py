"""Entity and link resolution per case, against an optional stored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from linkloom.operators.numbering import number_within
from linkloom.runtime import cut

ENTITY_KEY = ["case_id", "entity_type", "value"]
PAIR_KEY = ["case_id", "a_type", "a_value", "b_type", "b_value", "link_type"]


# The kinds of places inside a record for which an order of appearance is written as one number.
MOST_PLACES = 64


def _numbered_arrival(rows: DataFrame, place: list[str]) -> tuple[Column, Callable[[Column], dict[str, Column]]] | None:
    """The order by ``evidence_file_id``, ``rec_no`` and ``place`` as one long, and how to read these columns out of it.

    The least number of a key is found by hashing, where the least structure needs all rows sorted by key. The numbers
    count through the ranges in which the values lie, which one pass over ``rows`` finds. None where they do not
    fit into a long, a value is null or there are more than ``MOST_PLACES`` kinds of places.
    """
    ids = ["evidence_file_id", "rec_no"]
    if not all(isinstance(rows.schema[c].dataType, IntegralType) for c in ids):
        return None
    ends = [f(c).alias(f"{n}_{c}") for c in ids for f, n in ((F.min, "lo"), (F.max, "hi"))]
    kinds = rows.groupBy(*place).agg(*ends, F.count_if(F.col(ids[0]).isNull() | F.col(ids[1]).isNull()).alias("nulls")).limit(
        MOST_PLACES + 1).collect()
    if not kinds or len(kinds) > MOST_PLACES or any(
            k["nulls"] or any(k[c] is None or k[c] != k[c] for c in place) for k in kinds):
        return None
    kinds = sorted(kinds, key=lambda k: [k[c] for c in place])
    lo = {c: min(k[f"lo_{c}"] for k in kinds) for c in ids}
    span = {c: max(k[f"hi_{c}"] for k in kinds) - lo[c] + 1 for c in ids}
    if span[ids[0]] * span[ids[1]] * len(kinds) >= 1 << 63 or any(x >= 1 << 62 for x in (*span.values(), *map(abs, lo.values()))):
        return None
    kind = F
    for n, k in enumerate(kinds):
        same = F.lit(True)
        for c in place:
            same = same & (F.col(c) == F.lit(k[c]).cast(rows.schema[c].dataType))
        kind = kind.when(same, F.lit(n).cast("long"))
    first, second = (F.col(c).cast("long") - F.lit(lo[c]).cast("long") for c in ids)
    number = (first * F.lit(span[ids[1]]).cast("long") + second) * F.lit(len(kinds)).cast("long") + kind

    def read(at: Column) -> dict[str, Column]:
        def part(x: Column, by: int, keep: bool) -> Column:
            by = F.lit(by).cast("long")
            return F.call_function("mod", x, by) if keep else F.call_function("div", x, by)

        record = part(at, len(kinds), False)
        out = {ids[0]: part(record, span[ids[1]], False) + F.lit(lo[ids[0]]).cast("long"),
               ids[1]: part(record, span[ids[1]], True) + F.lit(lo[ids[1]]).cast("long")}
        no = part(at, len(kinds), True)
        for c in place:
            value = F
            for n, k in enumerate(kinds):
                value = value.when(no == n, F.lit(k[c]))
            out[c] = value
        return {c: v.cast(rows.schema[c].dataType) for c, v in out.items()}

    return number, read


def first_mentions(mentions: DataFrame) -> DataFrame:
    """One row per (case, type, value) with its first appearance and earliest event time."""
    parts = ["evidence_file_id", "rec_no", "pos"]
    seen = F.min("event_ts").alias("first_seen_at")
    numbered = _numbered_arrival(mentions, ["pos"])
    if numbered is None:
        return mentions.groupBy(*ENTITY_KEY).agg(F.min(F.struct(*parts)).alias("arrival"), seen)
    number, read = numbered
    place = read(F.col("__at"))
    return mentions.groupBy(*ENTITY_KEY).agg(F.min(number).alias("__at"), seen).select(
        *ENTITY_KEY, F.struct(*[place[c].alias(c) for c in parts]).alias("arrival"), "first_seen_at")


def earlier_sightings(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored entities that a batch shows at an earlier time than the stored one."""
    seen = first_mentions(mentions).select(*ENTITY_KEY, F.col("first_seen_at").alias("__seen"))
    late = F.col("first_seen_at").isNull() | (F.col("__seen") < F.col("first_seen_at"))
    return stored.join(seen.filter("__seen IS NOT NULL"), ENTITY_KEY).filter(late).select(
        "case_id", "entity_id", F.col("__seen").alias("first_seen_at"))


def _next_ids(df: DataFrame, stored: DataFrame | None, id_col: str,
              buckets: list[Column], order: list[Column]) -> DataFrame:
    if stored is None:
        return number_within(df, ["case_id"], buckets, order, id_col)
    last = stored.groupBy("case_id").agg(F.max(id_col).alias("__last"))
    based = df.join(last, "case_id", "left")
    return number_within(based, ["case_id"], buckets, order, id_col,
                         F.coalesce(F.col("__last"), F.lit(0)) + 1).drop("__last")


def resolve_entities(mentions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New entities of a batch: deduplicated, absent from ``stored``, numbered by appearance."""
    new = first_mentions(mentions)
    if stored is not None:
        new = new.join(stored.select(*ENTITY_KEY), ENTITY_KEY, "left_anti")
    new = cut(new)
    numbered = _next_ids(
        new, stored, "entity_id", [F.col("arrival.evidence_file_id")],
        [F.col("arrival"), F.col("entity_type"), F.col("value")])
    return numbered.select(
        "case_id", "entity_id", "entity_type", "value", "first_seen_at",
        F.col("arrival.evidence_file_id").alias("first_file_id"))


def first_links(links: DataFrame, scope: str = "case") -> DataFrame:
    """One row per unordered pair and link type; the first emitted reference decides.

    ``scope='evidence'`` keeps one link per evidence file, so that repeated weak observations
    corroborate each other when the graph is weighed.
    """
    def end(side: str) -> Column:
        return F.struct(F.col(f"{side}_type").alias("t"), F.col(f"{side}_value").alias("v"))

    rest = ["link_type", "confidence", "evidence_file_id", "rec_no", "pos"]
    flat = links.filter(end("a") != end("b")).select(
        "case_id", F.least(end("a"), end("b")).alias("lo"),
        F.greatest(end("a"), end("b")).alias("hi"), *rest
    ).select(
        "case_id", F.col("lo.t").alias("a_type"), F.col("lo.v").alias("a_value"),
        F.col("hi.t").alias("b_type"), F.col("hi.v").alias("b_value"), *rest)
    keys = PAIR_KEY + (["evidence_file_id"] if scope == "evidence" else [])
    parts = ["evidence_file_id", "rec_no", "pos", "confidence"]
    numbered = _numbered_arrival(links, ["pos", "confidence"])
    if numbered is None:
        return flat.groupBy(*keys).agg(F.min(F.struct(*parts)).alias("arrival")).select(*PAIR_KEY, "arrival")
    number, read = numbered
    place = read(F.col("__at"))
    return flat.groupBy(*keys).agg(F.min(number).alias("__at")).select(
        *PAIR_KEY, F.struct(*[place[c].alias(c) for c in parts]).alias("arrival"))


def resolve_links(links: DataFrame, entities: DataFrame, stored: DataFrame | None = None,
                  scope: str = "case") -> DataFrame:
    """New links of a batch as (smaller id, larger id) rows numbered by appearance."""
    named = first_links(links, scope)
    ids = entities.select(*ENTITY_KEY, "entity_id")
    left = ids.toDF("case_id", "a_type", "a_value", "id_a")
    right = ids.toDF("case_id", "b_type", "b_value", "id_b")
    new = named.join(left, ["case_id", "a_type", "a_value"]).join(
        right, ["case_id", "b_type", "b_value"]).select(
        "case_id", F.least("id_a", "id_b").alias("entity_a_id"),
        F.greatest("id_a", "id_b").alias("entity_b_id"), "link_type",
        F.col("arrival.confidence").alias("confidence_score"),
        F.col("arrival.evidence_file_id").alias("source_evidence_file_id"),
        F.col("arrival.rec_no").alias("rec_no"), F.col("arrival.pos").alias("pos"))
    if stored is not None:
        keys = ["case_id", "entity_a_id", "entity_b_id", "link_type"]
        if scope == "evidence":
            keys = keys + ["source_evidence_file_id"]
        new = new.join(stored.select(*keys), keys, "left_anti")
    new = cut(new)
    numbered = _next_ids(
        new, stored, "link_id", [F.col("source_evidence_file_id")],
        [F.col(c) for c in ("rec_no", "pos", "entity_a_id", "entity_b_id", "link_type")])
    return numbered.select(
        "case_id", "link_id", "entity_a_id", "entity_b_id", "link_type", "confidence_score",
        "source_evidence_file_id")


def resolve(evidence: tuple[DataFrame, DataFrame], scope: str = "case"
            ) -> tuple[DataFrame, DataFrame]:
    """Entity and link tables of a fresh set of cases."""
    mentions, links = evidence
    entities = resolve_entities(mentions)
    return entities, resolve_links(links, entities, scope=scope)


def created_per_file(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities and links counted for the file in which they first appeared."""
    made = entities.select("case_id", F.col("first_file_id").alias("evidence_file_id"),
                           F.lit(1).alias("e"), F.lit(0).alias("l")).unionByName(
        links.select("case_id", F.col("source_evidence_file_id").alias("evidence_file_id"),
                     F.lit(0).alias("e"), F.lit(1).alias("l")))
    return made.groupBy("case_id", "evidence_file_id").agg(
        F.sum("e").alias("entities_created"), F.sum("l").alias("links_created"))


def lookup(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Case-scoped lookup: the same value in two cases is two entities."""
    return wanted.join(entities, ENTITY_KEY)


def ingestion_summary(files: DataFrame, row_outcomes: DataFrame, entities: DataFrame,
                      links: DataFrame) -> DataFrame:
    """Per-file counts. ``row_outcomes``: evidence_file_id, row_no, skipped_reason (null = used).

    The skip messages themselves stay rows (``skipped_rows``): a file may have as many of them
    as it has rows, so they are never gathered into one value.
    """
    skipped = F.col("skipped_reason").isNotNull()
    rows = row_outcomes.groupBy("evidence_file_id").agg(
        F.count_if(~skipped).alias("rows_processed"), F.count_if(skipped).alias("rows_skipped"))
    made = created_per_file(entities, links).drop("case_id")
    counts = ("rows_processed", "rows_skipped", "entities_created", "links_created")
    return files.select("case_id", "evidence_file_id").join(rows, "evidence_file_id", "left").join(
        made, "evidence_file_id", "left").select(
        "case_id", "evidence_file_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def skipped_rows(row_outcomes: DataFrame) -> DataFrame:
    return row_outcomes.filter(F.col("skipped_reason").isNotNull())
