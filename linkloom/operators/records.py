"""Link generation: normalized role columns -> records, mentions and link candidates.

``records`` is the full parser output (a root entity with its ordered references). The two flat
forms feed entity resolution: ``mentions`` in the order in which a row names its entities, and
``link candidates`` in emission order with mirrored repeats left out, since a mirrored reference
always carries the type of an earlier one and the first one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import vocab as V

KEYS = ["case_id", "evidence_file_id", "rec_no"]


def _ref(role: str, types: dict, link_type: str, confidence: float) -> Column:
    return F.when(F.col(role).isNotNull(), F.struct(
        F.lit(types[role]).alias("entity_type"), F.col(role).alias("value"),
        F.lit(link_type).alias("link_type"), F.lit(confidence).alias("confidence")))


def with_records(df: DataFrame, rules: dict, types: dict) -> DataFrame:
    """Add ``records``: array of (entity_type, value, linked array) in parser order."""
    roots = [
        F.when(F.col(root).isNotNull(), F.struct(
            F.lit(types[root]).alias("entity_type"), F.col(root).alias("value"),
            F.array_compact(F.array(*[_ref(t, types, lt, c) for t, lt, c in refs])).alias("linked")))
        for root, refs in rules.items()
    ]
    return df.withColumn("records", F.array_compact(F.array(*roots)))


def refs_of(df: DataFrame) -> DataFrame:
    """Flatten ``records`` to one row per reference; a root without any keeps ``ref_no`` -1.

    Rows without records are dropped after the explode: dropped before it, by a filter on the array that the
    optimizer would infer and push down, all of its expressions would be evaluated once more per use.
    """
    roots = df.select(*KEYS, "event_ts", F.posexplode_outer("records").alias("root_no", "r")).filter("root_no IS NOT NULL")
    return roots.select(
        *KEYS, "event_ts", "root_no", F.col("r.entity_type").alias("root_type"),
        F.col("r.value").alias("root_value"), F.posexplode_outer("r.linked").alias("ref_no", "l")
    ).select(
        *KEYS, "event_ts", "root_no", F.coalesce("ref_no", F.lit(-1)).alias("ref_no"),
        "root_type", "root_value", F.col("l.entity_type").alias("target_type"),
        F.col("l.value").alias("target_value"), "l.link_type", "l.confidence")


def _mention_plan(rules: dict) -> list[tuple[str, frozenset]]:
    """Roles in naming order with the roles that must be present, minus implied repeats."""
    plan: list[tuple[str, frozenset]] = []
    for root, refs in rules.items():
        for role, needs in [(root, frozenset([root]))] + [
                (t, frozenset([root, t])) for t, _, _ in refs]:
            if not any(r == role and n <= needs for r, n in plan):
                plan.append((role, needs))
    return plan


def _exploded(df: DataFrame, keep: list[str], items: list[tuple[Column, list[Column]]]) -> DataFrame:
    """One row per item whose condition holds: ``keep``, its place ``pos`` among those that hold, its columns.

    Conditions are worked out once per row. Items that do not hold are dropped after the explode, since taking
    them out of the array first costs an interpreted call per element.
    """
    flags = [f"__is_{i}" for i in range(len(items))]
    flagged = df.withColumns({f: holds for f, (holds, _) in zip(flags, items)})
    listed, before = [], F.lit(0)
    for f, (_, columns) in zip(flags, items):
        listed.append(F.when(F.col(f), F.struct(before.alias("pos"), *columns)))
        before = before + F.col(f).cast("int")
    return flagged.select(*keep, F.explode(F.array(*listed)).alias("m")).filter("m IS NOT NULL").select(*keep, "m.*")


def _all_present(roles: frozenset) -> Column:
    present = F.lit(True)
    for r in sorted(roles):
        present = present & F.col(r).isNotNull()
    return present


def mentions_of(df: DataFrame, rules: dict, types: dict) -> DataFrame:
    """A role is named once per row: not again where an earlier place names the same type and value."""
    items, earlier = [], []
    for role, needs in _mention_plan(rules):
        present = _all_present(needs)
        new = present
        for r, p in earlier:
            if types[r] == types[role]:
                new = new & ~(p if r == role else p & (F.col(r) == F.col(role)))
        items.append((new, [F.lit(types[role]).alias("entity_type"), F.col(role).alias("value")]))
        earlier.append((role, present))
    return _exploded(df, [*KEYS, "event_ts"], items).select(
        *KEYS, "pos", "entity_type", "value", "event_ts")


def links_of(df: DataFrame, rules: dict, types: dict) -> DataFrame:
    seen: set = set()
    items = []
    for root, refs in rules.items():
        for target, link_type, confidence in refs:
            pair = (frozenset([root, target]), link_type)
            if pair in seen:
                continue
            seen.add(pair)
            items.append((_all_present(frozenset([root, target])), [
                F.lit(types[root]).alias("a_type"), F.col(root).alias("a_value"),
                F.lit(types[target]).alias("b_type"), F.col(target).alias("b_value"),
                F.lit(link_type).alias("link_type"), F.lit(confidence).alias("confidence")]))
    return _exploded(df, KEYS, items)


def call_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (mentions_of(rows, V.CALL_RULES, V.CALL_ROLE_TYPES),
            links_of(rows, V.CALL_RULES, V.CALL_ROLE_TYPES))


def ledger_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (mentions_of(rows, V.LEDGER_RULES, V.LEDGER_ROLE_TYPES),
            links_of(rows, V.LEDGER_RULES, V.LEDGER_ROLE_TYPES))


def mail_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``sender`` and arrays ``recipients`` and ``hops`` (one row per message)."""
    def as_entity(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("value"))

    sender = F.transform(F.array_compact(F.array("sender")), as_entity(V.EMAIL))
    listed = F.array_distinct(F.concat(
        sender, F.transform("recipients", as_entity(V.EMAIL)),
        F.transform("hops", as_entity(V.IP))))
    mentions = rows.select(*KEYS, "event_ts", F.posexplode(listed).alias("pos", "m")).select(
        *KEYS, "pos", "m.entity_type", "m.value", "event_ts")

    def as_link(kind: str, link_type: str, confidence: float):
        return lambda v: F.struct(
            F.lit(V.EMAIL).alias("a_type"), F.col("sender").alias("a_value"),
            F.lit(kind).alias("b_type"), v.alias("b_value"),
            F.lit(link_type).alias("link_type"), F.lit(confidence).alias("confidence"))

    pairs = F.concat(F.transform("recipients", as_link(V.EMAIL, *V.MAIL_RECIPIENT)),
                     F.transform("hops", as_link(V.IP, *V.MAIL_HOP)))
    links = rows.filter("sender IS NOT NULL").select(
        *KEYS, F.posexplode(pairs).alias("pos", "l")).select(*KEYS, "pos", "l.*")
    return mentions, links


def device_evidence(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct identifiers per dump (``case_id, evidence_file_id, entity_type, value``).

    Every linkable pair inside a dump is a result row. The pairs come from an equality join on
    the dump id per type combination, which adaptive skew handling can split for a huge dump.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in V.DEVICE_TYPE_ORDER]), F.col("entity_type"))
    mentions = found.select(
        "case_id", "evidence_file_id", rank.cast("long").alias("rec_no"), F.lit(0).alias("pos"),
        "entity_type", "value", F.lit(None).cast("timestamp_ntz").alias("event_ts"))

    # First-emitted reference per unordered type pair and link type.
    combos: dict[tuple[str, str], list] = {}
    seen: set = set()
    for no, (root, refs) in enumerate(V.DEVICE_RULES.items()):
        for target, link_type, confidence in refs:
            pair = tuple(sorted([root, target], key=V.DEVICE_TYPE_ORDER.index))
            if (pair, link_type) not in seen:
                seen.add((pair, link_type))
                combos.setdefault(pair, []).append((no, link_type, confidence))
    keys = ["case_id", "evidence_file_id"]
    parts = []
    for (left, right), rules in combos.items():
        a = found.filter(F.col("entity_type") == left).select(*keys, F.col("value").alias("a_value"))
        b = found.filter(F.col("entity_type") == right).select(*keys, F.col("value").alias("b_value"))
        rule_rows = F.array(*[F.struct(
            F.lit(no).cast("long").alias("rec_no"), F.lit(lt).alias("link_type"),
            F.lit(c).alias("confidence")) for no, lt, c in rules])
        parts.append(a.join(b, keys).select(
            *keys, "a_value", "b_value", F.inline(rule_rows)).select(
            *keys, "rec_no", F.lit(0).alias("pos"), F.lit(left).alias("a_type"), "a_value",
            F.lit(right).alias("b_type"), "b_value", "link_type", "confidence"))
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    return mentions, links
