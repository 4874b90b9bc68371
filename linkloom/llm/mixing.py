"""Mixing sources to target weights by a temperature, with DataFrame functions only.

The token share p of every source is raised to an exponent t in [0, 1] and normalised: t = 1 keeps the
natural mix, t = 0 gives every source the same weight. Entropy falls and the largest repetition of a
source falls too as t grows, so both limits are met by bisection: the exponent is the larger of the one
whose entropy is the target and the smallest one that repeats no source more than ``max_repeats`` times.
One pass tests the 63 inner points of a 64-part grid, which is six halvings at once; five passes are 30.

The mix is realised as a plan of document copies. Each source's documents follow each other in a hashed
order that differs from copy to copy, until the source's token quota is used up; that stream is spread
evenly over the blocks, and the copies inside a block stand in another hashed order. No step holds a
source in one task: streams are summed in hash buckets and spans of buckets first, and blocks hold a fixed number of tokens.

Tokens are runs of non-white-space characters, and one end token for every document.

Defined cases: a null source is a source of its own; null and empty texts have the end token only; equal
rows are documents of their own; rows with a null doc_id take part; an empty table gives an empty plan;
other columns are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.runtime import cut

TARGET_ENTROPY = 0.95
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 17
BUCKET_DOCS = 500
SPAN_BUCKETS = 1000
STEPS, PASSES = 6, 5


@dataclass
class Mix:
    exponent: float
    budget: int
    blocks: int
    weights: DataFrame
    """source, tokens, docs, share, weight, quota (tokens), copies (started)"""


def tokens_of(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)) + 1).cast("long")


def _key(copy: Column, salt: str, text_md5: str = "text_md5") -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(text_md5),
                             copy.cast("string"), F.lit(salt)))


def count_tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), tokens_of(F.col("text")).alias("n_tokens"),
                       F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_md5"))


def fit(counted: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
        budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> Mix:
    """Weights of the sources. ``target_entropy`` is a fraction of the largest possible entropy, ``budget``
    a number of tokens (default: as many as there are)."""
    sources = cut(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    total, n = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    budget = total if budget is None else budget
    if budget > total * max_repeats:
        raise ValueError("the budget is larger than all tokens at the repetition limit")
    shares = sources.withColumn("share", F.col("tokens") / F.lit(total).cast("double"))
    log_p = F.log("share")

    def too_flat(points: list[float]) -> list[bool]:
        """Whether entropy is over its target or a repetition over its limit, for ascending exponents."""
        grid = shares.select(log_p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("t"))
        sums = grid.groupBy("t").agg(
            F.sum(F.exp(F.col("t") * F.col("p"))).alias("z"),
            F.sum(F.exp(F.col("t") * F.col("p")) * F.col("p")).alias("zp"),
            F.max(F.exp((F.col("t") - 1) * F.col("p"))).alias("most"))
        entropy = F.log("z") - F.col("t") * F.col("zp") / F.col("z")
        repeats = F.col("most") / F.col("z") * F.lit(budget / total)
        rows = sums.select("t", ((entropy > F.lit(target_entropy) * F.log(F.lit(float(n)))) |
                                 (repeats > F.lit(max_repeats))).alias("over")).collect()
        over = {r["t"]: r["over"] for r in rows}
        return [over[t] for t in points]

    low, width = 0.0, 1.0
    if n > 1 and too_flat([0.0])[0]:
        for _ in range(PASSES):
            width /= 1 << STEPS
            points = [low + k * width for k in range(1, 1 << STEPS)]
            low += width * sum(too_flat(points))
        exponent = low + width
    else:
        exponent = 0.0
    z = F.sum(F.exp(F.lit(exponent) * log_p))
    norm = shares.agg(z.alias("z")).first()["z"]
    weights = shares.withColumn("weight", F.exp(F.lit(exponent) * log_p) / F.lit(norm or 1.0))
    weights = weights.withColumn("quota", F.round(F.col("weight") * F.lit(budget)).cast("long"))
    weights = weights.withColumn("copies", F.ceil(F.col("quota") / F.col("tokens")).cast("int"))
    return Mix(exponent, budget, max(1, -(-budget // block_tokens)), cut(weights))


def plan(counted: DataFrame, mix: Mix, bucket_docs: int = BUCKET_DOCS, span_buckets: int = SPAN_BUCKETS) -> DataFrame:
    """The copies that fill every quota: doc_id, source, text_md5, copy, n_tokens, block, position, key."""
    w = mix.weights.select(F.col("source").alias("of"), F.col("tokens").alias("all_tokens"), "docs", "quota", "copies", "weight")
    copies = counted.join(w, F.col("source").eqNullSafe(F.col("of"))).filter("copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copies = copies.withColumn("key", _key(F.col("copy"), "stream"))
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    parts = F.floor(F.col("docs") / bucket_docs) + 1
    copies = copies.withColumn("bucket", F.shiftright(spread * parts, 32))
    stream = ["source", "copy", "bucket"]
    # Tokens before each bucket: inside a span of buckets, and before the span, so that no window holds a source's buckets.
    span = F.expr(f"bucket div {span_buckets}").alias("span")
    sums = cut(copies.groupBy(*stream).agg(F.sum("n_tokens").alias("here")).select(*stream, span, "here"))
    before = Window.partitionBy("source").orderBy("copy", "span").rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.groupBy("source", "copy", "span").agg(F.sum("here").alias("here")).select(
        F.col("source").alias("p_source"), F.col("copy").alias("p_copy"), F.col("span").alias("p_span"),
        F.coalesce(F.sum("here").over(before), F.lit(0)).alias("past"))
    near = Window.partitionBy("source", "copy", "span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("near", F.coalesce(F.sum("here").over(near), F.lit(0)))
    sums = sums.join(spans, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("copy") == F.col("p_copy")) & (F.col("span") == F.col("p_span")))
    sums = sums.select(*(F.col(c).alias(f"s_{c}") for c in stream), (F.col("near") + F.col("past")).alias("shift"))
    inside = Window.partitionBy(*stream).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("copy") == F.col("s_copy"))
                         & (F.col("bucket") == F.col("s_bucket")))
    placed = placed.withColumn("start", F.col("inside") + F.col("shift"))
    placed = placed.filter(F.col("start") + F.col("n_tokens") <= F.col("quota"))
    placed = placed.withColumn("block", F.expr(f"start * {mix.blocks} div quota"))
    order = Window.partitionBy("block").orderBy(_key(F.col("copy"), "block"), "n_tokens", "source")
    return placed.withColumn("position", F.row_number().over(order) - 1).select(
        "doc_id", "source", "text_md5", "copy", "n_tokens", "block", F.col("position").cast("long"), "key", "weight")


def mix(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with every document as often as the plan holds it, all columns unchanged.

    All copies before a source's last one are whole. Of the last one, the documents up to the last kept
    key stay, so that texts need no shuffle: each row only looks up its source.
    """
    counted = cut(count_tokens(docs))
    fitted = fit(counted, **limits)
    kept = plan(counted, fitted).select("source", "copy", "key")
    last = Window.partitionBy("source")
    ends = kept.groupBy("source", "copy").agg(F.max("key").alias("key"))
    ends = ends.withColumn("final", F.max("copy").over(last)).filter(F.col("copy") == F.col("final"))
    ends = cut(ends.select(F.col("source").alias("__of"), F.col("final").alias("__final"), F.col("key").alias("__end")))
    names = docs.columns
    rows = docs.withColumn("__md5", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.join(ends, rows["source"].cast("string").eqNullSafe(F.col("__of")))
    times = F.col("__final") + (_key(F.col("__final"), "stream", "__md5") <= F.col("__end")).cast("int")
    rows = rows.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array())))
    return rows.select(*names)


ORACLE_SQL = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) + 1 AS n_tokens FROM documents),
sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM counted GROUP BY source),
totals AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM sources),
shares AS (SELECT source, tokens, tokens / CAST(total AS DOUBLE) AS share, total, n FROM sources, totals),
points AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT step + 1, (low + high) / 2, low, high FROM (
    SELECT p.step,
      CASE WHEN p.step = 0 THEN 0 WHEN judged.over THEN p.t ELSE p.low END AS low,
      CASE WHEN p.step = 0 THEN CASE WHEN judged.over THEN 1 ELSE 0 END
           WHEN judged.over THEN p.high ELSE p.t END AS high
    FROM points p, LATERAL (
      SELECT ln(sum(exp(p.t * ln(share)))) - p.t * sum(exp(p.t * ln(share)) * ln(share)) / sum(exp(p.t * ln(share)))
               > {TARGET_ENTROPY} * ln(max(n))
          OR max(exp((p.t - 1) * ln(share))) / sum(exp(p.t * ln(share))) > {MAX_REPEATS} AS over FROM shares) judged
    WHERE p.step <= {STEPS * PASSES}) AS halved),
fitted AS (SELECT high AS exponent FROM points WHERE step = {STEPS * PASSES + 1}),
weights AS (SELECT source, tokens, total, exp(exponent * ln(share)) / sum(exp(exponent * ln(share))) OVER () AS weight
  FROM shares, fitted),
quotas AS (SELECT *, CAST(round(weight * total) AS BIGINT) AS quota FROM weights),
copies AS (SELECT c.*, q.quota, q.weight, q.total, r.copy,
    md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), text_md5, r.copy, 'stream')) AS key
  FROM counted c JOIN quotas q ON c.source IS NOT DISTINCT FROM q.source
  JOIN (SELECT unnest(range(0, 64)) AS copy) r ON r.copy < ceil(q.quota / CAST(q.tokens AS DOUBLE))),
streams AS (SELECT *, coalesce(CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY copy, key, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM copies),
placed AS (SELECT *, start * greatest(1, (total + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) // quota AS block
  FROM streams WHERE start + n_tokens <= quota)
SELECT doc_id, source, copy, n_tokens, block, round(weight, 9) AS weight,
  row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), text_md5, copy,
    'block')), n_tokens, source) - 1 AS position
FROM placed
"""
