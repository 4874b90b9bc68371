"""Phrase collocations per language by best-first branch and bound over phrase prefixes.

Score of a phrase with a = f(phrase): the least over its cuts of floor(1000 a n / (l r)), l and r the counts
of the parts. r >= a, so no phrase scores more than floor(1000 n / f(its first word)), whatever follows:
the counts of a prefix bound the scores of all that grows from it, and the rarest frequent first words have
the highest bounds. Prefixes are grown in waves, best bounds first; a wave takes those whose occurrences
reach the next share of ``SHARES``, grows them word by word up to five words (a phrase that is too rare grows
no further), counts the parts that its phrases are scored by, and settles scores and survivors. Each
language's ``TOP``-th surviving score then drops every prefix whose bound is below it from later waves; equal
bounds stay, so ties are settled too. Nothing is estimated: bounds only leave out what cannot be listed.

A phrase does not survive if a longer candidate holds it and is as frequent. That is so exactly if all its
occurrences have the same word before or the same word after them inside their piece, which is counted
with the occurrences, so survival needs no look at phrases of other prefixes.

The corpus is read twice: to count words, and to be written once as numbers. A word's number is a 64-bit
hash; that no other word of the language has the number of a frequent one is checked over all words, with
another salt if one has. Words that are not frequent only separate. Tasks find the phrases to grow through
bitmaps of a fixed number of bits: a wrong hit costs a row, which the exact join after the count removes.

Words and pieces: A-Z in lower case, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+``. Defined
cases: a null text has no words; a null lang is ``und``; repeated rows and rows without an id count like any
others; other columns are ignored; languages without candidates have no rows; an empty table gives an empty
result. Counts are 64-bit, products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.texts import slices
from linkloom.runtime import cut

LEAST, LONGEST, TOP = 100, 5, 2000
SHARES = (0.25, 0.5, 1.0)
FILTER_BITS = 25
"""binary logarithm of the bits of a bitmap"""
SLICE_BYTES = 8 << 20
PARTS = 64
"""parts of a language whose best rows are found apart before they meet"""
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
KEY = ["lang", "m", *WORDS]
LOWER = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b"\n" * 10)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Language, words and piece bounds of the texts of every language of a batch."""
    for part in slices(batch, limit=SLICE_BYTES):
        langs = part.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = part.column("text").filter(pc.equal(langs.indices, k)).drop_null().to_pylist()
            pieces = "\n".join(texts).encode().translate(LOWER).split(b"\n")
            split = pc.ascii_split_whitespace(pa.array(pieces, pa.large_binary()).cast(pa.large_string()))
            words, ends = split.flatten(), split.offsets.to_numpy()
            some = pc.greater(pc.binary_length(words), 0)
            before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
            yield lang, words.filter(some), before[ends - ends[0]]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    def run(batches):
        for batch in batches:
            for lang, words, _ in _pieces(batch):
                counted = words.value_counts()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), counted.field("values").cast(pa.string()),
                                                  counted.field("counts")], names=["lang", "word", "f"])

    return _source(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def number_words(words: DataFrame, least: int = LEAST) -> tuple[DataFrame, str]:
    """Frequent words with numbers (lang, word, f, id) and the salt under which the numbers are unique."""
    for salt in map(str, range(100)):
        numbered = words.withColumn("id", F.xxhash64(F.concat(F.lit(salt), "word")))
        shared = numbered.groupBy("lang", "id").agg(F.count(F.lit(1)).alias("words"), F.max("f").alias("f"))
        if shared.filter((F.col("f") >= least) & ((F.col("words") > 1) | (F.col("id") == 0))).isEmpty():
            return cut(numbered.filter(F.col("f") >= least)), salt
    raise ValueError("no salt numbers the words uniquely")


def _hash(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases given as their first words, second words, ..."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(f"{len(words)} {lang}"), np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


class Bitmap:
    """Phrases that may be in a set, in ``2**FILTER_BITS`` bits whatever the size of the set."""

    def __init__(self, phrases: DataFrame):
        def run(batches):
            for batch in batches:
                found = [np.empty(0, np.int64)]
                sizes = batch.column("m").to_numpy()
                langs = batch.column("lang").dictionary_encode()
                numbers = langs.indices.to_numpy()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    for m in np.unique(sizes[numbers == k]).tolist():
                        rows = np.flatnonzero((numbers == k) & (sizes == m))
                        found += _bits(_hash(lang, [batch.column(w).to_numpy()[rows] for w in WORDS[:m]]))
                bits = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], names=["at", "word"])

        marks = phrases.select(*KEY).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
        set_ = marks.toPandas()
        words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        words[set_["at"].to_numpy(np.int64)] = set_["word"].to_numpy(np.int64)
        self.shared = phrases.sparkSession.sparkContext.broadcast(words)

    def __getstate__(self):
        return {"shared": self.shared}

    def has(self, lang: str, words: list[np.ndarray]) -> np.ndarray:
        a, b = _bits(_hash(lang, words))
        marks = self.shared.value
        return ((marks[a >> 6] >> (a & 63)) & (marks[b >> 6] >> (b & 63)) & 1).astype(bool)


def encode(docs: DataFrame, frequent: Bitmap, salt: str) -> DataFrame:
    """The corpus as numbers: one row per slice and language with ``ids`` (the numbers of its words that may be
    frequent, 64-bit) and ``codes``, positions in ``ids`` from 1, and 0 where pieces end or other words stand."""
    def run(batches):
        for batch in batches:
            for lang, words, ends in _pieces(batch):
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                ids = np.array([xxhash.xxh64_intdigest(salt + w, 42) for w in coded.dictionary.to_pylist()], np.uint64).view(np.int64)
                may = frequent.has(lang, [ids]) & (ids != 0)
                code = np.where(may, np.cumsum(may), 0)[coded.indices.to_numpy()]
                # A zero before every piece; then runs of zeros become one.
                stream = np.insert(code, ends[:-1], 0)
                stays = (stream != 0) | (np.append(1, stream[:-1]) != 0)
                narrow = may.sum() < 1 << 16
                yield pa.RecordBatch.from_pydict({"lang": [lang], "narrow": [bool(narrow)], "ids": [ids[may].tobytes()],
                                                  "codes": [np.append(stream[stays], 0).astype(np.uint16 if narrow else np.uint32).tobytes()]},
                                                 schema=pa.schema([("lang", pa.string()), ("narrow", pa.bool_()), ("ids", pa.binary()), ("codes", pa.binary())]))

    return _source(docs).mapInArrow(run, "lang string, narrow boolean, ids binary, codes binary")


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, codes, numbers): ``numbers[code]`` is the number of a word, 0 for a gap."""
    for row in range(batch.num_rows):
        codes = np.frombuffer(batch.column("codes")[row].as_buffer(), np.uint16 if batch.column("narrow")[row].as_py() else np.uint32)
        ids = np.frombuffer(batch.column("ids")[row].as_buffer(), np.int64)
        yield batch.column("lang")[row].as_py(), codes.astype(np.int64), np.append(np.int64(0), ids)


def _phrases_at(codes: np.ndarray, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the distinct phrase of ``m`` words at each place, and one place of each."""
    name, first = np.unique(codes[at], return_inverse=True)[1], None
    for k in range(1, m):
        _, first, name = np.unique(name * (codes.max() + 1) + codes[at + k], return_index=True, return_inverse=True)
    return name, first


def _places(codes: np.ndarray, m: int) -> np.ndarray:
    """Places at which ``m`` words follow one another without a gap."""
    n = len(codes) - m + 1
    fine = np.ones(max(n, 0), bool)
    for k in range(m if n > 0 else 0):
        fine &= codes[k:k + n] != 0
    return np.flatnonzero(fine)


def count_grown(stream: DataFrame, m: int, prefixes: Bitmap, least: int = LEAST) -> DataFrame:
    """(lang, m, w1..w5, f) of the frequent phrases of ``m`` words that grow from given ones of ``m - 1``."""
    words = WORDS[:m]

    def run(batches):
        for batch in batches:
            for lang, codes, numbers in _streams(batch):
                at = _places(codes, m)
                if m == 2:
                    at = at[prefixes.has(lang, [numbers])[codes[at]]]
                else:
                    at = at[prefixes.has(lang, [numbers[codes[at + k]] for k in range(m - 1)])]
                if not len(at):
                    continue
                name, first = _phrases_at(codes, at, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(first), pa.string()), *[pa.array(numbers[codes[at[first] + k]]) for k in range(m)],
                     pa.array(np.bincount(name, minlength=len(first)))], names=["lang", *words, "f"])

    schema = ", ".join(["lang string", *[f"{w} long" for w in words], "f long"])
    counted = stream.select("lang", "narrow", "ids", "codes").mapInArrow(run, schema).groupBy("lang", *words).agg(F.sum("f").alias("f"))
    rest = [F.lit(0).cast("long").alias(w) for w in WORDS[m:]]
    return counted.filter(F.col("f") >= least).select("lang", F.lit(m).alias("m"), *words, *rest, "f")


def count_exactly(stream: DataFrame, wanted: DataFrame) -> DataFrame:
    """Phrases ``wanted`` of 2 to 4 words with f and ``tied``: all occurrences have one and the same word before
    or after them."""
    among = Bitmap(wanted)

    def run(batches):
        for batch in batches:
            for lang, codes, numbers in _streams(batch):
                for m in range(2, LONGEST):
                    at = _places(codes, m)
                    at = at[among.has(lang, [numbers[codes[at + k]] for k in range(m)])]
                    if not len(at):
                        continue
                    name, first = _phrases_at(codes, at, m)
                    before, after = numbers[codes[at - 1]], numbers[codes[at + m]]
                    order = np.argsort(name, kind="stable")
                    starts = np.searchsorted(name[order], np.arange(len(first)))
                    none = np.zeros(len(first), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(first), pa.string()), pa.array(np.full(len(first), m, np.int32)),
                         *[pa.array(numbers[codes[at[first] + k]] if k < m else none) for k in range(LONGEST)],
                         pa.array(np.bincount(name, minlength=len(first))),
                         *[pa.array(pick.reduceat(side[order], starts)) for side in (before, after) for pick in (np.minimum, np.maximum)]],
                        names=[*KEY, "f", "b0", "b1", "a0", "a1"])

    schema = ", ".join(["lang string, m int", *[f"{w} long" for w in WORDS], "f long, b0 long, b1 long, a0 long, a1 long"])
    counted = stream.select("lang", "narrow", "ids", "codes").mapInArrow(run, schema).groupBy(*KEY).agg(
        F.sum("f").alias("f"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("a0").alias("a0"), F.max("a1").alias("a1"))

    def same(low: str, high: str) -> Column:
        return (F.col(low) == F.col(high)) & (F.col(low) != 0)

    return counted.join(wanted.select(*KEY), KEY, "left_semi").select(*KEY, "f", (same("b0", "b1") | same("a0", "a1")).alias("tied"))


def _parts(candidates: DataFrame) -> DataFrame:
    """Every cut of every candidate: its key as ``key``, ``k``, and the keys of both parts as ``left`` and ``right``."""
    zero = F.lit(0).cast("long")

    def cut_at(m: int, k: int) -> Column:
        def key(words: list[str]) -> Column:
            return F.struct("lang", F.lit(len(words)).alias("m"), *[(F.col(words[i]) if i < len(words) else zero).alias(w) for i, w in enumerate(WORDS)])
        return F.struct(F.lit(k).alias("k"), key(WORDS[:k]).alias("left"), key(WORDS[k:m]).alias("right"))

    cuts = F.lit(None)
    for m in range(2, LONGEST + 1):
        cuts = F.when(F.col("m") == m, F.array(*[cut_at(m, k) for k in range(1, m)])).otherwise(cuts)
    return candidates.select(F.struct(*KEY).alias("key"), F.col("f").alias("a"), F.inline(cuts))


def score(candidates: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates with a, l, r, n and score of their lowest-scoring cut (ties: the smallest k)."""
    known = counts.select(F.struct(*KEY).alias("of"), "f")
    cuts = _parts(candidates).join(known.toDF("left", "l"), "left").join(known.toDF("right", "r"), "right")
    cuts = cuts.withColumn("lang", F.col("key.lang")).join(sizes, "lang")
    value = F.expr("1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("key").agg(F.min(F.struct(value.cast("long").alias("score"), "k", "l", "r", "a", "n")).alias("b"))
    return best.select("key.*", "b.a", "b.l", "b.r", "b.n", "b.score")


def _best(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of every language with their rank, found in parts first."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))
    few = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    few = few.filter(F.col("rank") <= keep).drop("part")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= keep)


def _cutoffs(frequent: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(lang, u1, u2, ...): the highest count of first words that each wave takes; only counts of counts are sorted."""
    mass = frequent.groupBy("lang", "f").agg((F.col("f") * F.count(F.lit(1))).alias("mass"))
    upto = mass.withColumn("upto", F.sum("mass").over(Window.partitionBy("lang").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)))
    whole = F.sum("mass").over(Window.partitionBy("lang"))
    return upto.withColumn("share", F.coalesce("upto", F.lit(0)) / whole).groupBy("lang").agg(
        *[F.max(F.when(F.col("share") < s, F.col("f"))).alias(f"u{k}") for k, s in enumerate(shares)])


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language by score, then a (both
    descending), then the phrase in byte order."""
    words = cut(count_words(docs))
    sizes = cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent, salt = number_words(words, least)
    zeros = [F.lit(0).cast("long").alias(w) for w in WORDS[1:]]
    single = cut(frequent.select("lang", F.lit(1).alias("m"), F.col("id").alias("w1"), *zeros, "f"))
    stream = cut(encode(docs, Bitmap(single), salt))
    cutoffs = cut(_cutoffs(frequent, shares))
    bound = F.expr("1000 * cast(n as decimal(19,0)) div f")
    settled, floor = [], None
    for wave in range(len(shares)):
        heads = single.join(cutoffs, "lang").join(sizes, "lang").filter(F.col("f") <= F.col(f"u{wave}"))
        if wave:
            heads = heads.filter(F.col("f") > F.col(f"u{wave - 1}"))
        if floor is not None:
            heads = heads.join(floor, "lang", "left").filter(F.col("floor").isNull() | (bound >= F.col("floor")))
        level = cut(heads.select(*KEY, "f"))
        grown = []
        for m in range(2, LONGEST + 1):
            if level.isEmpty():
                break
            prefix = level.select("lang", *WORDS[:m - 1])
            level = cut(count_grown(stream, m, Bitmap(level), least).join(prefix, ["lang", *WORDS[:m - 1]], "left_semi"))
            grown.append(level)
        if not grown:
            continue
        candidates = grown[0]
        for more in grown[1:]:
            candidates = candidates.unionByName(more)
        ends = _parts(candidates).select("right.*").filter("m > 1")
        parts = cut(count_exactly(stream, candidates.filter(F.col("m") < LONGEST).select(*KEY).unionByName(ends.select(*KEY)).distinct()))
        counts = single.select(*KEY, "f").unionByName(parts.select(*KEY, "f"))
        scored = score(candidates, counts, sizes).join(parts.filter("tied").select(*KEY), KEY, "left_anti")
        settled.append(cut(scored))
        alive = settled[0]
        for more in settled[1:]:
            alive = alive.unionByName(more)
        last = _best(alive.select("lang", "score"), [F.desc("score")], top).filter(F.col("rank") == top)
        floor = cut(last.select("lang", F.col("score").alias("floor")))
    if not settled:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    listed = alive.join(floor, "lang", "left").filter(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor")
    spelled = listed.withColumn("key", F.struct(*KEY)).select("*", F.posexplode(F.array(*WORDS)).alias("at", "id")).filter(F.col("at") < F.col("m")).join(
        frequent.select("lang", "id", "word"), ["lang", "id"]).groupBy("key", "a", "l", "r", "n", "score").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = spelled.select("key.lang", "phrase", "a", "l", "r", "n", "score")
    return _best(rows, [F.desc("score"), F.desc("a"), F.col("phrase")], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH lines AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM lines),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, w[i:i + m - 1] AS g FROM places, range(1, 6) AS s(m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT * FROM counts WHERE len(g) > 1 AND f >= 100),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM cand),
valued AS (
  SELECT c.*, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k]
  JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
alive AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand c WHERE c.lang = b.lang AND len(c.g) = len(b.g) + 1 AND c.f >= b.a
    AND (c.g[1:len(b.g)] = b.g OR c.g[2:] = b.g))),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM alive)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, n, score::BIGINT AS score FROM named
QUALIFY rank <= 2000
"""
