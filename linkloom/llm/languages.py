"""Language identification as inference of a mixture of languages inside each document.

Character n-gram frequencies of every language give each word a log-likelihood per language. The words
of a document are drawn from a mixture: expectation-maximisation estimates the language proportions.
Sets of one, two and more languages, in the order of their proportions, compete by log-likelihood
minus a penalty for every language that grows with the logarithm of the word count; the winner's
largest proportion is the prediction.

The models are learned from at most about ``sample_docs`` labelled documents, chosen by a hash of the
document id; predictions read whole texts and nothing else.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled
document every text is ``und``; null ids, repeated rows and other columns make no difference; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.texts import WordTable, map_texts, ngram_buckets, per_text, slices

ORDERS, BITS = range(1, 5), 16
SAMPLE_DOCS = 20_000
SMOOTHING = 0.5
PENALTY = 4.0
SHORT_ROUNDS, ROUNDS = 4, 10
NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class Languages:
    names: list[str]
    scores: np.ndarray
    """log-probability of n-gram bucket by language, the bucket's order included in its hash"""


def letters(words: list[str]) -> list[str]:
    """Letters only; digits in other forms (``²``, ``½``) are none."""
    plain = [NO_LETTERS.sub("", w).lower() for w in words]
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in plain]


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Languages:
    """Models from rows of (doc_id, text, lang) with non-null ``lang``."""
    n = labelled.count()
    share = min(1.0, sample_docs / n) if n else 0.0
    chosen = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("languages")), F.lit(1 << 20))
    sample = labelled.filter(chosen < F.lit(int(share * (1 << 20)))) if share < 1 else labelled

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    by_lang.setdefault(lang, []).extend((text or "").split())
                for lang, words in by_lang.items():
                    table = seen.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    for _, bucket in ngram_buckets(letters(words), ORDERS, BITS):
                        table += np.bincount(bucket, minlength=1 << BITS)
        for lang, table in seen.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": some.astype(np.int32),
                                              "n": table[some]})

    counted = sample.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    table = np.zeros((1 << BITS, len(names)))
    table[rows["bucket"].to_numpy(), rows["lang"].map({l: k for k, l in enumerate(names)}).to_numpy(dtype=np.int64)] = rows["n"]
    scores = np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * (1 << BITS)))
    return Languages(names, scores.astype(np.float32))


def measure(words: list[str], scores: np.ndarray) -> np.ndarray:
    """Per word: mean log-likelihood over the n-gram orders for each language, then 1 if it has a letter."""
    plain = letters(words)
    out = np.zeros((len(words), scores.shape[1] + 1))
    for owner, bucket in ngram_buckets(plain, ORDERS, BITS):
        for k in range(scores.shape[1]):
            out[:, k] += np.bincount(owner, scores[bucket, k], len(words))
    out /= len(ORDERS)
    out[:, -1] = [bool(w) for w in plain]
    out[out[:, -1] == 0] = 0
    return out.astype(np.float32)


def mixtures(likelihood: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int):
    """EM for every text at once from the given proportions: proportions, log-likelihood, and a bound that
    no proportions of these languages exceed (the likelihood is concave in them). ``likelihood`` has a row
    per language and a column per word; every text has a word."""
    top = likelihood.max(0)
    odds = np.exp(likelihood - top)
    starts = np.cumsum(counts) - counts
    share = share.T.astype(np.float32)
    for k in range(rounds + 1):
        mass = np.maximum(np.einsum("lw,lw->w", odds, np.repeat(share, counts, axis=1)), np.float32(1e-30))
        gain = np.add.reduceat(odds / mass, starts, axis=1) / counts.astype(np.float32)
        if k < rounds:
            share = share * gain
            share /= share.sum(0)
    value = np.add.reduceat(np.log(mass) + top, starts, dtype=np.float64)
    return share.T.astype(float), value, value + counts * np.log(gain.max(0).astype(float))


def decide(rows: np.ndarray, counts: np.ndarray, penalty: float = PENALTY):
    """Per text: proportions of the selected languages, the lead of the best single one, and words used."""
    worded = rows[:, -1] > 0
    counts = per_text(worded.astype(np.int64), counts).astype(np.int64)
    likelihood = np.ascontiguousarray(rows[worded, :-1].T)
    size = len(likelihood)
    single = per_text(likelihood.T, counts)
    ordered = np.sort(single, axis=1)
    lead = ordered[:, -1] - ordered[:, -2] if size > 1 else np.full(len(counts), np.inf)
    chosen = np.eye(size)[single.argmax(1)]
    price = penalty * np.log(counts + 1.0)
    best = ordered[:, -1] - price
    owner = np.repeat(np.arange(len(counts)), counts)

    def among(texts: np.ndarray) -> np.ndarray:
        return likelihood[:, texts[owner]]

    open_ = counts > 1 if size > 1 else np.zeros(len(counts), bool)
    share = np.full((len(counts), size), 1 / size)
    bound = np.full(len(counts), np.inf)
    for rounds in (SHORT_ROUNDS, ROUNDS):  # the short run closes most texts: their bound is under the best
        if open_.any():
            share[open_], _, bound[open_] = mixtures(among(open_), counts[open_], share[open_], rounds)
        open_ &= bound - 2 * price > best
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    for k in range(2, size + 1):
        open_ &= bound - k * price > best
        if not open_.any():
            break
        allowed = (rank[open_] < k) * share[open_] + (rank[open_] < k) * 1e-6
        part, value, _ = mixtures(among(open_), counts[open_], allowed / allowed.sum(1, keepdims=True), ROUNDS)
        value = value - k * price[open_]
        better = value > best[open_]
        at = np.flatnonzero(open_)[better]
        chosen[at], best[at] = part[better], value[better]
    return chosen, lead, counts


def identify(docs: DataFrame, model: Languages, penalty: float = PENALTY, keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per row: the ``keep`` columns (all but the text), then the predicted language and its score."""
    known, scores, (pred, value) = model.names, model.scores, names

    def setup():
        return WordTable(lambda words: measure(words, scores), len(known) + 1)

    def run(texts, table):
        if not known:
            return {pred: ["und"] * len(texts), value: [0.0] * len(texts)}
        rows, counts = table.look_up(texts)
        share, lead, words = decide(rows, counts, penalty)
        found = share.argmax(1)
        score = share.max(1) * (1 - np.exp(-np.maximum(lead, 0)) / 2)
        return {pred: [known[k] if n else "und" for k, n in zip(found, words)],
                value: np.where(words > 0, np.clip(score, 0, 1), 0.0)}

    keep = [c for c in docs.columns if c not in ("text", *names)] if keep is None else keep
    return map_texts(docs, run, f"{pred} string, {value} double", keep, setup=setup)


def keep_identified(docs: DataFrame, model: Languages) -> DataFrame:
    """The rows of ``docs`` with a language, all columns unchanged; those found ``und`` go."""
    return identify(docs, model, keep=docs.columns, names=("__lang", "__score")).filter("__lang <> 'und'").select(*docs.columns)


def held_out(modulus: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest
