"""Quality classifier: averaged subword embeddings with a softmax output.

Every word has a hashed vector of its own and one for each of its character n-grams; a document is the
average of all of them, and a softmax layer turns that average into class probabilities. Vectors and
layer are learned together by numpy stochastic gradient descent on at most about ``sample_docs``
labelled documents, chosen by a hash of the document id. Scoring reads whole texts: as average and layer
are linear, each word contributes one number, which is kept for frequent words.

Defined cases: null and empty texts have no features and get the score of the bias alone; null ids and
labels are never learned from; without labels, or with one class only, every score is that class's share
(0.5 without any); repeated rows and other columns make no difference; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.texts import WordTable, map_texts, ngram_buckets, per_text

BITS, DIM = 16, 8
ORDERS = range(1, 5)
SAMPLE_DOCS = 5_000
EPOCHS, BATCH, RATE = 5, 32, 2.0
SEED = 7


@dataclass
class Classifier:
    weights: np.ndarray
    """what a hash bucket adds to the log-odds of class 1, before averaging"""
    bias: float


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of every feature: character n-grams of each word, and the word itself."""
    owners, buckets = zip(*ngram_buckets(words, ORDERS, BITS))
    own = np.fromiter((hash_word(w) for w in words), np.int64, len(words))
    return np.concatenate([*owners, np.arange(len(words))]), np.concatenate([*buckets, own])


def hash_word(word: str) -> int:
    import zlib

    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) * 2654435761 >> 13) & ((1 << BITS) - 1)


def train(texts: list[str], labels: np.ndarray) -> Classifier:
    """Stochastic gradient descent on the documents' feature averages."""
    share = labels.mean() if len(labels) else 0.5
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(labels) or share in (0.0, 1.0):
        return Classifier(np.zeros(1 << BITS, np.float32), bias)
    docs = []
    for text in texts:
        times = Counter(text.split() or [""])
        owner, bucket = features(list(times))
        weight = np.bincount(bucket, np.fromiter(times.values(), float)[owner], 1 << BITS)
        seen = np.flatnonzero(weight)
        docs.append((seen.astype(np.int32), (weight[seen] / weight.sum()).astype(np.float32)))
    random = np.random.default_rng(SEED)
    vectors = random.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, offset = np.zeros((DIM, 2), np.float32), np.array([0, bias], np.float32)
    layer[:, 1] = random.normal(0, 1, DIM)
    layer[:, 0] = -layer[:, 1]
    steps = EPOCHS * (len(docs) // BATCH + 1)
    done = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(docs))
        for a in range(0, len(docs), BATCH):
            some = order[a:a + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            ids = np.concatenate([docs[i][0] for i in some])
            weight = np.concatenate([docs[i][1] for i in some])
            sizes = np.array([len(docs[i][0]) for i in some])
            hidden = per_text(vectors[ids] * weight[:, None], sizes)
            logits = hidden @ layer + offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            back = p @ layer.T
            layer -= rate * (hidden.T @ p / len(some)).astype(np.float32)
            offset -= (rate * p.mean(0)).astype(np.float32)
            step = np.repeat((rate * back).astype(np.float32), sizes, axis=0) * weight[:, None]
            for d in range(DIM):
                vectors[:, d] -= np.bincount(ids, step[:, d], 1 << BITS).astype(np.float32)
    return Classifier((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(offset[1] - offset[0]))


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Train on rows of (doc_id, text, label 0/1) in one task, which the sample's bound allows."""
    labelled = labelled.filter("doc_id IS NOT NULL AND label IN (0, 1)")
    n = labelled.count()
    share = min(1.0, sample_docs / n) if n else 1.0
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    sample = labelled.filter(chosen) if share < 1 else labelled

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], na_position="first")
        model = train(pdf["text"].fillna("").tolist(), pdf["label"].to_numpy(np.int64))
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    rows = sample.select("doc_id", F.col("text").cast("string"), F.col("label").cast("int"), F.lit(0).alias("all"))
    made = rows.groupBy("all").applyInPandas(fit, "weights binary, bias double").first()
    if made is None:
        return train([], np.empty(0, np.int64))
    return Classifier(np.frombuffer(made["weights"], np.float32), made["bias"])


def measure(words: list[str], weights: np.ndarray) -> np.ndarray:
    owner, bucket = features(words)
    return np.stack([np.bincount(owner, weights[bucket], len(words)), np.bincount(owner, minlength=len(words))], 1)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Per row: the columns of ``docs`` but the text, then ``score``, the probability of class 1."""
    weights, bias = model.weights, model.bias

    def setup():
        return WordTable(lambda words: measure(words, weights), 2)

    def run(texts, table):
        rows, counts = table.look_up(texts)
        sums = per_text(rows, counts)
        return {"score": 1 / (1 + np.exp(-np.clip(sums[:, 0] / np.maximum(sums[:, 1], 1) + bias, -500, 500)))}

    return map_texts(docs, run, "score double", [c for c in docs.columns if c != "text"], setup=setup)
