"""Best-fit packing of documents into fixed-length training sequences by the sum-of-squares rule.

Every document becomes token ids and an end id; documents longer than a sequence are cut into full
pieces and a rest. The pieces are dealt to shards of a bounded token count, and each shard places its
pieces, longest first, where the sum over all residual gaps of (number of open sequences with that
gap) squared becomes smallest. Sequences that a shard leaves open are packed again across shards,
whole, so what is lost at shard borders is one small remainder, not one per shard.

Defined cases: a null text is an empty document of one end id; a null doc_id stays a document; equal
rows are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.texts import map_texts, ragged
from linkloom.runtime import cut

CAPACITY = 4096
END_ID = 1
SHARD_SEQUENCES = 512
SHARD_PIECES = 200_000
OPEN_PER_SHARD = 20_000
KEPT_WORDS, GROUP_WORDS = 400_000, 2000
#: A full stop or comma after a letter or digit and before white space is a token run of its own.
STOP = r"([\pL\pN])([.,])[ \n]"


class WordIds:
    """Token ids of whole texts, word by word. The tokenizer never joins text across white space, nor a
    letter or digit with a following full stop or comma, so the ids of a text are those of such words in
    order. Ids of the words met first are kept, up to ``kept_words``; all others are encoded when met."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS, longest_kept: int = 40):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept_words, self.longest = kept_words, longest_kept
        self.code: dict[str, int] = {"": 0}
        self.pool, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has. Words are encoded in joined groups; the
        offsets of the ids tell whose they are."""
        groups = [words[k:k + GROUP_WORDS] for k in range(0, len(words), GROUP_WORDS)]
        ids, counts = [], []
        for group, got in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = np.cumsum([0, *[len(w) + 1 for w in group[:-1]]])
            of = np.searchsorted(starts, [a for a, _ in got.offsets], side="right") - 1
            ids.append(np.array(got.ids, self.pool.dtype))
            counts.append(np.bincount(of, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def _add(self, words: list[str]) -> dict[str, int]:
        """Encode new words; returns codes of those that are not kept, after the kept ones. Words of ASCII
        letters are encoded in lower case, as the tokenizer would, and share their ids."""
        plain = [w.lower() if w.isascii() and "<" not in w else w for w in words]
        distinct = list(dict.fromkeys(plain))
        ids, counts = self._encoded(distinct)
        starts = dict(zip(distinct, (self.used + np.cumsum(counts) - counts).tolist()))
        sizes = dict(zip(distinct, counts.tolist()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used:self.used + len(ids)] = ids
        first, extra = len(self.code), {}
        while first + len(words) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        self.start[first:first + len(words)] = [starts[w] for w in plain]
        self.size[first:first + len(words)] = [sizes[w] for w in plain]
        stay = min(max(0, self.kept_words - first), sum(len(w) <= self.longest for w in words))
        self.code.update(zip(words[:stay], range(first, first + stay)))
        extra = dict(zip(words[stay:], range(first + stay, first + len(words))))
        kept = max([self.used, *[starts[w] + sizes[w] for w in plain[:stay]]])
        self.used = kept
        return extra

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins and ends in them. Words are split
        and told apart by Arrow; only the distinct ones of the list become Python strings."""
        lone = pc.replace_substring_regex(pa.array(texts, pa.large_string()), STOP, r"\1 \2 ")
        split = pc.split_pattern(pc.replace_substring(lone, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = list(map(self.code.get, words))
        if None in known:
            extra = self._add(sorted([w for w, k in zip(words, known) if k is None], key=len))
            known = [self.code[w] if w in self.code else extra[w] for w in words]
        codes = np.array(known, np.int64)[coded.indices.to_numpy()] if words else np.empty(0, np.int64)
        sizes = self.size[codes].astype(np.int64)
        ids = self.pool[ragged(self.start[codes].astype(np.int64), sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        return ids, ends


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The encoder of this worker process; tasks that follow each other share its words."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, slot (running number in its task)."""
    def setup():
        return [encoder(tokenizer), 0]

    def run(texts, state):
        ids, ends = state[0].encode(texts)
        rows = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = np.append(ids[a:b], end_id).astype("<u4")
            rows.append([{"piece": k, "start": p, "length": min(capacity, len(own) - p),
                          "ids_crc32": zlib.crc32(own[p:p + capacity]), "slot": state[1]}
                         for k, p in enumerate(range(0, len(own), capacity))])
            state[1] += 1
        return {"pieces": rows}

    kind = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long,slot:long>>"
    return map_texts(docs, run, kind, ["doc_id"], setup=setup).select("doc_id", F.inline("pieces"))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every length, placed longest first; ties go to the smaller gap."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if size < capacity:
            # Taking gap g changes the sum by (2 n[g-size] + 1) - (2 n[g] - 1); a new bin has no second part.
            old, new = count[size:capacity], count[:capacity - size]
            change = np.where(old > 0, 2 * (new - old) + 2, np.iinfo(np.int64).max)
            change[0] -= (2 * int(new[0]) + 1) if old[0] > 0 else 0
            best = int(change.argmin())
            fresh = 2 * int(count[capacity - size]) + 1
            gap = best + size if change[best] <= fresh else capacity
        else:
            gap = capacity
        if gap == capacity:
            k, made = made, made + 1
        else:
            k = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = k, capacity - gap
        if gap > size:
            open_bins[gap - size].append(k)
            count[gap - size] += 1
    return bins, offsets


def _shards(rows: DataFrame, count: int, key: list[str]) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(count)))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_sequences: int = SHARD_SEQUENCES,
                shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens (column ``length``)."""
    pieces = cut(pieces)
    total, n = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, math.ceil(total / (capacity * shard_sequences)), math.ceil(n / shard_pieces))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "slot"], ascending=False)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(columns=["shard"])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long, sequence_id long, offset long"
    rows = _shards(pieces.withColumn("doc_id", F.col("doc_id").cast("long")), shards, ["slot", "doc_id", "piece"])
    placed = cut(rows.groupBy("shard").applyInPandas(place, kind))
    fills = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    left = cut(fills.filter(F.col("length") < capacity))
    groups = max(1, math.ceil(left.count() / OPEN_PER_SHARD))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "sequence_id"], ascending=False)
        bins, base = sum_of_squares(pdf["length"].to_numpy(), capacity)
        first = pdf["sequence_id"].groupby(bins).transform("min") if len(pdf) else pdf["sequence_id"]
        return pd.DataFrame({"sequence_id": pdf["sequence_id"], "into": first, "base": base})

    moves = _shards(left, groups, ["sequence_id"]).groupBy("shard").applyInPandas(
        merge, "sequence_id long, into long, base long")
    moves = cut(moves.filter((F.col("into") != F.col("sequence_id")) | (F.col("base") > 0)))
    return placed.join(moves, "sequence_id", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with its sequence and offset."""
    return pack_pieces(pieces_of(docs, tokenizer, capacity, end_id), capacity)
