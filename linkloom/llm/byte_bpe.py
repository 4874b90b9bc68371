"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the vocabulary's pattern. All pre-tokens met for the first time in a slice
of texts are encoded together: their bytes are one linked list with gaps between them, every place that
begins a mergeable pair waits in the bucket of its pair's rank, and a two-level bitmap of the ranks that
have waiting places gives the next rank by two find-first-set steps. Places of a bucket are merged from left
to right (all at once while buckets are wide, then one by one); a merge that makes a pair of lower rank sends
the rest of its bucket back and the queue goes on there. A place whose pair has changed is stale and is
skipped when its bucket comes up. So the work is a few steps per merge however long a pre-token is, and ranks
are taken in the order of each pre-token alone.

Words between single spaces are cached: no pre-token reaches over a space that has a printed character on
either side, so the ids of a text are those of its words in order, each with the space before it. The
caches belong to a task, hold the words met first up to a bound of bytes, and change no result.

Defined cases: a null text is an empty one, with no ids; repeated rows and null ids are rows of their own;
other columns are ignored; an empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame

from linkloom.llm.texts import map_texts

#: A space beside which pre-tokens may go on: white space, or the end, on both its sides.
OPEN_SPACE = re.compile(r"(?:\s|\A) (?:\s|\Z)")
CLOSED_SPACE = re.compile(r"(?<=\S) | (?=\S)")
PLAIN = re.compile(r" \S+")
KEPT_BYTES = 48 << 20
LEAF_BITS = 240
WIDE, NARROW_ROUNDS = 8, 256
"""places of a bucket that are merged at once, and smaller buckets in a row after which places go one by one"""
WHOLE_MATCHES = 1 << 22
"""characters up to which all matches of a text are listed at once"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Waiting places by rank. ``first`` is the lowest rank with a bucket."""

    def __init__(self, ranks: int):
        self.leaves = [0] * (ranks // LEAF_BITS + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def put(self, rank: int, part: object) -> None:
        """Add to a bucket; ``part`` is a place or an array of places."""
        waiting = self.buckets.get(rank)
        if waiting is not None:
            waiting.append(part)
            return
        self.buckets[rank] = [part]
        leaf, bit = divmod(rank, LEAF_BITS)
        self.leaves[leaf] |= 1 << bit
        self.top |= 1 << leaf

    def put_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Add every place to the bucket of its rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[np.array(bounds[:-1])].tolist() if len(ranks) else (), bounds, bounds[1:]):
            self.put(rank, places[a:b])

    def first(self) -> int:
        leaf = (self.top & -self.top).bit_length() - 1
        word = self.leaves[leaf]
        return leaf * LEAF_BITS + (word & -word).bit_length() - 1

    def take(self, rank: int) -> list:
        leaf, bit = divmod(rank, LEAF_BITS)
        self.leaves[leaf] ^= 1 << bit
        if not self.leaves[leaf]:
            self.top ^= 1 << leaf
        return self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.size = max(ranks.values(), default=0) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        # Rank of every pair of tokens whose bytes together are a token, also as sorted arrays.
        self.merged = {ranks[t[:k]] * self.size + ranks[t[k:]]: rank for t, rank in ranks.items()
                       for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.fromiter(self.merged, np.int64, len(self.merged))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(self.merged.values(), np.int64, len(keys))[order], -1)
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)])

    def pair_ranks(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """Rank of each pair of tokens, -1 where they do not merge or one is no token."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of every pre-token, all merged through one queue."""
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        # A linked list of places; gaps hold -1, merged places -2. The last gap closes it on both sides.
        tok = self.byte_rank[data]
        tok[ends] = -1
        pair = np.append(self.pair_ranks(tok[:-1], tok[1:]), -1)
        nxt, prv = np.arange(1, len(tok) + 1), np.arange(-1, len(tok) - 1)
        nxt[-1], prv[0] = 0, len(tok) - 1
        queue = RankQueue(self.size)
        waiting = np.flatnonzero(pair >= 0)
        queue.put_all(pair[waiting], waiting)
        if self._merge_wide(queue, tok, pair, nxt, prv):
            tok = self._merge_narrow(queue, tok, pair, nxt, prv)
        alive = tok >= 0
        before = np.concatenate([[0], np.cumsum(alive)])
        flat = tok[alive].astype("<u4").tobytes()
        return [flat[4 * a:4 * b] for a, b in zip(before[ends - sizes].tolist(), before[ends].tolist())]

    def _merge_wide(self, queue: RankQueue, tok, pair, nxt, prv) -> bool:
        """Merge bucket by bucket, all places of one at once, as long as buckets are wide; True if places are
        left to wait. A bucket in which a merge would make a pair of lower rank is put back untouched."""
        narrow = 0
        while queue.top and narrow < NARROW_ROUNDS:
            rank = queue.first()
            parts = queue.take(rank)
            waiting = np.concatenate(parts)
            places = np.sort(waiting[pair[waiting] == rank])
            if not len(places):
                continue
            narrow = narrow + 1 if len(places) < WIDE else 0
            # Of places that follow on one another (as in "aaa") every second one merges, from the left.
            number = np.arange(len(places))
            follows = np.zeros(len(places), bool)
            follows[1:] = nxt[places[:-1]] == places[1:]
            if follows.any():
                first = np.maximum.accumulate(np.where(follows, 0, number))
                places = places[(number - first) % 2 == 0]
            gone = nxt[places]
            after = nxt[gone]
            before = prv[places]
            # The token before may be one that this bucket makes; the token after is still the old one.
            left = tok[before]
            touches = np.zeros(len(places), bool)
            touches[1:] = after[:-1] == places[1:]
            left[touches] = rank
            right_now, left_now = self.pair_ranks(rank, tok[after]), self.pair_ranks(left, rank)
            if ((right_now >= 0) & (right_now < rank)).any() or ((left_now >= 0) & (left_now < rank)).any():
                queue.put(rank, waiting)
                return True
            tok[places], tok[gone], pair[gone] = rank, -2, -1
            nxt[places] = after
            prv[after] = places
            pair[places] = self.pair_ranks(rank, tok[after])
            apart = (left >= 0) & ~touches
            before = before[apart]
            pair[before] = left_now[apart]
            changed = np.concatenate([places, before])
            changed = changed[pair[changed] >= 0]
            queue.put_all(pair[changed], changed)
        return bool(queue.top)

    def _merge_narrow(self, queue: RankQueue, tok, pair, nxt, prv) -> np.ndarray:
        """Merge place by place; a pair of lower rank comes before the rest of its bucket."""
        tok, pair, nxt, prv = tok.tolist(), pair.tolist(), nxt.tolist(), prv.tolist()
        for rank, parts in queue.buckets.items():
            queue.buckets[rank] = np.concatenate(parts).tolist()
        merged, size, put = self.merged.get, self.size, queue.put
        while queue.top:
            rank = queue.first()
            places = queue.take(rank)
            places.sort()
            for k, at in enumerate(places):
                if pair[at] != rank:
                    continue
                gone = nxt[at]
                after = nxt[gone]
                before = prv[at]
                tok[at], tok[gone], pair[gone] = rank, -2, -1
                nxt[at] = after
                prv[after] = at
                right, left = tok[after], tok[before]
                pair[at] = made = merged(rank * size + right, -1) if right >= 0 else -1
                lower = 0 <= made < rank
                if made >= 0:
                    put(made, at)
                if left >= 0:
                    pair[before] = made = merged(left * size + rank, -1)
                    if made >= 0:
                        put(made, before)
                        lower = lower or made < rank
                if lower and k + 1 < len(places):
                    for rest in places[k + 1:]:
                        put(rank, rest)
                    break
        return np.array(tok, np.int64)

    def cut(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, in lists of bounded length."""
        if len(text) <= WHOLE_MATCHES:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(matches, WHOLE_MATCHES)):
            yield part

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Cache:
    """Little-endian ids of strings, kept for those met first up to a bound of bytes."""

    def __init__(self, kept_bytes: int):
        self.known: dict[str, bytes] = {}
        self.left = kept_bytes

    def keep(self, found: dict[str, bytes]) -> None:
        for key, ids in found.items():
            self.left -= 200 + 2 * len(key) + len(ids)
            if self.left < 0:
                return
            self.known[key] = ids


class TextIds:
    """Ids of whole texts, through caches of words and of pre-tokens."""

    def __init__(self, bpe: ByteBPE, kept_bytes: int = KEPT_BYTES):
        self.bpe = bpe
        self.words, self.parts = Cache(kept_bytes), Cache(kept_bytes // 2)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        split = [CLOSED_SPACE.split(t) if OPEN_SPACE.search(t) else t.split(" ") for t in texts]
        # The first word of a text has no space before it.
        heads = self._new(list({w[0] for w in split}))
        words = list(chain.from_iterable([islice(w, 1, None) for w in split]))
        found = list(map(self.words.known.get, words))
        missing = list({w for w, ids in zip(words, found) if ids is None})
        if missing:
            fresh = dict(zip(missing, self._new([" " + w for w in missing]).values()))
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
            self.words.keep(fresh)
        out, at = [], 0
        for w in split:
            out.append(heads[w[0]] + b"".join(found[at:at + len(w) - 1]))
            at += len(w) - 1
        return out

    def _new(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of distinct strings, each cut by the pattern, in their order."""
        plain = [t for t in texts if PLAIN.fullmatch(t)]
        cuts: dict[str, list[str]] = dict.fromkeys(texts, [])
        # Words of one leading space are cut in one go: only their first pre-token begins with a space.
        parts = self.bpe.pattern.findall("".join(plain)) if plain else []
        starts = [k for k, part in enumerate(parts) if part[0] == " "]
        for t, a, b in zip(plain, starts, [*starts[1:], len(parts)]):
            cuts[t] = parts[a:b]
        for t in set(texts).difference(plain) if len(plain) < len(texts) else ():
            cuts[t] = list(chain.from_iterable(self.bpe.cut(t)))
        known, ranks = self.parts.known, self.bpe.ranks
        fresh: dict[str, bytes] = {}
        hard, raws = [], []
        for part in set(chain.from_iterable(cuts.values())).difference(known):
            raw = part.encode()
            rank = ranks.get(raw)
            if rank is None:
                hard.append(part)
                raws.append(raw)
            else:
                fresh[part] = rank.to_bytes(4, "little")
        if hard:
            fresh.update(zip(hard, self.bpe.merge(raws)))
        both = known | fresh if fresh else known
        made = {t: both[parts[0]] if len(parts) == 1 else b"".join([both[p] for p in parts]) for t, parts in cuts.items()}
        self.parts.keep(fresh)
        return made


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit, as bytes) and ``decoded`` bytes of every text."""
    def run(texts, coder):
        ids = coder.encode(texts)
        return {"ids": ids, "decoded": [coder.bpe.decode(np.frombuffer(i, "<u4")) for i in ids]}

    return map_texts(docs, run, "ids binary, decoded binary", ["doc_id"], setup=lambda: TextIds(ByteBPE(ranks, pattern)))


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text, without handing ids on."""
    def run(texts, coder):
        ids = coder.encode(texts)
        return {"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(coder.bpe.decode(np.frombuffer(i, "<u4"))).hexdigest() for i in ids]}

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"],
                     setup=lambda: TextIds(ByteBPE(ranks, pattern)))
