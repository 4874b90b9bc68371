"""Collocations, periodic runs and byte-level BPE: against brute force and the public encoder, and on odd input."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import byte_bpe, collocations, periodic
from linkloom.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"
ODD = [(None, None, None), (1, "", "en"), (2, "a b " * 400, "en"), (2, "a b " * 400, "en"), (3, " \t\n\x0b", None),
       (None, "x\x1cy\x85z\xa0w  é 😀\n \n end ", "fr"), (4, "z" * 30_000, "en"), (5, "q w. q w! Q W? q\tw " * 200, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, other white space, and columns with clashing names."""
    rows = [(i, t, lang, "x", 1.0, [1]) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, f double, runs array<int>")


# Periodic runs

def plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(6, 4 * q) and all(any(words[x] != words[x + d] for x in range(s, s + size - d)) for d in range(1, q)):
                found.append((s, size, q))
            i = max(i, s + 1)
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 1), max_size=20), st.integers(0, 9), st.integers(0, 9),
       st.lists(st.integers(0, 2), max_size=8))
def test_runs_equal_the_definition(head, unit, times, again, tail):
    words = head + unit * times + tail + unit[:3] * again
    assert [tuple(r) for r in periodic.runs_of(np.array(words, np.int64)).tolist()] == plain_runs(words)


def plain_periodic(doc_id, text):
    words = (text or "").encode().split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words) if n < 900 else [tuple(r) for r in periodic.runs_of(np.unique(words, return_inverse=True)[1]).tolist()]
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *best, best[2] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def test_op12_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(plain_periodic(*d) for d in docs)
    assert any(r[1] for r in got)


def test_periodic_on_odd_rows(spark, odd):
    found = periodic.find_runs(odd)
    assert found.columns == ["doc_id", "runs", "collapsed"]
    by_text = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=str)
    want = []
    for doc_id, text, _ in ODD:
        words = (text or "").encode().split()
        runs = plain_runs(words)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        want.append((doc_id, runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert by_text == sorted(want, key=str)
    assert periodic.digests(periodic.find_runs(periodic.planted(odd.limit(0)))).count() == 0


# Byte-level BPE

@pytest.fixture(scope="module")
def coders():
    bpe = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    return bpe, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


LETTERS = " \t\n\r\x0b\x1c\x85\xa0　'sdtrevmlabcAéßñ中文字日本語12²Ⅷ,.!?-_\"«😀‍́𝒜ﬁ​﻿"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=40) | st.text(max_size=20), max_size=6))
def test_ids_are_the_encoders(coders, texts):
    bpe, plain = coders
    coder = byte_bpe.TextIds(bpe, kept_bytes=3000)
    for _ in range(2):
        for text, ids in zip(texts, coder.encode(texts)):
            ids = np.frombuffer(ids, "<u4")
            assert ids.tolist() == plain.encode_ordinary(text)
            assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("wide", [1, 8, 10**9])
def test_queue_on_long_pre_tokens(coders, monkeypatch, wide):
    """Wide buckets, place by place, and the turn from one to the other give the same ids."""
    bpe, plain = coders
    monkeypatch.setattr(byte_bpe, "WIDE", wide)
    monkeypatch.setattr(byte_bpe, "NARROW_ROUNDS", 3 if wide > 1 else 10**9)
    rng = np.random.default_rng(5)
    words = ["a" * 4001, "ab" * 3000 + "c", "abcabd" * 2000, *("".join(rng.choice(list(s), 3000)) for s in ("aab", "abcdefgh", "theraniotsé中"))]
    for word, ids in zip(words, bpe.merge([w.encode() for w in words])):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(word)


def test_lower_rank_goes_first():
    """A merge that makes a pair of lower rank interrupts its bucket: "ab" makes "abc" here, which is of lower rank."""
    coder = byte_bpe.ByteBPE.__new__(byte_bpe.ByteBPE)
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"cab": 258}
    coder.ranks, coder.size = ranks, 259
    coder.merged = {ranks[t[:k]] * 259 + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    order = sorted(coder.merged.items())
    coder.keys, coder.values = np.array([k for k, _ in order] + [np.iinfo(np.int64).max]), np.array([v for _, v in order] + [-1])
    coder.byte_rank = np.arange(256)
    plain = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = ["abcab" * 20, "ababcabc", "cabcab", "abc"] * 10
    assert [np.frombuffer(i, "<u4").tolist() for i in coder.merge([w.encode() for w in words])] == [plain.encode_ordinary(w) for w in words]


def test_op13_equals_the_encoder(spark, coders, odd):
    _, plain = coders

    def row(doc_id, text):
        ids = np.array(plain.encode_ordinary(text or ""), "<u4")
        return (doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op13_byte_bpe"](spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(row(r.doc_id, r.text) for r in docs.collect())
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = byte_bpe.digests(odd, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((row(i, t) for i, t, _ in ODD), key=str)
    for r in byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect():
        assert plain.decode_bytes(np.frombuffer(r.ids, "<u4").tolist()) == r.decoded
    assert byte_bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# Collocations

def plain_collocations(docs, least, top):
    counts, sizes = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(w)
            for m in range(1, 6):
                counts[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    rows = []
    for lang, f in counts.items():
        found, candidates = [], {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        held = {g[i:j] for g, a in candidates.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1)
                if j - i < len(g) and a >= f[g[i:j]]}
        for g, a in candidates.items():
            if g not in held:
                score, _, l, r = min((1000 * a * sizes[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(rows)


@pytest.mark.parametrize("least,top,shares", [(12, 60, (0.1, 0.4, 1.0)), (6, 2000, (0.25, 0.5, 1.0))])
def test_collocations_equal_brute_force(spark, least, top, shares):
    """With a small ``top`` the bound leaves prefixes out; with a large one all are grown."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    got = collocations.mine(docs, least, top, shares)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations([tuple(r) for r in docs.collect()], least, top)


def test_collocations_settle_ties_and_leave_prefixes_out(spark, monkeypatch):
    """Twenty phrases of one score compete for five places: byte order decides, and frequent first words are not grown."""
    rows = [(" . ".join(f"p{k:02} q{k:02}" for k in range(20)) + " . the end . the sun . the end .", "en")] * 7
    grown = []
    count = collocations.count_grown
    monkeypatch.setattr(collocations, "count_grown", lambda s, m, p, least: grown.append(m) or count(s, m, p, least))
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(map(tuple, collocations.mine(docs, 7, 5, (0.3, 1.0)).collect()))
    assert got == plain_collocations(rows, 7, 5)
    assert [r[2] for r in got] == [f"p{k:02} q{k:02}" for k in range(5)]


def test_collocations_on_odd_rows(spark, odd):
    got = collocations.mine(odd, 50, 100)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(t, lang) for _, t, lang in ODD], 50, 100)
    assert collocations.mine(odd.limit(0)).count() == 0
    assert collocations.mine(odd.filter("doc_id = 1")).count() == 0


def test_a_shared_number_takes_another_salt(spark, monkeypatch):
    """Two words whose numbers are equal under the first salt are numbered under the next."""
    words = spark.createDataFrame([("en", "a", 9), ("en", "b", 1)], "lang string, word string, f long")
    real = collocations.F.xxhash64
    monkeypatch.setattr(collocations.F, "xxhash64", lambda c: collocations.F.when(
        collocations.F.substring(c, 1, 1) == "0", collocations.F.lit(5).cast("long")).otherwise(real(c)))
    numbered, salt = collocations.number_words(words, 5)
    assert salt == "1" and [r.word for r in numbered.collect()] == ["a"]
