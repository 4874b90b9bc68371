"""Secret scan: fixed credential patterns, and guess-cost of values in a credential context.

Kinds of spans: ``assign`` (a credential name, a separator and a value of 8 or more characters),
``access`` (access key ids), ``hex`` (32 or more hexadecimal digits) and ``guess``. For the last one,
every value that follows a credential name is cut by dynamic programming into the cheapest sequence of
known words, dates, repeats, keyboard walks and brute-force characters. The cost is the base-10
logarithm of the guesses an attacker needs; from ``HARD_TO_GUESS`` on the value is a secret. Values inside
a pattern span are not reported again, so the method only adds spans.

Known words are a short list of common parts of passwords and the frequent words of all
texts (``learn_words``), each at the logarithm of twice its rank. Words that stand as a credential's value do not count for
it, so a secret that is copied often does not become a word.

Spans are code points with an exclusive end. Defined cases: a null text is empty and has no span;
null ids, repeated rows and other columns make no difference; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.texts import map_texts
from linkloom.runtime import cut

KINDS = ("assign", "access", "hex", "guess")
HARD_TO_GUESS = 8.0
MASK = "[secret]"

# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

# What introduces a credential, common parts of passwords, and rows of a keyboard.
CONTEXT = re.compile(r"""(?<![a-z])(?:pass ?word|passwd|pass ?phrase|passcode|pwd|pass|secret|token|api[ _-]?key|access[ _-]key|"""
                     r"""private[ _-]key|credentials?|login|pin)["']?[ \t]*(?:(?:is|was|=>|->|:=)[ \t]+|[:=][ \t]*)["'`]?(\S+)""", re.I | re.A)
COMMON_WORDS = ("password", "passwd", "pass", "admin", "welcome", "letmein", "login", "secret", "token", "master", "dragon",
                "monkey", "sunshine", "princess", "football", "baseball", "soccer", "hockey", "shadow", "superman", "batman",
                "iloveyou", "love", "hello", "summer", "winter", "spring", "autumn", "monday", "friday", "sunday", "january",
                "june", "july", "august", "october", "flower", "orange", "purple", "yellow", "blue", "green", "black", "white",
                "silver", "golden", "tiger", "eagle", "falcon", "killer", "hunter", "ranger", "access", "server", "root", "user",
                "test", "guest", "default", "change", "changeme", "computer", "internet", "freedom", "whatever", "trust", "magic",
                "charlie", "michael", "jordan", "thomas", "daniel", "george", "robert", "andrew", "jessica", "ashley", "cookie",
                "coffee", "cheese", "pepper", "ginger", "banana", "apple", "london", "paris", "berlin", "madrid", "example",
                "sample", "demo", "temp", "placeholder", "none", "null", "your", "my", "the", "and", "key", "required", "here")
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

WORD_COST = {w: math.log10(2 * k + 2) for k, w in enumerate(COMMON_WORDS)}
#: Words learned from the texts: their least share of all words, their lengths, and how often a word must occur.
WORD_SHARE, WORD_LENGTHS, WORD_COUNT = 5e-6, (3, 24), 3
LONGEST_WORD = WORD_LENGTHS[1]
STEPS = {pair for row in KEY_ROWS for line in (row, row[::-1]) for pair in zip(line, line[1:])}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0\d|1[0-2])[-/.]?[0-3]\d|[0-3]\d[-/.]?(?:0\d|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
SEGMENT = math.log10(2)


def _kind(ch: str) -> tuple[int, float]:
    """Character class and the logarithm of its size."""
    if ch.isdigit():
        return 0, 1.0
    if ch.isalpha():
        return (1, math.log10(26)) if ch.islower() else (2, math.log10(26))
    return 3, math.log10(33)


def learn_words(docs: DataFrame, share: float = WORD_SHARE) -> dict[str, float]:
    """Cost of each known word: the common parts of passwords, and the words that make up at least ``share`` of the
    whole texts (of their words met ``WORD_COUNT`` times), so at most ``1 / share`` of them reach the driver."""
    text = F.regexp_replace(F.col("text").cast("string"), "(?i)" + CONTEXT.pattern, " ")
    words = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    counted = cut(words.filter(F.length("word").between(*WORD_LENGTHS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") >= WORD_COUNT))
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    rows = sorted(counted.filter(F.col("n") >= total * share).collect(), key=lambda row: (-row.n, row.word))
    learned = {row.word: math.log10(2 * k + 2) for k, row in enumerate(rows)}
    return learned | {w: min(c, learned.get(w, c)) for w, c in WORD_COST.items()}


def guess_cost(value: str, words: dict[str, float] = WORD_COST) -> float:
    """Smallest base-10 logarithm of guesses over all segmentations of ``value``; linear in its length."""
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    repeat, walk = [1] * n, [1] * n
    for i in range(1, n):
        repeat[i] = repeat[i - 1] + 1 if low[i] == low[i - 1] else 1
        walk[i] = walk[i - 1] + 1 if (low[i - 1], low[i]) in STEPS else 1
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if low[i] in "0123":
            m = DATE.match(low, i)
            if m:
                dates.setdefault(m.end(), []).append((i, 2.1 if m.end() - i == 4 else 4.6))
    best = [0.0] + [math.inf] * n
    for end in range(1, n + 1):
        i = end - 1
        cost = best[i] + _kind(value[i])[1]
        if repeat[i] >= 3:
            cost = min(cost, best[end - repeat[i]] + SEGMENT + _kind(value[i])[1] + math.log10(repeat[i]))
        if walk[i] >= 3:
            cost = min(cost, best[end - walk[i]] + SEGMENT + math.log10(len(STEPS)) + math.log10(walk[i]))
        for size in range(2, min(LONGEST_WORD, end) + 1):
            known = words.get(low[end - size:end])
            if known is not None:
                shift = 0 if value[end - size:end].islower() else 0.5
                cost = min(cost, best[end - size] + SEGMENT + known + shift)
        for start, known in dates.get(end, ()):
            cost = min(cost, best[start] + SEGMENT + known)
        best[end] = cost
    return best[n]


def spans_of(text: str, words: dict[str, float] = WORD_COST, hard: float = HARD_TO_GUESS) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    base = sorted(found)
    starts = [s[0] for s in base]
    ends = [0, *accumulate((s[1] for s in base), max)]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}>\"'`")
        start, end = m.start(1), m.start(1) + len(value)
        # a base span meets the value if one that begins before its end reaches beyond its start
        if value != MASK and ends[bisect_right(starts, end - 1)] <= start and guess_cost(value, words) >= hard:
            found.append((start, end, "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span, and spans that overlap it, replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, words: dict[str, float] = WORD_COST) -> DataFrame:
    """Per row: the columns of ``docs`` but the text, then counts, digest and list of its spans."""
    def run(texts):
        found = [spans_of(t, words) for t in texts]
        base = [[s for s in one if s[2] != "guess"] for one in found]
        out = {f"n_{kind}": [sum(s[2] == kind for s in one) for one in found] for kind in KINDS}
        out["base_sha256"] = [hashlib.sha256(written(one).encode()).hexdigest() for one in base]
        return out | {"spans": [written(one) for one in found]}

    kind = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return map_texts(docs, run, kind, [c for c in docs.columns if c != "text"])


def redact(docs: DataFrame, words: dict[str, float] = WORD_COST) -> DataFrame:
    """``docs`` with every secret in ``text`` masked; all rows, columns and their order stay."""
    def run(texts):
        return {"__text": [masked(t, spans_of(t, words)) for t in texts], "__found": [True] * len(texts)}

    rest = [c for c in docs.columns if c != "text"]
    rows = map_texts(docs.withColumn("__null", F.col("text").isNull()), run, "__text string, __found boolean", [*rest, "__null"])
    return rows.select(*(F.when(~F.col("__null"), F.col("__text")).alias("text") if c == "text" else F.col(c) for c in docs.columns))
