"""Helpers shared by the text operators: bounded slices of Arrow batches and row columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose ``column`` holds about ``limit`` bytes; a longer single value is
    a part of its own. Null values count as empty."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]]) // limit if len(lengths) else lengths
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that a finished task has freed back to the system, as Spark goes on to use its worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, object]], schema: str, keep: list[str],
              text: str = "text", setup: Callable[[], object] | None = None) -> DataFrame:
    """Narrow pass over whole texts: ``fn`` takes a list of texts (null as empty) and returns columns of the
    same length that follow the ``keep`` columns. With ``setup``, ``fn`` gets its result as second argument,
    made once per task. ``keep`` may hold the text column itself if that is ``text``."""
    def run(batches):
        state = [setup()] if setup else []
        try:
            for batch in batches:
                for part in slices(batch):
                    made = fn([t or "" for t in part.column("text").to_pylist()], *state)
                    columns = {k: part.column(k) for k in keep} | made
                    yield pa.RecordBatch.from_pydict({k: columns[k] for k in [*keep, *made]}, schema=target)
                    columns = made = None
        finally:
            state.clear()
            release()

    kept = [df.schema[k] for k in keep]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = StructType([*kept, *_parse_datatype_string(schema).fields])
    target = to_arrow_schema(out)
    rest = [k for k in keep if k != text]
    source = df.select(*rest, F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class WordTable:
    """Per-word numbers for whole texts. ``measure`` maps a list of words to an array with one row per word;
    rows of the words met first are kept, up to ``kept``, and all others are measured when met."""

    def __init__(self, measure: Callable[[list[str]], np.ndarray], width: int, kept: int = 200_000, longest: int = 40):
        self.measure, self.kept, self.longest = measure, kept, longest
        self.code: dict[str, int] = {}
        self.rows = np.zeros((1024, width), np.float32)

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all white-space separated words, text after text, and the number of words of each text."""
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        known = list(map(self.code.get, words))
        if None not in known:
            return self.rows[np.array(known, np.int64)], counts
        missing = sorted({w for w, k in zip(words, known) if k is None}, key=len)
        n, short = len(self.code), sum(len(w) <= self.longest for w in missing)
        stay = max(0, min(short, self.kept - n))
        while len(self.rows) < n + stay:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        fresh = self.measure(missing)
        self.rows[n:n + stay] = fresh[:stay]
        self.code.update(zip(missing[:stay], range(n, n + stay)))
        rest = dict(zip(missing[stay:], range(n + stay, n + len(missing))))
        known = [k if k is not None else rest.get(w, -1) for w, k in zip(words, known)] if rest else known
        codes = np.array([self.code[w] if k is None or k < 0 else k for w, k in zip(words, known)], np.int64)
        table = np.concatenate([self.rows[:n + stay], fresh[stay:]]) if rest else self.rows
        return table[codes], counts


def ngram_buckets(words: list[str], orders: range, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every order, word number and hash bucket of each character n-gram of the words, with a space
    before and after each word."""
    joined = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    code = np.zeros(len(joined), np.uint64)
    for k in range(1, orders.stop):
        code = code[:len(joined) - k + 1] * np.uint64(0x100000001B3) + joined[k - 1:] + np.uint64(1)
        if k in orders:
            whole = owner[:len(code)] == owner[k - 1:]
            mixed = code[whole] ^ (code[whole] >> np.uint64(29))
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
            yield owner[:len(code)][whole], (mixed >> np.uint64(64 - bits)).astype(np.int64)


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` rows each; zero where a text has none."""
    sums = np.zeros((len(counts), *values.shape[1:]), np.float64)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        sums[some] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return sums
