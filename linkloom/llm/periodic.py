"""Periodic runs of words inside documents: seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q and length of at least max(6, 4 q) that no
neighbouring word extends keeping the period. Its words match those q places later over at least 3 q
places, so with q in [2^j, 2^(j+1)) every k-gram of k = 3 * 2^j words (5 for q = 1) that begins at the start
of the run comes again q places later. Level j indexes the k-grams of a document under exact names, made by
pairing the names of shorter grams; a gram that is alone in its document never gets a name, which ends the
levels early on ordinary text.

k is at least q, so inside a run consecutive occurrences of one k-gram are exactly q apart (a closer one
would be a smaller period). Consecutive occurrences are therefore all the pairs needed, linear in the words,
and those whose distance lies in the level's range are the seeds. Seeds are extended along their diagonal
(one per lag) in both directions; a table of the furthest place covered per lag skips seeds that an
extension has passed. The lag of a seed is the smallest period of what it extends to, for the same reason.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null text has no words, no runs and an empty collapsed
text; repeated rows and null ids are rows of their own; other columns are ignored; an empty table gives an
empty result. A whole text is one unit of work, however long, in memory linear in its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.texts import slices

SHORTEST, EXPONENT = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def _name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs that occur twice or more, -1 for all other places."""
    names = np.full(len(left), -1, np.int64)
    places = np.flatnonzero((left >= 0) & (right >= 0))
    if len(places) > 1:
        pairs = left[places] * (int(right.max()) + 1) + right[places]
        _, number, count = np.unique(pairs, return_inverse=True, return_counts=True)
        again = count[number] > 1
        names[places[again]] = number[again]
    return names


def _shifted(names: np.ndarray, by: int) -> np.ndarray:
    """The name ``by`` places later, -1 beyond the end."""
    out = np.full(len(names), -1, np.int64)
    if by < len(names):
        out[:len(names) - by] = names[by:]
    return out


def _seeds(grams: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of consecutive occurrences of one gram with a lag in [least, 2 * least), sorted by lag and
    place, without places that follow directly on another of the same lag (their diagonal passes them)."""
    places = np.flatnonzero(grams >= 0)
    order = places[np.argsort(grams[places], kind="stable")]
    lag = np.diff(order)
    found = (grams[order[1:]] == grams[order[:-1]]) & (lag >= least) & (lag < 2 * least)
    place, lag = order[:-1][found], lag[found]
    by_lag = np.lexsort((place, lag))
    place, lag = place[by_lag], lag[by_lag]
    first = np.ones(len(place), bool)
    first[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return place[first], lag[first]


def _matching(words: np.ndarray, at: int, lag: int, step: int, size: int = 64) -> int:
    """First place from ``at`` on, going by ``step`` (1 or -1), whose word differs from that ``lag`` later."""
    while True:
        if step > 0:
            stop = min(at + size, len(words) - lag)
            differ = np.flatnonzero(words[at:stop] != words[at + lag:stop + lag])
            if len(differ) or stop == len(words) - lag:
                return at + int(differ[0]) if len(differ) else stop
            at = stop
        else:
            stop = max(at - size + 1, 0)
            differ = np.flatnonzero(words[stop:at + 1] != words[stop + lag:at + lag + 1])
            if len(differ) or stop == 0:
                return stop + int(differ[-1]) if len(differ) else -1
            at = stop - 1
        size *= 2


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in an array of word numbers, by start, then period."""
    found = []
    words = np.asarray(words, np.int64)
    names = {1: _name(words, np.zeros_like(words)) if len(words) else words}
    least = 1
    while len(words):
        half = 2 * least
        if half not in names:
            names[half] = _name(names[least], _shifted(names[least], least))
        if least == 1:
            names[4] = _name(names[2], _shifted(names[2], 2))
            grams = _name(names[4], _shifted(names[1], 4))
        else:
            grams = _name(names[half], _shifted(names[least], half))
        covered: dict[int, int] = {}
        for place, lag in zip(*(x.tolist() for x in _seeds(grams, least))):
            if place < covered.get(lag, 0):
                continue
            start = _matching(words, place, lag, -1) + 1
            end = covered[lag] = _matching(words, place, lag, 1)
            if end - start + lag >= max(SHORTEST, EXPONENT * lag):
                found.append((start, end - start + lag, lag))
        if not (names[half] >= 0).any():
            break
        least = half
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and how many words come before each text (one more number than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), before[ends - ends[0]]


def collapse(texts: pa.Array) -> tuple[list[list[dict]], pa.Array]:
    """Runs of every text, and its words joined by one space without those that any run holds after its
    first period."""
    words, ends = _split(texts)
    counts = np.diff(ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    coded = words.dictionary_encode()
    # Numbers differ between texts, so no gram reaches from one text into another.
    number = owner * len(coded.dictionary) + coded.indices.to_numpy().astype(np.int64)
    runs = runs_of(np.unique(number, return_inverse=True)[1]) if len(number) else np.empty((0, 3), np.int64)
    of = np.searchsorted(ends, runs[:, 0], side="right") - 1
    lists: list[list[dict]] = [[] for _ in counts]
    gone = np.zeros(len(number) + 1, np.int64)
    for k, (start, length, period) in zip(of.tolist(), runs.tolist()):
        lists[k].append({"start": start - int(ends[k]), "length": length, "period": period})
        gone[start + period] += 1
        gone[start + length] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    after = np.concatenate([[0], np.cumsum(stays)])[ends]
    kept = pa.LargeListArray.from_arrays(pa.array(after, pa.int64()), words.filter(pa.array(stays)))
    return lists, pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = StructType([docs.schema["doc_id"], *_parse_datatype_string(f"runs {RUNS}, collapsed string").fields])
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                runs, collapsed = collapse(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, target.field("runs").type), collapsed],
                                                 schema=target)

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, out)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with periodic words in about a tenth of the documents, chosen by a hash of the id:
    from a place on, the words of one period come again and again. Other texts, and those without an id, stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def one(doc_id: int | None, text: str | None) -> str | None:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or text is None:
            return text
        words, g = text.encode().split(), h // 10
        if words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            times, rest = divmod(len(words) - a, p)
            words[a:] = words[a:a + p] * times + words[a:a + rest]
        return b" ".join(words).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id")
                texts = pa.array(map(one, ids.to_pylist(), part.column("text").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([ids, texts], schema=target)

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    target = to_arrow_schema(source.schema)
    return source.mapInArrow(run, source.schema)


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    def longer(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] > best["length"]), run).otherwise(best)

    none = F.lit(None).cast(RUNS[len("array<"):-1])
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, longer)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
