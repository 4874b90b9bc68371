"""Near-duplicate documents by a join on the Jaccard similarity of word n-grams, with a MinHash LSH forest.

Every document's signature fills a number of tries, each of which reads its own part of the signature as a
path. The paths of a trie are sorted, so the documents that share a prefix are a range of them. A document's
match starts at its full path and is shortened in every trie as long as the range stays within a limit, the
same for all tries: where documents are dense the prefix stays long, where they are rare it becomes short. The
limit is raised, document by document, until a partner at the threshold shares one of its matched prefixes
with the target recall. Documents that are short of it at the largest limit, as in large groups of near copies,
match with the one prefix length that gives the recall whatever the sizes; their ranges meet in blocks.

Documents of a matched range whose signatures agree well enough form candidate groups, emitted as spanning
stars and never as pairs. In each group all documents are then compared exactly, by the sets of their word
n-grams, in bounded blocks: links are counted there, and components come from verified links only.

Documents with the same words in the same order are one class, found by a digest before anything else.
Words are runs of non-white-space characters as they stand; a text with fewer words than an n-gram is one
n-gram of all its words.

Defined cases: null texts and texts without a word link with nothing; a null id stays null in its row and
counts as larger than any other; repeated rows are documents of their own, and ``keep_one`` keeps a single
one of them; an empty table gives an empty result; other columns are kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.groups import BLOCK_KEYS, Union, count_links, in_blocks, roots, runs
from linkloom.llm.texts import map_texts, ragged
from linkloom.runtime import cut

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.9999
SLACK = 5.0
WINDOW = 24
FLOOR = 2
"""values in the shortest prefix that is matched below the largest limit"""
LIMITS = (16, 64, 256, 1024)
"""rows of a matched range, raised for a document until its recall is reached"""
SORTED_ROWS = 1 << 14
"""rows that are sorted together; larger ranges are split by their next value first"""
TRIE_ROWS = 2048
BLOCK_WEIGHT = 2 << 20
"""bytes of text in a block of the exact comparison; longer single texts are blocks of their own"""
SEED = 41

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Longest path prefix that a pair at ``threshold`` shares in some trie with probability ``recall``."""
    for length in range(DEPTH, 1, -1):
        if 1 - (1 - threshold ** length) ** TREES >= recall:
            return length
    return 1


def least_agreement(threshold: float = THRESHOLD, slack: float = SLACK) -> int:
    """Equal signature values that a pair at ``threshold`` has, less ``slack`` standard deviations."""
    n = TREES * DEPTH
    return math.floor(n * threshold - slack * math.sqrt(n * threshold * (1 - threshold)))


def ngrams(texts: list[str], words: int = WORDS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Word hashes and n-gram hashes of every text, in order."""
    own, grams = [], []
    for text in texts:
        split = text.split()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
        own.append(h)
        k = min(words, len(h))
        g = np.zeros(max(0, len(h) - k + 1) if k else 0, np.uint64)
        for i in range(k):
            g += h[i:i + len(g)] * STEPS[i]
        g ^= g >> np.uint64(32)
        grams.append(g * STEPS[-1 - k] if k else g)
    return own, grams


def signatures(grams: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bit) per text; texts without an n-gram have the largest value everywhere."""
    sizes = np.array([len(g) for g in grams])
    out = np.full((len(grams), TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([grams[i] for i in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        for k, factor in enumerate(FACTORS):
            out[some, k] = np.minimum.reduceat(((flat * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def documents_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Per row: ``keep``, digest of its words, weight, and ``paths``: 16 bits of every signature value, trie after trie."""
    def run(texts):
        own, grams = ngrams(texts)
        made = (signatures(grams) & np.uint32(0xFFFF)).astype(">u2")
        return {"digest": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in own],
                "weight": [max(64, len(t)) for t in texts], "paths": [s.tobytes() for s in made]}

    return map_texts(docs, run, "digest binary, weight long, paths binary", keep)


def _candidates(ids: np.ndarray, signature: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the documents of one range whose signatures agree in ``least`` values or more."""
    order = np.lexsort(signature.T[:8][::-1])
    ids, signature = ids[order], signature[order]
    union = Union(len(ids))
    for step in range(1, min(WINDOW, len(ids) - 1) + 1):
        open_ = np.flatnonzero(union.root[:-step] != union.root[step:])
        near = (signature[open_] == signature[open_ + step]).sum(1) >= least
        union.join(open_[near], open_[near] + step)
    if len(ids) > WINDOW:
        # Beyond the window only rows outside the largest set are left to compare, with all rows.
        names, sizes = np.unique(union.root, return_counts=True)
        for i in np.flatnonzero(union.root != names[sizes.argmax()]).tolist():
            open_ = np.flatnonzero(union.root != union.root[i])
            near = open_[(signature[open_] == signature[i]).sum(1) >= least]
            union.join(np.full(len(near), i), near)
    return union.stars(ids)


def _values(paths: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(paths), ">u2").reshape(len(paths), -1)


def ranges(root: np.ndarray, path: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of the range of every row among sorted rows, a line for each prefix length from ``floor`` on."""
    shared = np.zeros(len(root), np.int64)
    shared[1:] = np.where(root[1:] == root[:-1], np.cumprod(path[1:] == path[:-1], axis=1).sum(1), 0)
    lows, ends = [], []
    for length in range(floor, DEPTH + 1):
        head = np.flatnonzero(shared < length)
        end = np.append(head[1:], len(root))
        lows.append(np.repeat(head, end - head))
        ends.append(np.repeat(end, end - head))
    return np.array(lows), np.array(ends)


def matched(size: np.ndarray, depth: np.ndarray, limit: int, floor: int) -> np.ndarray:
    """Length of the shortest prefix whose range has ``limit`` rows at most, 0 where there is none. ``size`` has a line for
    each length from ``floor`` on; those under ``depth`` are of a range that was split. It is the same for all rows
    of the range found, as they share all shorter prefixes too."""
    fits = (size <= limit) & (np.arange(floor, DEPTH + 1)[:, None] >= depth)
    return np.where(fits.any(0), fits.argmax(0) + floor, 0)


def _whole_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, sorted by ``root``, so that no root is in two frames."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        cut_at = np.searchsorted(pdf["root"].to_numpy(), pdf["root"].iloc[-1]) if len(pdf) else 0
        if cut_at:
            yield pdf.iloc[:cut_at]
        rest = pdf.iloc[cut_at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _prefix(length: int):
    return F.xxhash64("tree", F.substring("path", 1, 2 * length))


def tries(classes: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """(id, tree, path, root, depth) of the paths that share their first ``floor`` values with another: ``root`` is the
    range of the shortest such prefix, of ``depth`` values, that has ``SORTED_ROWS`` rows at most. Second, without
    root and depth, the paths that even in full have more."""
    paths = classes.select("id", F.posexplode(F.array(*[F.substring("paths", 1 + 2 * DEPTH * k, 2 * DEPTH) for k in range(TREES)])).alias("tree", "path"))
    rest, rooted = paths, None
    for depth in range(floor, DEPTH + 1):
        coded = rest.withColumn("root", _prefix(depth))
        sizes = coded.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("root", "of")
        sizes = sizes.filter("n > 1") if depth == floor else sizes
        sized = cut(coded.join(sizes, F.col("root") == F.col("of")).drop("of"))
        fit = sized.filter(F.col("n") <= SORTED_ROWS).select("id", "tree", "path", "root", F.lit(depth).alias("depth"))
        rooted = fit if rooted is None else rooted.unionByName(fit)
        rest = sized.filter(F.col("n") > SORTED_ROWS).select("id", "tree", "path")
        if rest.isEmpty():
            break
    return rooted, rest


def limits_of(rooted: DataFrame, crowded: DataFrame, threshold: float, recall: float, floor: int,
              limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """(id, asked): number of the smallest of ``limits`` at which the matched prefixes of a document give ``recall``,
    the number of limits if none does. A trie of matched length d misses a partner with probability 1 - threshold ** d;
    one where the document shares nothing is as good as matched at ``floor``."""
    names = [f"miss{k}" for k in range(len(limits))]

    def misses(batches):
        for pdf in _whole_ranges(batches):
            low, end = ranges(pdf["root"].to_numpy(), _values(pdf["path"]), floor)
            found = [matched(end - low, pdf["depth"].to_numpy(), limit, floor) for limit in limits]
            with np.errstate(divide="ignore"):
                yield pd.DataFrame({"id": pdf["id"], **{n: np.where(d > 0, np.log1p(-threshold ** np.maximum(d, 1)), 0.0) for n, d in zip(names, found)}})

    ordered = rooted.repartition("root").sortWithinPartitions("root", "path", "id")
    parts = ordered.mapInPandas(misses, "id long, " + ", ".join(f"{n} double" for n in names))
    parts = parts.unionByName(crowded.select("id", *[F.lit(0.0).alias(n) for n in names]))
    sums = parts.groupBy("id").agg(F.count(F.lit(1)).alias("shared"), *[F.sum(n).alias(n) for n in names])
    alone = (F.lit(TREES) - F.col("shared")) * F.lit(math.log1p(-threshold ** floor) if threshold < 1 else -math.inf)
    alone = F.when(F.col("shared") < TREES, alone).otherwise(0.0)
    asked = F.coalesce(*[F.when(F.col(n) + alone <= math.log1p(-recall), F.lit(k)) for k, n in enumerate(names)], F.lit(len(limits)))
    return sums.select("id", asked.alias("asked"))


def _search(pdf: pd.DataFrame, floor: int, least: int, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Stars inside the ranges that some row of these sorted rows asks for, each within the largest that holds it."""
    ids, asked = pdf["id"].to_numpy(), pdf["asked"].to_numpy()
    low, end = ranges(pdf["root"].to_numpy(), _values(pdf["path"]), floor)
    found = [np.empty((0, 2), np.int64)]
    for k, limit in enumerate(limits):
        length = matched(end - low, pdf["depth"].to_numpy(), limit, floor)
        at = np.flatnonzero((asked == k) & (length > 0))
        line = length[at] - floor
        found.append(np.stack([low[line, at], end[line, at]], 1))
    found = np.unique(np.concatenate(found), axis=0)
    found = found[found[:, 1] - found[:, 0] > 1]
    found = found[np.lexsort((-found[:, 1], found[:, 0]))]
    before = np.maximum.accumulate(np.concatenate([[0], found[:, 1]]))[:-1]
    found = found[found[:, 0] >= before]
    signature = _values(pdf["paths"]).astype(np.uint8)
    sizes = found[:, 1] - found[:, 0]
    stars = [_candidates(ids[a:b], signature[a:b], least) for a, b in found[sizes > WINDOW + 1].tolist()]
    small = found[sizes <= WINDOW + 1]
    span = np.full(len(ids), -1)
    span[ragged(small[:, 0], small[:, 1] - small[:, 0])] = np.repeat(np.arange(len(small)), small[:, 1] - small[:, 0])
    union = Union(len(ids))
    for step in range(1, min(WINDOW, len(ids) - 1) + 1):
        open_ = np.flatnonzero((span[:-step] == span[step:]) & (span[step:] >= 0) & (union.root[:-step] != union.root[step:]))
        near = (signature[open_] == signature[open_ + step]).sum(1) >= least
        union.join(open_[near], open_[near] + step)
    stars.append(union.stars(ids))
    return tuple(np.concatenate([s[i] for s in stars]) for i in range(2))


def candidate_groups(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                     limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """(id, root) of the classes that share a matched prefix with a similar class."""
    least, length = least_agreement(threshold), prefix_length(threshold, recall)
    floor = min(FLOOR, length)
    rooted, crowded = tries(classes, floor)
    reached = cut(limits_of(rooted, crowded, threshold, recall, floor, limits))

    def search(batches):
        for pdf in _whole_ranges(batches):
            a, b = _search(pdf, floor, least, limits)
            yield pd.DataFrame({"a": a, "b": b})

    known = classes.select("id", "paths").join(reached, "id")
    placed = rooted.join(known, "id").repartition("root").sortWithinPartitions("root", "path", "id")
    stars = placed.mapInPandas(search, "a long, b long")
    short = reached.filter(F.col("asked") == len(limits)).select("id")
    if not short.isEmpty():
        paths = rooted.select("id", "tree", "path").unionByName(crowded).select("id", _prefix(length).alias("range"))
        asked = paths.join(short, "id", "left_semi").select(F.col("range").alias("of")).distinct()
        met = paths.join(asked, F.col("range") == F.col("of"), "left_semi").join(classes.select("id", "paths"), "id")

        def crowd(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, signature = pdf["id"].to_numpy(), _values(pdf["paths"]).astype(np.uint8)
            found = [_candidates(ids[at], signature[at], least) for at in runs(pdf["range"].to_numpy())]
            return pd.DataFrame({k: np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i, k in enumerate("ab")})

        blocks = in_blocks(met, "range", TRIE_ROWS).groupBy(*BLOCK_KEYS)
        stars = stars.unionByName(blocks.applyInPandas(crowd, "a long, b long"))
    return roots(stars)


def _overlaps(sets: list[np.ndarray]):
    """Function that gives the matrix of common members of two lists of sets, by numbers in ``sets``. Beside that
    matrix it holds members of the asked sets only, ``width`` at a time."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    members, column = np.unique(np.concatenate(sets), return_inverse=True)
    width = 4096

    def placed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(a)), sizes[a]), column[ragged((ends - sizes)[a], sizes[a])]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (row_a, of_a), (row_b, of_b) = placed(a), placed(b)
        both = np.intersect1d(of_a, of_b)
        number = np.full(len(members), -1, np.int32)
        number[both] = np.arange(len(both))
        of_a, of_b = number[of_a], number[of_b]
        total = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, len(both), width):
            part = []
            for row, of, n in ((row_a, of_a, len(a)), (row_b, of_b, len(b))):
                here = (of >= at) & (of < at + width)
                part.append(np.zeros((n, min(width, len(both) - at)), np.float32))
                part[-1][row[here], of[here] - at] = 1
            total += part[0] @ part[1].T
        return total

    return common, sizes


def verified(classes_with_text: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Exact comparison inside candidate groups (id, root, copies, weight, text): links per id and the stars."""
    def exact(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies, block = (pdf[c].to_numpy() for c in ("id", "copies", "block"))
        parts = []
        for at in runs(pdf["root"].to_numpy()):
            sets = [np.unique(g) for g in ngrams(pdf["text"].iloc[at].tolist())[1]]
            common, sizes = _overlaps(sets)

            def alike(a, b):
                both = common(a, b)
                return both >= threshold * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-6

            links, union = count_links(block[at], *key[2:], copies[at], alike)
            parts.append(pd.DataFrame({"id": ids[at], "links": links, "to": -1}))
            a, b = union.stars(ids[at])
            parts.append(pd.DataFrame({"id": a, "links": 0, "to": b}))
        return pd.concat(parts) if parts else pd.DataFrame({"id": [], "links": [], "to": []})

    blocks = in_blocks(classes_with_text, "root", BLOCK_WEIGHT, "weight")
    rows = cut(blocks.groupBy(*BLOCK_KEYS).applyInPandas(exact, "id long, links long, to long"))
    links = rows.filter("`to` < 0").groupBy("id").agg(F.sum("links").alias("links"))
    return links, rows.filter("`to` >= 0").select(F.col("id").alias("a"), F.col("to").alias("b"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_sha256, class_id (smallest id with the same words), n_links
    (other rows at or over the threshold), component_id (smallest id that links reach), kept (is that id), worded, and
    component, the component itself: ids repeat or are null, so unrelated components can have one component_id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("text_sha256", F.sha2(F.col("text"), 256))
    rows = cut(documents_of(source, ["doc_id", "text_sha256"]))
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"),
        F.min_by("text_sha256", F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")).alias("sha"),
        F.first("paths").alias("paths"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    grouped = cut(candidate_groups(classes, threshold, recall, limits))
    asked = cut(classes.join(grouped, "id").select("id", "root", "copies", "weight", "class_id", "sha"))
    texts = source.join(asked, source["doc_id"].eqNullSafe(asked["class_id"]) & (source["text_sha256"] == asked["sha"]))
    texts = texts.select("id", "root", "copies", "weight", "text").dropDuplicates(["id"])
    links, stars = verified(texts, threshold)
    reached = cut(roots(stars))
    named = classes.select("id", "digest", "class_id", "copies").join(links, "id", "left").join(reached, "id", "left")
    named = cut(named.withColumn("root", F.coalesce("root", "id")))
    smallest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("digest").alias("of"), "class_id", "component_id", F.col("root").alias("component"),
                                                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "text_sha256", "digest").join(named, F.col("digest") == F.col("of"), "left")
    smallest_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_sha256", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      smallest_id.alias("component_id"), F.col("doc_id").eqNullSafe(smallest_id).alias("kept"),
                      F.col("digest").isNotNull().alias("worded"), "component")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of every component: the smallest id, and of that id's equal or similar texts
    the one with the smallest digest. Documents without a word all stay."""
    found = cut(join(docs, threshold))
    best = found.filter("kept AND worded").groupBy("component").agg(
        F.min("component_id").alias("__id"), F.min("text_sha256").alias("__sha"), F.count(F.lit(1)).alias("rows"))
    best = cut(best.select("__id", "__sha", "rows"))
    names = docs.columns
    hashed = docs.withColumn("__sha", F.sha2(F.col("text").cast("string"), 256))
    worded = F.coalesce(F.col("text").rlike(r"(?U)[^\s\x1C-\x1F]"), F.lit(False))
    stay = hashed.filter(~worded).select(*names)
    keys = best.select("__id", F.col("__sha").alias("__of"))
    rest = hashed.filter(worded).join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__of")), "left_semi")
    if best.agg(F.max("rows")).first()[0] not in (None, 1):
        rest = rest.dropDuplicates(["doc_id", "__sha"])
    return rest.select(*names).unionByName(stay)
