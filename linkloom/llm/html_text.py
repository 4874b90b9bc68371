"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is main text or not. Its own evidence (element name, words of class, id and role of it and of
the nearest element around it that has any, length and link density of its text) and a parent-child potential make up a model whose graph is the DOM tree
itself, so that one upward and one downward pass of sum-product messages give the exact probability of
every element. The weights are learned by maximum likelihood from labelled pages, whose expected counts
come from the same passes. Text under elements that are more likely main text than not is kept.

Pages are parsed with the usual recovery: unclosed and misnested tags, implied ends of paragraphs, list
items and cells, raw text in scripts and styles. A raw element that is never closed, or closes itself
(``<svg/>``) without an end tag of its own, loses its tag only; an unclosed script or style is code to the end.

Defined cases: null html gives an empty text; a page without main text too; a page without any element is
all main text; null ids and urls stay;
repeated rows are treated alike; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import labelled_pages
from linkloom.llm.texts import map_texts

#: A tag ends at ``>`` or where the next one begins; a quoted value may hold ``<`` and ``>`` where its quote is closed.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?>[^<>"'=]++|=\s*+(?:"[^"<]*+"|'[^'<]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+|["'])*+)(?:>|(?=<)|\Z)""")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
READ = frozenset("class id role itemprop data-main hidden aria-hidden style".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements whose content is no text of the page: their end tag, and their next tag of either form.
RAW = {n: (re.compile(rf"</{n}\b[^>]*>", re.I), re.compile(rf"<(/?){n}\b", re.I))
       for n in ("script", "style", "noscript", "template", "iframe", "svg", "title", "textarea", "object")}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("address article aside dialog footer form header main menu nav section".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option"}
#: An element that ends open elements of the given names, up to the nearest of the given borders.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
           "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "td", "th"), ("table",)),
           "tbody": (("tr", "td", "th", "tbody", "thead"), ("table",)), "body": (("head",), ())}


@dataclass
class Page:
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: ["#root"])
    words: list[tuple] = field(default_factory=lambda: [()])
    marks: dict[int, int] = field(default_factory=dict)
    pieces: list[tuple[int, str]] = field(default_factory=list)
    """(element, text) in page order; element -1 ends a block"""


class Open:
    """The open elements of a page, with the places of each name."""

    def __init__(self) -> None:
        self.stack, self.names = [0], ["#root"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.stack.append(node)
        self.names.append(name)

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names; 0 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def first_after(self, border: int, names: tuple) -> int:
        """Place of the outermost open element of these names inside ``border``; 0 if there is none."""
        found = [at[k] for at in map(self.places.get, names) if at and (k := bisect_right(at, border)) < len(at)]
        return min(found, default=0)

    def close(self, place: int) -> None:
        """Ends the element at ``place`` and all inside it; place 0 is none."""
        if place:
            for name in self.names[place:]:
                self.places[name].pop()
            del self.names[place:], self.stack[place:]


def parse(source: str) -> Page:
    page = Page()
    opened, at, size = Open(), 0, len(source)
    stack, unclosed = opened.stack, set()
    pieces, find, tag_at = page.pieces, source.find, TAG.match
    while at < size:
        start = find("<", at)
        if start < 0:
            start = size
        if start > at:
            pieces.append((stack[-1], source[at:start]))
        if start == size:
            break
        found = tag_at(source, start)
        if not found:
            if source.startswith("<!--", start):
                end = find("-->", start + 4)
                at = size if end < 0 else end + 3
            elif source[start + 1:start + 2] in ("!", "?", "/"):
                end = find(">", start)
                at = size if end < 0 else end + 1
            else:
                pieces.append((stack[-1], "<"))
                at = start + 1
            continue
        at = found.end()
        closing, name, rest = found.groups()
        name = name.lower()
        if name in BLOCKS:
            pieces.append((-1, ""))
        elif name == "br":
            pieces.append((stack[-1], " "))
        if closing:
            opened.close(opened.last(name))
            continue
        if name in RAW:
            if name not in unclosed:
                at = _after_raw(source, at, name, rest, unclosed)
            continue
        if name in CLOSES_P:
            place = opened.last("p")
            if place > opened.last("td", "th", "table", "button"):
                opened.close(place)
        if name in IMPLIED:
            ended, borders = IMPLIED[name]
            opened.close(opened.first_after(opened.last(*borders), ended))
        if name in VOID:
            continue
        node = len(page.tags)
        page.parent.append(stack[-1])
        page.depth.append(len(stack))
        page.tags.append(name)
        page.words.append(_words(node, rest, page.marks) if rest and not rest.isspace() else ())
        opened.push(node, name)
    return page


def _after_raw(source: str, at: int, name: str, rest: str, unclosed: set[str]) -> int:
    """Where reading goes on after the start tag of a raw element that ends at ``at``."""
    end_tag, next_tag = RAW[name]
    if rest.endswith("/"):
        after = next_tag.search(source, at)
        if not after or not after[1]:
            return at
    end = end_tag.search(source, at)
    if end:
        return end.end()
    if name in ("script", "style"):
        return len(source)
    unclosed.add(name)
    return at


def _words(node: int, rest: str, marks: dict[int, int]) -> tuple:
    out = []
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in READ:
            continue
        if name == "data-main":
            marks[node] = int(value == "1")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.append("~hidden")
        elif name == "style":
            if re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("~hidden")
        elif name != "aria-hidden":
            out += [w.lower() for w in WORD.findall(value)]
    return tuple(out)


def _bands(values: np.ndarray, limits: list[float], name: str) -> list[str]:
    return [f"{name}{k}" for k in np.searchsorted(limits, values, side="right")]


@dataclass
class Forest:
    """The elements of many pages in one numbering, and the features of each."""
    parent: np.ndarray
    levels: list[np.ndarray]
    owner: np.ndarray
    feature: np.ndarray
    size: int


def forest(pages: list[Page], index: dict[str, int], grow: bool = False) -> Forest:
    base = np.cumsum([0] + [len(p.tags) for p in pages])
    size = int(base[-1])
    parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base)]) if pages else np.empty(0, np.int64)
    depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.empty(0, np.int64)
    tags = [t for p in pages for t in p.tags]
    text, node = [], []
    for p, b in zip(pages, base.tolist()):
        for k, piece in p.pieces:
            if k >= 0:
                text.append(len(piece) - piece.count("\n") if not piece.isspace() else 0)
                node.append(k + b)
    own = np.bincount(np.array(node, np.int64), np.array(text, float), size).astype(float) if size else np.empty(0)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, (depth.max() if size else 0) + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    all_text, linked = own.copy(), own * np.array([t == "a" for t in tags], float) if size else own
    for level in reversed(levels):
        tag_a = np.array([tags[k] == "a" for k in level.tolist()], bool)
        linked[level[tag_a]] = all_text[level[tag_a]]
        np.add.at(all_text, parent[level], all_text[level])
        np.add.at(linked, parent[level], linked[level])
    density = linked / np.maximum(all_text, 1)
    near = _bands(own, [1, 20, 80, 200], "own")
    whole = _bands(all_text, [1, 40, 150, 600], "all")
    links = _bands(density, [0.01, 0.2, 0.5, 0.8], "links")
    known: dict[tuple, list[int]] = {}
    owner, feature = [], []
    place = (lambda f: index.setdefault(f, len(index))) if grow else index.get
    words = [w for p in pages for w in p.words]
    up = parent.tolist()
    around: list[tuple] = [()] * size
    for k in range(size):
        above, inside = "-", ()
        if up[k] >= 0 and depth[k]:
            above = tags[up[k]]
            inside = around[up[k]]
        key = (tags[k], above, words[k], near[k], whole[k], links[k], inside)
        section = (tags[k], f"{tags[k]} in {inside[0] if inside else '-'}") if tags[k] in SECTIONS else ()
        around[k] = section + words[k] or inside
        ids = known.get(key)
        if ids is None:
            made = [f"tag {key[0]}", f"tag {key[0]} in {above}", near[k], whole[k], links[k], f"{whole[k]} {links[k]}", *(f"word {w}" for w in key[2]),
                    *(f"inside {w}" for w in inside)]
            ids = known[key] = [i for i in map(place, made) if i is not None]
        owner += [k] * len(ids)
        feature += ids
    return Forest(parent, levels, np.array(owner, np.int64), np.array(feature, np.int64), size)


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(trees: Forest, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product over all trees: P(main) per element, P(parent, child) summed over edges, log partition.
    ``weights``: evidence of a feature for main text; ``pair[p, c]``: potential of parent and child states."""
    own = np.zeros((trees.size, 2))
    own[:, 1] = np.bincount(trees.owner, weights[trees.feature], trees.size)
    inside, up = own.copy(), np.zeros((trees.size, 2))
    for level in reversed(trees.levels):
        at = inside[level]
        for p in (0, 1):
            up[level, p] = _log_sum(at[:, 0] + pair[p, 0], at[:, 1] + pair[p, 1])
            np.add.at(inside[:, p], trees.parent[level], up[level, p])
    outside, edges = np.zeros((trees.size, 2)), np.zeros((2, 2))
    total = _log_sum(inside[:, 0], inside[:, 1])
    for level in trees.levels:
        above = trees.parent[level]
        rest = outside[above] + inside[above] - up[level]
        for c in (0, 1):
            outside[level, c] = _log_sum(rest[:, 0] + pair[0, c], rest[:, 1] + pair[1, c])
        joint = rest[:, :, None] + pair + inside[level][:, None, :]
        norm = _log_sum(_log_sum(joint[:, 0, 0], joint[:, 0, 1]), _log_sum(joint[:, 1, 0], joint[:, 1, 1]))
        edges += np.exp(joint - norm[:, None, None]).sum(0)
    belief = inside + outside
    main = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return main, edges, total[trees.parent < 0] if trees.size else total


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray


def train(sources: list[str], rounds: int = 250, rate: float = 0.3, shrink: float = 0.0005) -> Model:
    """Maximum likelihood with adaptive gradient steps. Elements inherit the nearest ``data-main`` mark."""
    pages, index = [parse(s) for s in sources], {}
    trees = forest(pages, index, grow=True)
    trees.parent[np.cumsum([0] + [len(p.tags) for p in pages])[:-1]] = -1
    labels = np.zeros(trees.size, np.int64)
    base = 0
    for p in pages:
        for k in range(1, len(p.tags)):
            labels[base + k] = p.marks.get(k, labels[base + p.parent[k]])
        base += len(p.tags)
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[trees.parent[child]], labels[child]), 1)
    target = np.bincount(trees.feature, labels[trees.owner], len(index))
    weights, pair = np.zeros(len(index)), np.zeros((2, 2))
    past, past_pair = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        main, edges, _ = marginals(trees, weights, pair)
        step = target - np.bincount(trees.feature, main[trees.owner], len(index)) - shrink * weights * len(pages)
        past += step ** 2
        weights += rate * step / np.sqrt(past)
        step = seen - edges
        past_pair += step ** 2
        pair += rate * step / np.sqrt(past_pair)
    return Model(index, weights, pair)


def trained() -> Model:
    return train(labelled_pages.pages())


def texts_of(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    trees = forest(pages, model.index)
    base = np.cumsum([0] + [len(p.tags) for p in pages])
    trees.parent[base[:-1]] = -1
    main = (marginals(trees, model.weights, model.pair)[0] > 0.5).tolist()
    out = []
    for page, b in zip(pages, base.tolist()):
        main[b] |= len(page.tags) == 1
        blocks, block = [], []
        for node, piece in page.pieces:
            if node < 0:
                if block:
                    blocks.append(" ".join("".join(block).split()))
                    block = []
            elif main[b + node]:
                block.append(html.unescape(piece) if "&" in piece else piece)
        blocks.append(" ".join("".join(block).split()))
        out.append("\n".join(b for b in blocks if b))
    return out


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Per page: the columns of ``pages`` but the html, then ``text`` and ``n_chars``."""
    def run(sources):
        texts = texts_of(sources, model)
        return {"main_text": texts, "n_chars": [len(t) for t in texts]}

    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    return map_texts(pages, run, "main_text string, n_chars long", keep, text="html").select(
        *keep, F.col("main_text").alias("text"), "n_chars")
