"""HTML extraction with a tree-structured graphical model.

Each DOM node is content or not. A node's features (kind, amount of text in and under it, share of links, punctuation,
place, depth) depend on its own label, and its label on its parent's; these potentials are relative frequencies on
labelled pages. Sum-product messages go up the tree and down again, level by level for many pages at once, and yield
each node's marginal probability of being content. Text nodes with at least ``THRESHOLD`` make the text.

Pages are labelled by their own mark-up: what lies in an ``article`` or ``main`` element is content. The features
call those elements ``div``, so the model learns what content looks like without them. Other labels can be given to
:func:`fit` as a function from a parsed page to a label for each node. It is fitted on about ``TRAIN_PAGES`` labelled
pages, chosen by a hash of the page.

Defined results: null and empty pages, and such without text, have an empty text and no nodes; what isn't well-formed
is parsed as browsers would about do; ids are passed through, whatever their type; null ids and repeated rows stay.
With no labelled page all visible text is kept. Time is in proportion to a page's length, however it is nested or broken.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches
from . import columnar as C

TRAIN_PAGES = 3000
THRESHOLD = 0.5
_BATCH_BYTES = 4 << 20
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAME = re.compile(r"""\b(?:class|id)\s*=\s*["']?\s*([^\s"'>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body div article main section aside nav header footer ul ol dl table td th form blockquote figure".split())
_KINDS = {t: i + 2 for i, t in enumerate("a article aside b blockquote body br button code div em figure footer form h1 h2 h3 h4 h5 h6 head header html i img li main nav ol p pre script section small span strong style table tbody td th title tr ul".split())}
for _t in ("article", "main"):
    _KINDS[_t] = _KINDS["div"]
_TEXT, _OTHER_TAG = 0, 1
#: Levels of each feature: kind, kind of the parent, text under it, link share, punctuation, place, depth, class or id (of the parent for text).
LEVELS = (64, 64, 18, 6, 6, 10, 12, 64)


class Page:
    """Nodes in document order: parent, tag ('' for text), text, and a number for the class or id (0 for none)."""

    __slots__ = ("parent", "tag", "text", "mark")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.text: list[str] = []
        self.mark: list[int] = []

    def add(self, parent: int, tag: str, text: str = "", mark: int = 0) -> int:
        self.mark.append(mark)
        self.parent.append(parent)
        self.tag.append(tag)
        self.text.append(text)
        return len(self.parent) - 1


def parse(source: str) -> Page:
    """The tree of a page. Hidden text (scripts and the like) has no node."""
    page = Page()
    stack = [page.add(-1, "html")]
    open_at: dict[str, list[int]] = {}  # places in the stack of each open tag
    scopes = [0]  # and of those that tags outside don't close
    at, end, last = 0, len(source), source.rfind(">")

    def close_from(k: int) -> None:
        for node in stack[k:]:
            open_at[page.tag[node]].pop()
        del stack[k:]
        while scopes[-1] >= k:
            scopes.pop()

    while at < end:
        found = _TAG.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
        upto = found.start() if found else end
        if upto > at and not (text := source[at:upto]).isspace():
            page.add(stack[-1], "", text)
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name = name.lower()
        if found[1] or found[4]:
            if (places := open_at.get(name)) and (name in _SCOPE or places[-1] >= scopes[-1]):
                close_from(places[-1])
            continue
        if name == "html":
            continue
        closes = _SIBLING.get(name) or ({"p"} if name in _CLOSES_P else ())
        k = max((places[-1] for t in closes if (places := open_at.get(t))), default=-1)
        if k > 0 and k >= scopes[-1]:
            close_from(k)
        named = _NAME.search(found[3] or found[6] or "")
        node = page.add(stack[-1], name, "", zlib.crc32(named[1].lower().encode("utf-8", "replace")) % 63 + 1 if named else 0)
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            if name in ("title", "textarea") and (text := source[at : close.start() if close else end]).strip():
                page.add(node, "", text)
            at = close.end() if close else end
        elif name not in _VOID and not (found[3] or found[6] or "").endswith("/"):
            open_at.setdefault(name, []).append(len(stack))
            if name in _SCOPE:
                scopes.append(len(stack))
            stack.append(node)
    return page


def marked(page: Page) -> np.ndarray | None:
    """Labels by mark-up: 1 in article or main; None where a page has neither."""
    label = np.zeros(len(page.parent), np.int64)
    for i, (p, t) in enumerate(zip(page.parent, page.tag)):
        label[i] = 1 if t in ("article", "main") or (p >= 0 and label[p]) else 0
    return label if label.any() else None


class Forest:
    """The trees of many pages: parents, levels and features of all nodes."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.first, n = first, int(first[-1])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, n)
        self.root = parent < 0
        self.parent = np.where(self.root, np.arange(n), parent + first[self.page])
        depth = [0] * n
        for i, (p, r) in enumerate(zip(self.parent.tolist(), self.root.tolist())):
            if not r:
                depth[i] = depth[p] + 1
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if n else []
        kinds = np.fromiter((_KINDS.get(t, _OTHER_TAG) if t else _TEXT for p in pages for t in p.tag), np.int64, n)
        size = np.fromiter((len(t) for p in pages for t in p.text), np.float64, n)
        marks = np.fromiter((t.count(",") + t.count(".") if t else 0 for p in pages for t in p.text), np.float64, n)
        marks_of = np.fromiter((x for p in pages for x in p.mark), np.int64, n)
        before = np.cumsum(size) - size
        in_link = kinds == _KINDS["a"]
        for level in self.levels[1:]:
            in_link[level] |= in_link[self.parent[level]]
        sums = np.stack((size, np.where(in_link, size, 0), marks))
        for level in self.levels[:0:-1]:
            for row in sums:
                np.add.at(row, self.parent[level], row[level])
        total = np.maximum(sums[0][first[self.page]], 1) if n else size
        offset = before - (before[first[self.page]] if n else 0)
        some = np.maximum(sums[0], 1)
        self.features = np.stack((
            kinds, kinds[self.parent], np.minimum(np.log2(sums[0] + 1) * 1.2, LEVELS[2] - 1).astype(np.int64), np.minimum(sums[1] / some * 5, 5).astype(np.int64),
            np.minimum(sums[2] / some * 100, 5).astype(np.int64), np.minimum(offset / total * 10, 9).astype(np.int64), np.minimum(self.depth, LEVELS[6] - 1), np.where(kinds == _TEXT, marks_of[self.parent], marks_of),
        )) if n else np.zeros((len(LEVELS), 0), np.int64)


class Potentials:
    """Logarithms: of the root's label, of a child's label under each of its parent, and of each feature under each label."""

    def __init__(self, root: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.root = np.log((root + 1) / (root + 1).sum())
        self.step = np.log((step + 1) / (step + 1).sum(1, keepdims=True))
        self.emit = [np.log((e + 1) / (e + 1).sum(1, keepdims=True)) for e in emit]


def counts(forest: Forest, label: np.ndarray) -> np.ndarray:
    """All frequencies in one row of numbers."""
    child = ~forest.root
    parts = [np.bincount(label[forest.root], minlength=2), np.bincount(label[forest.parent[child]] * 2 + label[child], minlength=4)]
    parts += [np.bincount(label * n + f, minlength=2 * n) for n, f in zip(LEVELS, forest.features)]
    return np.concatenate(parts)


def potentials(row: np.ndarray) -> Potentials:
    cut = np.split(row.astype(float), np.cumsum([2, 4, *(2 * n for n in LEVELS)])[:-1])
    return Potentials(cut[0], cut[1].reshape(2, 2), [c.reshape(2, n) for c, n in zip(cut[2:], LEVELS)])


def unary(forest: Forest, model: Potentials) -> np.ndarray:
    return sum(e[:, f].T for e, f in zip(model.emit, forest.features))


def marginals(parent: np.ndarray, root: np.ndarray, levels: list[np.ndarray], own: np.ndarray, root_log: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every node, by messages up and down the trees."""
    n = len(parent)
    below = own + np.where(root[:, None], root_log, 0.0)
    up = np.zeros((n, 2))
    for level in levels[:0:-1]:
        for y in range(2):
            up[level, y] = np.logaddexp(step[y, 0] + below[level, 0], step[y, 1] + below[level, 1])
        for y in range(2):
            np.add.at(below[:, y], parent[level], up[level, y])
    belief = below.copy()
    for level in levels[1:]:
        rest = belief[parent[level]] - up[level]  # what the parent knows apart from this child
        for y in range(2):
            belief[level, y] += np.logaddexp(rest[:, 0] + step[0, y], rest[:, 1] + step[1, y])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def text_of(page: Page, keep: np.ndarray) -> str:
    """The kept text nodes, a line for each block."""
    lines: list[str] = []
    held: list[str] = []
    block = -2
    owner: list[int] = []
    for i, (p, t) in enumerate(zip(page.parent, page.tag)):
        owner.append(i if t in _BLOCK or p < 0 else owner[p])
        if t == "br" and held:
            block = -2
        if not t and keep[i]:
            if owner[i] != block and held:
                lines.append("".join(held))
                held = []
            block = owner[i]
            held.append(html.unescape(page.text[i]) if "&" in page.text[i] else page.text[i])
    lines.append("".join(held))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Page]]]:
    for batch in batches:
        first, size, pages = 0, 0, []
        for i, source in enumerate(batch.column("html").to_pylist()):
            pages.append(parse(source) if source else Page())
            size += len(source or "")
            if size > _BATCH_BYTES:
                yield batch.slice(first, i + 1 - first), pages
                first, size, pages = i + 1, 0, []
        if pages:
            yield batch.slice(first), pages


def _count(labels: Callable[[Page], np.ndarray | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6 + 2 * sum(LEVELS), np.int64)
        for _, pages in _groups(batches):
            both = [(p, y) for p in pages if p.parent and (y := labels(p)) is not None]
            if both:
                total += counts(Forest([p for p, _ in both]), np.concatenate([y for _, y in both]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["counts"])

    return run


def fit(pages: DataFrame, html_col: str = "html", labels: Callable[[Page], np.ndarray | None] = marked, train_pages: int = TRAIN_PAGES) -> Potentials | None:
    """Potentials from labelled pages; None if there is none."""
    small_batches(pages.sparkSession)
    texts = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null and html <> ''")
    share = min(1.0, train_pages / max(texts.count(), 1))
    chosen = texts.where(F.xxhash64("html").bitwiseAND(F.lit((1 << 40) - 1)) < int(share * (1 << 40)))
    found = chosen.mapInArrow(C.tidy(_count(labels)), "counts array<bigint>").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    row = np.zeros(6 + 2 * sum(LEVELS), np.int64)
    for r in found:
        row[r["k"]] = r["n"]
    return potentials(row) if row.any() else None


def _extract(model: Potentials | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in _groups(batches):
            forest = Forest(pages)
            if model is None:
                sure = np.ones(len(forest.parent))
            else:
                sure = marginals(forest.parent, forest.root, forest.levels, unary(forest, model), model.root, model.step)
            keep = sure >= threshold
            texts = [text_of(p, keep[a:b]) for p, a, b in zip(pages, forest.first, forest.first[1:])]
            kept = np.bincount(forest.page, keep & (forest.features[0] == _TEXT), len(pages)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(np.diff(forest.first), pa.int32()), pa.array(kept, pa.int32())], names=["page_id", "text", "nodes", "content_nodes"])

    return run


def extract(pages: DataFrame, model: Potentials | None, id_col: str = "page_id", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, text, nodes, content_nodes) of each page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    kinds = [("text", T.StringType()), ("nodes", T.IntegerType()), ("content_nodes", T.IntegerType())]
    return rows.mapInArrow(C.tidy(_extract(model, threshold)), T.StructType([rows.schema["page_id"], *(T.StructField(n, k) for n, k in kinds)]))
