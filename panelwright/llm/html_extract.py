"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a small tree of block elements, marked inline elements and loose runs of text. Each node has
features: its kind and those of its ancestors, groups of attribute tokens, depth, length, link share and
density of its subtree, and how it stands among its siblings. Spark ML fits boosted trees on the nodes of a
bounded sample of pages that mark their article; each sampled page is used a second time with the marks of
the article taken out, so pages without such marks are read by everything else.

Decoding picks the most likely labels under one rule: below a dropped node nothing is kept. It goes up
the tree once and down once, so no ancestor and descendant contradict each other.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.bpe import slices
from panelwright.llm.store import Workspace
from panelwright.session import ship_package

TRAINING_PAGES = 1_000
TREES, DEPTH = 12, 4

BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td"
    " th caption form fieldset blockquote pre figure figcaption address details summary center hr".split()
)
HOLDERS = frozenset("html body main article section nav aside header footer div ul ol dl table tbody thead tfoot tr form fieldset figure details center".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Their text is never part of a page's visible prose.
SILENT = frozenset("script style noscript template textarea title iframe svg math select datalist option button object canvas head".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
# What may stand in a head; anything else, text too, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUNDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# Kinds of elements and words in attributes that weigh as features; the first two mark an article.
KINDS = (
    ("article",), ("main",), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th"), ("div", "section"), ("#text",),
)
WORDS = (
    "content article articlebody post entry story main text".split(),
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager".split(),
    "header banner masthead topbar logo".split(),
    "footer copyright legal bottom imprint".split(),
    "sidebar aside widget rail side related recommended".split(),
    "ad ads advert advertisement advertising sponsor sponsored promo promotion".split(),
    "cookie cookies consent notice gdpr alert popup modal overlay notification disclaimer".split(),
    "comment comments reply replies discussion disqus respond".split(),
    "form search login signup subscribe newsletter register".split(),
    "share sharing social follow tags meta byline".split(),
)
MARKS = 2  # kinds that mark an article; so does the first group of words
ANCESTOR_KINDS = range(7)
N_FEATURES = 2 * len(WORDS) + len(KINDS) + len(ANCESTOR_KINDS) + 14
_KIND = {name: i for i, names in enumerate(KINDS) for name in names}
_GROUP = {word: i for i, words in enumerate(WORDS) for word in words}
# Where the features that mark an article stand in a row.
_MARK_COLUMNS = [0, 1, len(KINDS), len(KINDS) + 1, len(KINDS) + len(ANCESTOR_KINDS), len(KINDS) + len(ANCESTOR_KINDS) + len(WORDS)]

_OPENS = re.compile("<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE_OR_END = re.compile("[>\"']")
_COMMENT_END = re.compile("--!?>")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SHUT = {name: re.compile(f"</{name}[\\s/>]", re.I) for name in RAW}


class Tags:
    """Reads tags from left to right, in time linear in the page whatever it holds.

    A tag ends at the first ``>`` outside of quotes; if a quote isn't closed, at the first ``>``. Where quotes
    begin from which no end can be reached is remembered, so no tag is followed to the end of the page twice
    the same way.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self._lost: set[int] = set()

    def _end(self, at: int) -> int:
        """Where the ``>`` stands that ends a tag whose attributes begin here, or -1."""
        source, begun, first = self.source, [], -1
        while m := _QUOTE_OR_END.search(source, at):
            at = m.start()
            if source[at] == ">":
                return at
            if first < 0:
                first = at
            if at in self._lost:
                break
            begun.append(at)
            closed = source.find(source[at], at + 1)
            if closed < 0:
                break
            at = closed + 1
        self._lost.update(begun)
        return source.find(">", first) if first >= 0 else -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; a comment or declaration has no name."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                m = _COMMENT_END.search(source, start + 4)
                return start, m.end() if m else len(source), False, "", ""
            if start > self.last:  # only a comment can still begin
                start = source.find("<!--", start)
                return (start, m.end() if (m := _COMMENT_END.search(source, start + 4)) else len(source), False, "", "") if start >= 0 else None
            if source.startswith(("<!", "<?"), start):
                return start, source.find(">", start) + 1, False, "", ""
            m = _OPENS.match(source, start)
            end = self._end(m.end()) if m else -1
            if end >= 0:
                return start, end + 1, bool(m[1]), m[2].lower(), source[m.end() : end]
            at = start + 1
        return None


class Page:
    """Nodes in page order (parents before children) and runs of text as (node, block, text, in a link)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.groups, self.depth = ["#page"], [-1], [frozenset()], [0]
        self.runs: list[tuple[int, int, str, bool]] = []
        self._read(source)

    def _node(self, tag: str, parent: int, attributes: str = "") -> int:
        found = frozenset()
        if "=" in attributes:
            words = [w for a in _ATTRIBUTE.findall(attributes) for w in _TOKEN.findall(a.lower())]
            found = frozenset(_GROUP[w] for w in words if w in _GROUP)
        self.tag.append(tag)
        self.parent.append(parent)
        self.groups.append(found)
        self.depth.append(self.depth[parent] + 1)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, block, at, links = [0], 0, 0, 0
        silent: list[str] = []  # open silent elements, outermost first
        loose = (-1, -1)  # block and node of the last loose run

        def text(part: str) -> None:
            nonlocal loose
            if silent and silent[-1] == "head" and not part.isspace():
                silent.pop()
            if silent or not part or part.isspace() and (not self.runs or self.runs[-1][1] != block):
                return
            node = stack[-1]
            if self.tag[node] in HOLDERS or node == 0:
                if loose[0] != block:
                    loose = (block, self._node("#text", node))
                node = loose[1]
            self.runs.append((node, block, html.unescape(part) if "&" in part else part, links > 0))

        tags = Tags(source)
        opened: Counter = Counter()  # names on the stack

        def leave(name: str) -> None:
            """Close the innermost open element of that name and all within it."""
            while opened[name]:
                last = self.tag[stack.pop()]
                opened[last] -= 1
                if last == name:
                    return

        def enter(name: str, attributes: str) -> None:
            stack.append(self._node(name, stack[-1], attributes))
            opened[name] += 1

        while True:
            found = tags.after(at)
            if not found:
                text(source[at:])
                return
            start, end, closing, name, attributes = found
            if start > at:
                text(source[at:start])
            at = end
            if not name:
                continue
            if closing:
                if name == "a":
                    links = max(0, links - 1)
                elif name in SILENT and name not in RAW:
                    if name in silent:  # with all that is still open in it
                        del silent[len(silent) - 1 - silent[::-1].index(name) :]
                if name in BLOCKS:
                    block += 1
                leave(name)
                continue
            if silent and silent[-1] == "head" and name not in IN_HEAD:
                silent.pop()
            if silent and silent[-1] == "option" and name in ("option", "optgroup"):
                silent.pop()
            if name in RAW:
                end = _SHUT[name].search(source, at)
                at = len(source) if not end else max(end.start(), source.find(">", end.start()) + 1)
                continue
            if name in SILENT:
                if not attributes.endswith("/"):
                    silent.append(name)
                continue
            if name in BLOCKS:
                block += 1
                if name == "body":
                    silent.clear()
                if name != "hr":
                    for ended, within in (({"p"}, HOLDERS), (CLOSED_BY.get(name, ()), BOUNDS.get(name, ()))):
                        if not any(opened[e] for e in ended):
                            continue
                        for i in range(len(stack) - 1, 0, -1):
                            open_name = self.tag[stack[i]]
                            if open_name in ended:
                                leave(open_name)
                                break
                            if open_name in within:
                                break
                    if name not in ("html", "body"):
                        enter(name, attributes)
            elif name == "a":
                links += 1
            elif name == "br":
                text(" ")
            elif name not in VOID and "=" in attributes and _ATTRIBUTE.search(attributes) and not attributes.endswith("/"):
                enter(name, attributes)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, linked, marks = [0] * n, [0] * n, [0] * n
        first = [0] * n
        total = 0
        for node, _, part, link in self.runs:
            size = len(part)
            if not own[node]:
                first[node] = total
            own[node] += size
            linked[node] += size * link
            marks[node] += part.count(".") + part.count(",")
            total += size
        chars, links, stops, below, children = own[:], linked[:], marks[:], [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            stops[p] += stops[i]
            below[p] += below[i] + 1
            children[p] += 1
            if chars[i] and (not own[p] or first[i] < first[p]):
                first[p] = first[i]
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            key = (self.parent[i], self.tag[i])
            same[key] = same.get(key, 0) + 1
        kinds = [_KIND.get(t, -1) for t in self.tag]
        out = np.zeros((n, N_FEATURES))
        up_kinds: list[frozenset] = [frozenset()] * n
        up_groups: list[frozenset] = [frozenset()] * n
        seen = [0] * n
        a, b = len(KINDS), len(KINDS) + len(ANCESTOR_KINDS)
        c = b + len(WORDS)
        for i in range(1, n):
            p, row = self.parent[i], out[i]
            up_kinds[i] = up_kinds[p] | {kinds[p]} if kinds[p] in ANCESTOR_KINDS else up_kinds[p]
            up_groups[i] = up_groups[p] | self.groups[p] if self.groups[p] else up_groups[p]
            if kinds[i] >= 0:
                row[kinds[i]] = 1
            for k in up_kinds[i]:
                row[a + k] = 1
            for g in self.groups[i]:
                row[b + g] = 1
            for g in up_groups[i]:
                row[c + g] = 1
            size = chars[i]
            row[c + len(WORDS) :] = (
                self.depth[i],
                math.log1p(size),
                math.log1p(own[i]),
                links[i] / size if size else 0.0,
                size / (1 + below[i]),
                size / total if total else 0.0,
                stops[i] / size if size else 0.0,
                children[i],
                children[p],
                seen[p] / children[p],
                same[p, self.tag[i]] / children[p],
                size * children[p] / chars[p] if chars[p] else 0.0,
                first[i] / total if total else 0.0,
                math.log1p(chars[p]),
            )
            seen[p] += 1
        return out

    def marked(self) -> list[int] | None:
        """Labels of the nodes of a page that marks its article: 1 if the node is or holds a part of it."""
        n = len(self.tag)
        inside, out = [False] * n, [False] * n
        for i in range(1, n):
            p, kind = self.parent[i], _KIND.get(self.tag[i], -1)
            inside[i] = inside[p] or kind < MARKS and kind >= 0
            out[i] = out[p] or kind in (2, 4, 5, 6) or kind == 3 and not inside[i] or bool(self.groups[i] - {0, 2, 9})
        if not any(inside):
            return None
        label = [0] * n
        for i in {node for node, _, _, _ in self.runs}:
            if inside[i] and not out[i]:
                while i > 0 and not label[i]:
                    label[i] = 1
                    i = self.parent[i]
        return label

    def decode(self, likely: np.ndarray) -> str:
        """Text of the nodes kept by the most likely labels under which a dropped node has no kept one below."""
        n = len(self.tag)
        yes, no = np.log(likely).tolist(), np.log1p(-likely).tolist()
        yes[0], no[0] = 0.0, -math.inf
        keep, drop = yes[:], no[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
        kept = [True] * n
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] >= drop[i]
        blocks: list[str] = []
        last, parts = -1, []
        for node, block, part, _ in [*self.runs, (0, -2, "", False)]:
            if block != last:
                if line := " ".join("".join(parts).split()):
                    blocks.append(line)
                last, parts = block, []
            if kept[node]:
                parts.append(part)
        return "\n".join(blocks)


class Forest:
    """Boosted trees as flat arrays; leaves point to themselves."""

    def __init__(self, trees: list[tuple[float, list[tuple[int, float, int, int, float]]]]):
        self.trees = [(weight, *(np.asarray(c) for c in zip(*nodes, strict=True))) for weight, nodes in trees]

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Forest:
        trees = []
        for weight, tree in zip(model.treeWeights, model.trees, strict=True):
            nodes: list[list] = []

            def visit(node, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append([0, 0.0, at, at, node.prediction()])
                if node.subtreeDepth() > 0:
                    nodes[at][:2] = [node.split().featureIndex(), node.split().threshold()]
                    nodes[at][2] = visit(node.leftChild())
                    nodes[at][3] = visit(node.rightChild())
                return at

            visit(tree._java_obj.rootNode())
            trees.append((weight, [tuple(x) for x in nodes]))
        return cls(trees)

    def likely(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row, kept away from 0 and 1; one half without trees."""
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            margin += weight * value[at]
        return np.clip(1 / (1 + np.exp(-2 * margin)), 1e-6, 1 - 1e-6)


def _labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sources in slices(batch, "html"):
            rows, labels = [], []
            for source in sources:
                page = Page(source or "")
                if (label := page.marked()) is None:
                    continue
                x = page.features()[1:]
                bare = x.copy()
                bare[:, _MARK_COLUMNS] = 0
                rows += [*x.tolist(), *bare.tolist()]
                labels += 2 * label[1:]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["x", "label"])


def learn(ws: Workspace, df: DataFrame, id_col: str, html_col: str) -> Forest:
    """Fits the trees on at most ``TRAINING_PAGES`` pages, those with the smallest hashed ids."""
    ids = df.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAINING_PAGES)
    chosen = ws.table(ids)
    pages = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(chosen), "id")
    nodes = ws.table(pages.select("html").mapInArrow(_labelled, "x array<double>, label double"))
    if nodes.agg(F.count_distinct("label")).first()[0] < 2:
        return Forest([])
    vectors = nodes.select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.5, maxBins=32, seed=1, cacheNodeIds=False).fit(vectors)
    return Forest.of(model)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: id, the columns in ``carry``, ``text`` (blocks joined by line feeds), ``n_chars``.

    NULL and empty pages give the empty text. If no sampled page marks an article there are no trees, and
    everything but silent elements is kept. Repeated rows are read each; other columns are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    forest = learn(Workspace(spark, "html"), df, id_col, html_col)
    shared = spark.sparkContext.broadcast(forest)
    rows = df.select(id_col, *carry, F.col(html_col).alias("html"))
    kept = [id_col, *carry]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for first, sources in slices(batch, "html"):
                pages = [Page(source or "") for source in sources]
                x = [page.features() for page in pages]
                likely = np.split(trees.likely(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
                texts = [page.decode(p) for page, p in zip(pages, likely, strict=True)]
                head = [batch.column(c).slice(first, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*head, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
