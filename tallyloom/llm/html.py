"""Main-text extraction: a tree-structured graphical model over the DOM.

Every element that holds text is a binary variable (content or not). Unary potentials come from its own features,
pairwise potentials tie parent and child; sum-product messages up and down the tree give each element's marginal.
Both kinds of potentials are learned from labelled pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas select option textarea button".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements of hidden text whose end tag authors leave out: a block cannot stand in them, so it closes them.
CLOSED_BY_BLOCK = ("head", "option", "optgroup", "select", "button", "svg")
IN_HEAD = frozenset("base link meta title style script noscript template".split())
SELF_NESTED = {"option": {"select", "datalist"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TAGS = "html body article main section div p h1 h2 h3 h4 ul ol li table tr td blockquote pre nav header footer aside form figure figcaption dl dd dt address".split()
# Parts of class, id and role names that tell an element's purpose.
PURPOSES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs toolbar skip",
    "head": "header masthead topbar banner brand logo hero",
    "foot": "footer foot copyright legal colophon",
    "side": "sidebar side aside rail widget related recommended popular trending more",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall",
    "form": "form search login contact input",
    "comment": "comment comments commentlist reply replies respond disqus discussion thread feedback",
    "share": "share sharing social follow tags tag meta byline author rating",
    "content": "content article post entry story main body text maintext prose hentry",
}
_PURPOSE = {word: kind for kind, words in PURPOSES.items() for word in words.split()}
_KINDS, _SPLIT, _SPACE = list(PURPOSES), re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])"), re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    kinds: frozenset[str] = frozenset()
    depth: int = 0
    text: int = 0
    linked: int = 0
    stops: int = 0
    own: int = 0
    children: list[int] = field(default_factory=list)
    label: bool | None = None


class Page(HTMLParser):
    """Nodes in page order, and the runs of text between block boundaries, each with the block element that holds it.

    Where open elements lie is kept by tag and for blocks, and text is summed up the tree once at the end, so the work is
    linear in the page however deep its elements nest.
    """

    def __init__(self, html: str, marker: str | None = None):
        super().__init__(convert_charrefs=True)
        self.marker, self.nodes, self.open, self.runs = marker, [Node("html", -1)], [0], []
        self.buffer: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each tag, and of blocks, the depths at which one is open
        self.blocks = [0]
        self.holder, self.hidden, self.links = 0, 0, 0
        self.feed(html)
        self.close()
        self._flush()
        for node in reversed(self.nodes[1:]):
            above = self.nodes[node.parent]
            above.text, above.linked, above.stops = above.text + node.text, above.linked + node.linked, above.stops + node.stops

    def _flush(self) -> None:
        if self.buffer and (text := _SPACE.sub(" ", "".join(self.buffer)).strip()):
            self.runs.append((self.holder, text))
        self.buffer = []

    def _top(self, *tags: str) -> int:
        """The depth of the innermost open element of one of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            node = self.nodes[self.open.pop()]
            self.places[node.tag].pop()
            self.hidden -= node.tag in HIDDEN
            self.links -= node.tag == "a"
            if node.tag not in INLINE:
                self.blocks.pop()
                self._flush()

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "body" or (tag in CLOSES_P and self.hidden):
            for name in CLOSED_BY_BLOCK:
                if (at := self._top(name)) > 0:
                    self._pop(at)
        elif self.places.get("head") and tag not in IN_HEAD and not self._top(*IN_HEAD) > self._top("head"):
            self._pop(self._top("head"))
        if tag in CLOSES_P and (at := self._top("p")) > 0:
            self._pop(at)
        elif tag in SELF_NESTED:
            alike = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if (at := self._top(*alike)) > max(0, self._top(*SELF_NESTED[tag])):
                self._pop(at)
        if tag not in INLINE:
            self._flush()
        elif tag in ("br", "wbr"):
            self.buffer.append(" ")
        if tag in VOID:
            return
        at, values = self.open[-1], dict(attrs)
        names = " ".join(filter(None, (values.get("class"), values.get("id"), values.get("role"))))
        kinds = frozenset(_PURPOSE[w] for w in _SPLIT.split(names.lower()) if w in _PURPOSE)
        node = Node(tag, at, kinds, self.nodes[at].depth + 1, label=self.nodes[at].label)
        if self.marker and self.marker in values:
            node.label = values[self.marker] == "1"
        self.nodes[at].children.append(len(self.nodes))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append(len(self.nodes))
        self.nodes.append(node)
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self._top(tag)
        if at > 0 and not (tag in INLINE and self.blocks[-1] > at):
            self._pop(at)

    def handle_data(self, data):
        if self.hidden and self.nodes[self.open[-1]].tag == "head" and data.strip():
            self._pop(self._top("head"))  # text cannot stand in head itself
        if self.hidden:
            return
        if not self.buffer:
            self.holder = self.open[self.blocks[-1]]
        self.buffer.append(data)
        n, last = len(data.strip()), self.nodes[self.open[-1]]
        self.nodes[self.holder].own += n
        last.text += n
        last.stops += data.count(".") + data.count(",")
        last.linked += n if self.links else 0


WIDTH = 2 * (len(TAGS) + 1 + len(_KINDS)) + 9


def features(page: Page) -> np.ndarray:
    """A row for each node: its tag and named purposes, the same of its ancestors, and the shape of its text."""
    out = np.zeros((len(page.nodes), WIDTH), np.float32)
    tags, block = {t: i for i, t in enumerate(TAGS)}, len(TAGS) + 1 + len(_KINDS)
    total = max(1, page.nodes[0].text)
    for i, node in enumerate(page.nodes):
        row = out[i]
        row[tags.get(node.tag, len(TAGS))] = 1
        for kind in node.kinds:
            row[len(TAGS) + 1 + _KINDS.index(kind)] = 1
        if node.parent >= 0:
            row[block : 2 * block] = np.maximum(out[node.parent, :block], out[node.parent, block : 2 * block])
        n = max(1, node.text)
        row[2 * block :] = (1, node.linked / n, np.log1p(node.text) / 10, np.log1p(node.own) / 8, min(1, 20 * node.stops / n), node.text / total, min(node.depth, 20) / 20, min(len(node.children), 20) / 20, i / len(page.nodes))
    return out


@dataclass
class Model:
    unary: np.ndarray
    pair: np.ndarray  # log potentials [parent, child]

    def marginals(self, page: Page) -> np.ndarray:
        """P(content) of every node, by one pass up the tree and one down."""
        score = features(page) @ self.unary
        own = np.stack([np.zeros_like(score), score], axis=1).astype(float)
        up, to_parent, down = own.copy(), np.zeros_like(own), np.zeros_like(own)
        parents = [n.parent for n in page.nodes]
        for i in range(len(parents) - 1, 0, -1):
            m = np.logaddexp(self.pair[:, 0] + up[i, 0], self.pair[:, 1] + up[i, 1])
            to_parent[i] = m - m.max()
            up[parents[i]] += to_parent[i]
        for i in range(1, len(parents)):
            rest = up[parents[i]] + down[parents[i]] - to_parent[i]
            m = np.logaddexp(self.pair[0] + rest[0], self.pair[1] + rest[1])
            down[i] = m - m.max()
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))

    def extract(self, html: str | None) -> str:
        """The content runs of the page, one line each."""
        if not html:
            return ""
        page = Page(html)
        keep = self.marginals(page) > 0.5
        return "\n".join(text for holder, text in page.runs if keep[holder])


def train(pages: list[str], marker: str = "data-content", rounds: int = 1200, rate: float = 1.0, l2: float = 1e-5) -> Model:
    """Potentials from pages whose elements carry `marker`="1" or "0" (inherited downwards); unlabelled elements hold no text
    of their own, and count as content where an element below does."""
    x, y, pair = [], [], np.ones((2, 2))
    for html in pages:
        page = Page(html, marker)
        rows, labels = features(page), [n.label for n in page.nodes]
        for i in range(len(labels) - 1, 0, -1):  # a wrapper of content is on its way to content
            if labels[i] and labels[page.nodes[i].parent] is None:
                labels[page.nodes[i].parent] = True
        for i, node in enumerate(page.nodes):
            if labels[i] is None or not node.text:
                continue
            x.append(rows[i])
            y.append(labels[i])
            if node.parent >= 0 and labels[node.parent] is not None:
                pair[int(labels[node.parent]), int(labels[i])] += 1
    x, y = np.array(x, np.float32), np.array(y, np.float32)
    w = np.zeros(WIDTH, np.float32)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    seen = np.zeros(WIDTH, np.float32)
    for _ in range(rounds):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + l2 * w
        seen += g * g
        w -= rate * g / (np.sqrt(seen) + 1e-8)
    # the pairwise part keeps only what a parent's label adds to the child's own frequency
    joint = pair / pair.sum()
    return Model(w, np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text (main text of the whole html), n_chars for every row of pages (page_id, url, html).

    Null, empty or text-less html: an empty text. Broken markup: parsed as far as it goes, and a block closes a head,
    option, select, button or svg left open. Very long pages: whole, in time linear in their length. Repeated rows:
    each. Null ids and urls: kept. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [held.value.extract(h) for h in pdf.html]
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": text, "n_chars": [len(t) for t in text]})

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInPandas(run, "page_id long, url string, text string, n_chars long")
