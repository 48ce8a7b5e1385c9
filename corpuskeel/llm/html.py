"""Operator 5: main text of HTML pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. A block has its word count, its link density and
those of its neighbours, and what its containers say of themselves (element names, roles, classes and
ids). A decision tree, trained on the small labelled table in `html_training`, tells text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, narrow, query, table

# A quote opens a value right after "=" only; elsewhere, as in title=John's, it is a letter like any other.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^\s>=]++|\s++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
TOKEN = re.compile(r"[a-z]+")
# Elements whose content is no markup: it ends at the closing tag only, as in a browser.
RAW = {"script", "style", "iframe", "title", "textarea"}
# Boilerplate of its own: fields, drawings, players and what stands in for them.
EMBEDDED = {"noscript", "template", "svg", "select", "button", "object", "audio", "video", "canvas"}
MATH = set(
    """math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle
    mpadded mphantom menclose merror maction semantics annotation annotation-xml""".split()
)
INLINE = MATH | set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
PARAGRAPHS = {"p", "blockquote", "pre", "dd", "dt", "figcaption"}
ROWS = {"li", "td", "th", "option"}
# Words that containers use of themselves.
BOILERPLATE_TAGS = set("nav header footer aside form menu dialog fieldset".split())
CONTENT_TAGS = {"article", "main"}
BOILERPLATE_WORDS = set(
    """nav navbar navigation menu menubar header masthead topbar footer foot sidebar aside rail widget widgets ad ads adv advert adverts
    advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter
    subscribe subscription signup login search form share sharing social related recommended comment comments commentlist respond reply replies
    disqus breadcrumb breadcrumbs pagination pager tags copyright legal disclaimer complementary contentinfo toolbar skip dialog""".split()
)
CONTENT_WORDS = set("article content post entry story main body text prose".split())
# First and last words of names that tell of a state or layout, not of the container itself.
STATE_FIRST = set("no not non without with has have hide hidden show".split())
STATE_LAST = set("on off enabled disabled open closed".split())
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I | re.A) for t in RAW | EMBEDDED}
# A tag before which an embedded element has to end if it holds nothing but inline content.
_BLOCK = "|".join(
    sorted({*HEADINGS, *PARAGRAPHS, *BOILERPLATE_TAGS, *CONTENT_TAGS, *"html body div section center address figure hr ul ol dl li table tbody thead tfoot tr td th".split()})
)
STOP = {t: re.compile(rf"</?(?:{_BLOCK})(?=[\s/>])|<{t}(?=[\s/>])", re.I | re.A) for t in EMBEDDED}


@dataclass
class Block:
    """A flat text block. `container` is -1 inside boilerplate, 1 inside content, by the innermost container
    that says so; `boilerplate` tells whether any container does."""

    text: str
    words: int
    linked: int
    tag: str
    container: int
    boilerplate: bool


@dataclass
class _Open:
    """An open container; `around` is the nearest one outside it that says something of itself."""

    tag: str
    says: int
    around: _Open | None = None
    told: tuple[int, bool] = (0, False)


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    stack: list[_Open] = field(default_factory=list)
    tag: str = ""
    within: list[_Open | None] = field(default_factory=list)
    speaking: list[_Open] = field(default_factory=list)

    def nearest(self) -> _Open | None:
        top = self.stack[-1] if self.stack else None
        return top if top is None or top.says else top.around

    def open(self, tag: str, says: int) -> None:
        self.stack.append(_Open(tag, says, self.nearest()))
        if says:
            self.speaking.append(self.stack[-1])

    def text(self, piece: str) -> None:
        if piece:
            self.parts.append(piece)
            if self.links:
                self.linked += len(html.unescape(piece).split())

    def flush(self) -> None:
        if self.parts:
            words = html.unescape("".join(self.parts)).split()
            if words:
                self.blocks.append(Block(" ".join(words), len(words), self.linked, self.tag, 0, False))
                self.within.append(self.nearest())
            self.parts = []
        self.linked = 0

    def drop(self, depth: int) -> None:
        """Take containers off the stack; an embedded element that others end says nothing of what follows it."""
        for o in self.stack[depth:]:
            if o.tag in EMBEDDED:
                o.says = 0
        del self.stack[depth:]

    def finish(self) -> list[Block]:
        self.flush()
        self.drop(0)
        # Outer containers were opened first, so one pass tells of each what holds inside it.
        for o in self.speaking:
            innermost, any_boilerplate = o.around.told if o.around else (0, False)
            o.told = (o.says or innermost, o.says == -1 or any_boilerplate)
        for block, within in zip(self.blocks, self.within):
            block.container, block.boilerplate = within.told if within else (0, False)
        return self.blocks


@dataclass
class _Ahead:
    """The next match of a pattern; positions only rise, so every pattern reads the page once."""

    page: str
    found: dict[re.Pattern[str], re.Match[str] | None] = field(default_factory=dict)

    def __call__(self, pattern: re.Pattern[str], at: int) -> re.Match[str] | None:
        if pattern not in self.found or (self.found[pattern] and self.found[pattern].start() < at):
            self.found[pattern] = pattern.search(self.page, at)
        return self.found[pattern]


def names(attributes: str) -> Iterator[list[str]]:
    """The words of every class, id and role; names that tell of a state ('no-sidebar', 'share-on') are left out."""
    for found in ATTRIBUTE.findall(attributes):
        for name in "".join(found[1:]).lower().split():
            words = TOKEN.findall(name)
            if words and not (len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST)):
                yield words


def says(tag: str, attributes: str) -> int:
    """-1 for a container that calls itself boilerplate, 1 for content, 0 for neither.

    A single name with words of both kinds ('post-comments', 'main-nav') is boilerplate; of several names,
    one of content is enough. An article is boilerplate only if all its names that say anything are; the
    page and its main element never are.
    """
    if tag in BOILERPLATE_TAGS:
        return -1
    told = [-1 if BOILERPLATE_WORDS.intersection(w) else int(bool(CONTENT_WORDS.intersection(w))) for w in names(attributes)]
    if 1 in told:
        return 1
    if tag == "main" or tag == "article" and (-1 not in told or 0 in told):
        return 1
    return -1 if -1 in told and tag not in ("html", "body") else 0


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a whole page in order; scripts, styles, comments and form fields have none.

    An embedded element without blocks is passed over; one with blocks is a boilerplate container, and one
    that is never closed takes nothing with it.
    """
    r, at, size, ahead = _Reader(), 0, len(page), _Ahead(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            r.text(page[at:])
            break
        r.text(page[at:start])
        if page.startswith(("<!-->", "<!--->"), start):
            at = page.find(">", start) + 1
            continue
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        found = TAG.match(page, start)
        if found is None:
            following = page[start + 1 : start + 2]
            if following in ("!", "?", "/") or following.isalpha():
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                r.text("<")
                at = start + 1
            continue
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = ahead(CLOSE[tag], at)
                at = end.end() if end else size
            if tag == "title":
                r.flush()
            continue
        if tag in EMBEDDED:
            passed = attributes.endswith("/")
            if closing:
                passed = all(o.tag != tag for o in r.stack)
            elif not passed:
                end, stop = ahead(CLOSE[tag], at), ahead(STOP[tag], at)
                if end and (stop is None or end.start() < stop.start()):
                    passed, at = True, end.end()
            if passed:
                if tag in ("select", "button"):
                    r.flush()
                continue
        if tag in INLINE:
            if tag == "a":
                r.links = 0 if closing else 1
            elif tag in ("br", "mtd", "mspace"):
                r.text(" ")
            continue
        r.flush()
        r.links = 0
        if closing:
            for depth in range(len(r.stack) - 1, -1, -1):
                if r.stack[depth].tag == tag:
                    r.drop(depth + 1)
                    r.stack.pop()
                    break
            r.tag = r.stack[-1].tag if r.stack else ""
        elif tag not in VOID:
            if tag == "p" or tag in HEADINGS or tag in ROWS:
                # These end an open one of their kind by themselves.
                while r.stack and r.stack[-1].tag in ({"p", *HEADINGS} if tag not in ROWS else {"p", tag, *HEADINGS}):
                    r.stack.pop()
            r.open(tag, -1 if tag in EMBEDDED else says(tag, attributes))
            r.tag = tag
    return r.finish()


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "container", "boilerplate", "heading", "paragraph", "row")


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    own = np.array([(b.words, b.linked / b.words) for b in found], np.float64).reshape(n, 2)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1]])[:n], np.concatenate([own[1:], none])[:n]
    rest = np.array(
        [(b.container, b.boilerplate, HEADINGS.get(b.tag, 0), b.tag in PARAGRAPHS, b.tag in ROWS) for b in found], np.float64
    ).reshape(n, 5)
    return np.hstack([own, before, after, rest])


class Tree:
    """A binary decision tree: splits by the largest drop of the Gini impurity, first feature on ties."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y.astype(np.float64), depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        here = len(self.nodes)
        share = float(y.mean()) if len(y) else 0.0
        self.nodes.append((-1, 0.0, -1, -1, share))
        best = (1e-12, -1, 0.0)
        if depth and 0 < share < 1:
            whole = len(y) * share * (1 - share)
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, left = x[order, f], np.cumsum(y[order])[:-1]
                n = np.arange(1, len(y))
                right, m = y.sum() - left, len(y) - n
                gain = whole - left * (1 - left / n) - right * (1 - right / m)
                gain[(v[1:] <= v[:-1]) | (n < least) | (m < least)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0] + 1e-9:
                    best = (float(gain[at]), f, (v[at] + v[at + 1]) / 2)
        if best[1] >= 0:
            mask = x[:, best[1]] <= best[2]
            low = self._grow(x[mask], y[mask], depth - 1, least)
            high = self._grow(x[~mask], y[~mask], depth - 1, least)
            self.nodes[here] = (best[1], best[2], low, high, share)
        return here

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, cut, low, high, share = self.nodes[node]
            if f < 0:
                out[rows] = share
            else:
                mask = x[rows, f] <= cut
                todo += [(low, rows[mask]), (high, rows[~mask])]
        return out


def trained_tree() -> Tree:
    from .html_training import labelled_pages

    xs, ys = [], []
    for page, texts in labelled_pages():
        found = blocks(page)
        xs.append(features(found))
        ys.append(np.array([b.text in texts for b in found]))
    return Tree(np.vstack(xs), np.concatenate(ys))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(`key`, `url`, text, n_chars) of every row.

    A null or empty page has an empty text, so has a page without text blocks. Pages that are cut off,
    or that close nothing, are read to their end; only a script, style, title, textarea or iframe that is
    never closed holds the rest of its page, as in a browser. Repeated rows stay repeated, further columns are
    ignored, an empty table gives an empty one.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trained_tree().nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.__new__(Tree)
        tree.nodes = shared.value
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["key", "url", "text", "n_chars"],
            )

    rows = narrow(pages, [key, url, page])
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)


@query("op5_html")
def op5(spark, folder):
    return extract(table(spark, folder, "pages"))
