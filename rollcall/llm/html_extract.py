"""Main text of web pages from flat text blocks.

The markup is read once, from left to right, into flat blocks: the text between
two block-level tags, character references decoded, white space folded. A
block knows its words, its link density (share of its words inside links),
those of the blocks before and after it, and what it stands in: a main or
article element, an element that is by tag, role, class or id a menu, header,
footer, sidebar, notice, advert, form or comment section. Names count as whole
class, id or role tokens; an element that holds most of the page's words and
its first heading is no boilerplate by its name. A decision tree
(Gini splits) learned from a small labelled table of such blocks says which
blocks are main text; they are joined in page order. The table, ``LABELLED``,
is part of this module and the tree is learned from it once a task.

Scripts, styles, templates, titles, comments of the markup and hidden elements
give no blocks. Broken markup is read on: an end tag closes what it can, a tag
without its end bracket is text. Null and empty pages give the empty text.
Work and memory are linear in a page; pages never meet each other. Repeated rows
are extracted each, an empty table gives an empty table, other columns pass
through (a column named as a result gives way to it).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, fresh, schema_with

_MARKUP = re.compile(
    r"<!--.*?-->|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>", re.S)
#: a name and its value: names and values of other attributes are passed over whole
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: elements whose content is no text of the page
_RAW = {"script", "style", "template", "title", "noscript", "textarea", "svg", "math", "iframe",
        "object", "select", "datalist", "canvas", "audio", "video", "xmp"}
#: elements that end a block
_BLOCK = set("""address article aside blockquote body caption center dd details dialog div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
    main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul
    button label""".split())
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "search"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARAGRAPHS = {"p", "blockquote", "pre"}
_LISTS = {"li", "dd", "dt", "td", "th", "tr"}

#: words in a class, id or role that name boilerplate
_HARD = set("""nav navbar navigation menu menus sidebar aside rail ad ads advert adverts
    advertisement advertising adbox adslot sponsor sponsored promo promotion promoted banner cookie
    cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe
    subscription signup signin login register social share sharing follow related recommended
    recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist respond
    reply replies disqus discussion form search searchbox widget widgets toolbar footer copyright
    legal disclaimer masthead topbar skip contentinfo complementary dialog""".split())
#: parts of a class or id that say nothing of what the element is; a name made of
#: one of the words above and such parts names boilerplate ("site-footer"), one with
#: any other part does not ("has-sidebar", "menu-open", "related-work")
_NEUTRAL = set("""area bar block body bottom box btn button buttons center col column container content
    el element fixed global group head heading icon icons id inner inline item items js label left link
    links list main module outer page panel post posts primary region right row secondary section site
    slot sticky sub text title top ui unit wrap wrapper""".split())
_SOFT = {"header", "byline", "meta", "dateline", "author"}
_KEEP_OPEN = {"html", "body", "main", "article"}

FEATURES = ("words link_density words_before density_before words_after density_after "
            "hard soft in_main page_has_main heading paragraph listed").split()

# The labelled table: blocks of invented pages, one row each: the features in
# the order of FEATURES, then 1 for main text.
LABELLED = """
6 0 0 0 40 0 0 0 1 1 1 0 0 1
9 0 1 1 25 0 0 0 1 1 1 0 0 1
3 0 30 0 60 0 0 0 1 1 1 0 0 1
12 0 0 0 2 0 0 1 1 1 1 0 0 1
5 0 0 0 4 0 0 1 1 1 1 0 0 1
4 1 20 0 30 0 0 0 1 1 1 0 0 1
45 0 6 0 38 0 0 0 1 1 0 1 0 1
38 0.1 45 0 5 0 0 0 1 1 0 1 0 1
2 0 50 0 40 0 0 0 1 1 0 1 0 1
1 0 9 0 80 0 0 0 1 1 0 1 0 1
5 0 38 0 0 0 0 0 1 1 0 1 0 1
7 1 44 0 52 0 0 0 1 1 0 1 0 1
120 0.05 2 0 1 0 0 0 1 1 0 1 0 1
60 0.4 33 0 20 0 0 0 1 1 0 1 0 1
14 0 22 0 13 0 0 0 1 1 0 0 1 1
3 0 14 0 4 0 0 0 1 1 0 0 1 1
4 0.25 3 0 6 0 0 0 1 1 0 0 1 1
80 0 8 0 70 0 0 0 1 1 0 0 0 1
6 0 80 0 40 0 0 0 1 1 0 0 0 1
25 0 0 0 0 0 0 0 1 1 0 0 0 1
4 1 40 0 5 1 0 0 1 1 0 0 1 0
6 1 4 1 3 1 0 0 1 1 0 0 1 0
5 1 30 0 4 1 0 0 1 1 0 0 0 0
4 0 12 0 45 0 0 1 1 1 0 1 0 0
3 0 9 0 30 0 0 1 1 1 0 0 0 0
5 0.5 10 0 50 0 0 1 1 1 0 0 0 0
2 0 60 0 20 0 1 0 1 1 1 0 0 0
24 0 2 0 31 0 1 0 1 1 0 1 0 0
31 0.1 24 0 2 0 1 0 1 1 0 1 0 0
4 0 31 0 24 0 1 0 1 1 0 0 1 0
12 0 50 0 60 0 1 0 1 1 0 0 0 0
45 0 3 0 60 0 1 0 1 1 0 0 0 0
70 0 20 0 30 0 1 0 1 1 0 0 0 0
3 0 3 0 20 0 1 1 1 1 1 0 0 0
8 0 3 0 20 0 1 1 1 1 0 1 0 0
1 1 0 0 1 1 1 0 0 1 0 0 1 0
2 1 1 1 1 1 1 0 0 1 0 0 1 0
9 0 1 1 12 0 1 0 0 1 0 0 0 0
30 0 9 0 12 0 1 0 0 1 0 1 0 0
22 0 18 0 0 0 1 0 0 1 0 0 0 0
11 0.2 40 0 0 0 1 0 0 1 0 0 0 0
5 0 0 0 1 1 0 1 0 1 1 0 0 0
7 0.3 0 0 3 1 0 1 0 1 0 0 0 0
16 0 5 0 8 0 0 1 0 1 0 1 0 0
6 0 0 0 40 0 0 0 0 1 1 0 0 0
9 0 6 0 20 0 0 0 0 1 0 0 0 0
35 0 4 0 40 0 0 0 0 1 0 1 0 0
50 0 30 0 10 0 0 0 0 1 0 0 0 0
3 1 4 1 2 1 0 0 0 1 0 0 1 0
8 0 20 0 0 0 0 0 0 1 0 1 0 0
7 0 2 1 42 0 0 0 0 0 1 0 0 1
4 0 60 0 35 0 0 0 0 0 1 0 0 1
10 0 0 0 28 0 0 0 0 0 1 0 0 1
42 0 7 0 39 0 0 0 0 0 0 1 0 1
39 0.1 42 0 6 0 0 0 0 0 0 1 0 1
6 0 39 0 51 0 0 0 0 0 0 1 0 1
8 0 33 0 2 1 0 0 0 0 0 1 0 1
14 0 5 0 16 0 0 0 0 0 0 1 0 1
55 0.05 3 1 48 0 0 0 0 0 0 0 0 1
48 0 55 0 3 1 0 0 0 0 0 0 0 1
26 0 30 0 28 0 0 0 0 0 0 0 1 1
18 0 25 0 20 0 0 0 0 0 0 0 1 1
3 0 0 0 2 1 0 0 0 0 1 0 0 0
2 0 3 1 3 1 0 0 0 0 1 0 0 0
2 1 1 1 2 1 0 0 0 0 0 0 1 0
4 0.9 2 1 3 1 0 0 0 0 0 0 1 0
3 0.6 4 1 5 0 0 0 0 0 0 0 0 0
5 0 3 1 4 1 0 0 0 0 0 0 0 0
8 0.7 2 1 30 0 0 0 0 0 0 0 0 0
7 0 2 1 0 0 0 0 0 0 0 0 0 0
6 0.5 5 1 0 0 0 0 0 0 0 1 0 0
15 0.9 3 1 4 1 0 0 0 0 0 1 0 0
20 0.8 6 1 5 1 0 0 0 0 0 0 0 0
4 0 0 0 45 0 0 1 0 0 0 0 0 0
9 0 4 0 40 0 0 1 0 0 1 0 0 1
5 0.4 4 1 30 0 1 0 0 0 1 0 0 0
4 0 6 0.2 3 0 0 1 1 1 1 0 0 1
8 0 0 0 55 0 0 1 1 1 1 0 0 1
2 0 3 1 4 0 0 1 1 1 1 0 0 1
15 0 9 0 30 0 0 1 1 1 1 0 0 1
3 0 4 0 7 0 0 1 1 1 0 1 0 0
6 0 15 0 45 0 0 1 1 1 0 1 0 0
2 0.5 8 0 90 0 0 1 1 1 0 1 0 0
4 0 12 0 60 0 0 1 1 1 0 0 1 0
5 0 2 0 3 0 0 1 1 1 0 0 0 0
3 0 2 1 60 0 0 0 0 0 1 0 0 1
5 0 0 0 12 0 0 0 0 0 1 0 0 1
12 0 3 1 25 0 0 0 0 0 1 0 0 1
6 0 1 1 18 0 0 0 0 0 1 0 0 1
2 0 40 0 22 0 0 0 0 0 1 0 0 1
2 0 80 0.1 4 1 0 0 0 0 1 0 0 0
3 0 2 1 2 1 0 0 0 0 1 0 0 0
2 0 40 0 3 0 0 0 0 0 0 1 0 1
3 0 25 0 60 0 0 0 0 0 0 1 0 1
4 0 60 0 44 0 0 0 0 0 0 0 0 1
4 0 3 1 2 1 0 0 0 0 0 0 0 0
9 0.1 4 1 3 1 0 0 0 0 0 1 0 0
200 0 0 0 0 0 0 0 0 0 0 0 0 1
12 0 0 0 0 0 0 0 0 0 0 0 0 1
32 0 32 0 0 0 0 0 0 0 0 1 0 1
20 0 40 0 0 0 0 0 0 0 0 1 0 1
60 0 2 0 0 0 0 0 0 0 0 0 0 1
3 0 0 0 0 0 0 0 0 0 0 1 0 1
150 0.02 10 1 10 1 0 0 0 0 0 1 0 1
65 0 4 1 4 1 0 0 0 0 0 0 0 1
25 0.8 0 0 0 0 0 0 0 0 0 0 0 0
40 0 10 0 33 0 1 0 0 0 0 1 0 0
33 0.1 40 0 20 0 1 0 0 0 0 0 0 0
18 0 60 0 0 0 1 0 0 0 0 0 1 0
"""


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    tag: str
    mark: int
    soft: bool
    in_main: bool
    hard: bool = False

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


@dataclass
class _Open:
    tag: str
    mark: int = -1
    soft: bool = False
    main: bool = False


@dataclass
class _Mark:
    """An element marked as boilerplate: ``sure`` by its tag or because it is
    hidden, not by a name; what it holds."""

    outer: int
    sure: bool
    words: int = 0
    leads: bool = False


def _names(value: str) -> set[str]:
    """The words that the class, id or role tokens of an attribute name."""
    out = set()
    for token in value.split():
        parts = {p.lower() for p in _PART.findall(token)}
        named = parts - _NEUTRAL - {p for p in parts if p.isdigit()}
        out.add(token.lower())
        if named <= _HARD | _SOFT:
            out |= named
    return out


@dataclass
class _Reader:
    """Blocks of one page, in page order."""

    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=lambda: [_Open("")])
    marks: list[_Mark] = field(default_factory=list)
    runs: list[tuple[str, bool]] = field(default_factory=list)
    #: how many elements of a tag are open
    count: Counter = field(default_factory=Counter)
    #: open elements around the link, if one is open
    link: int | None = None

    def text(self, s: str) -> None:
        if s:
            self.runs.append((s, self.link is not None))

    def anchor(self, ends: bool) -> None:
        self.link = None if ends else len(self.open)

    def mark(self, sure: bool) -> int:
        self.marks.append(_Mark(self.open[-1].mark, sure))
        return len(self.marks) - 1

    def push(self, o: _Open) -> None:
        self.open.append(o)
        self.count[o.tag] += 1

    def done(self) -> list[Block]:
        """The blocks, with the marks that hold: one given by a name does not if
        its element holds most of the page's words and its first heading."""
        self.flush()
        total = sum(b.words for b in self.blocks)
        lead = next((b for t in ("h1", "h2") for b in self.blocks if b.tag == t), None)
        for b in self.blocks:
            if b.mark >= 0:
                m = self.marks[b.mark]
                m.words += b.words
                m.leads |= b is lead
        for m in reversed(self.marks):
            if m.outer >= 0:
                self.marks[m.outer].words += m.words
                self.marks[m.outer].leads |= m.leads
        hard = []
        for m in self.marks:
            wraps = 2 * m.words > total and (m.leads if lead is not None else 10 * m.words >= 9 * total)
            hard.append(m.sure or not wraps or (m.outer >= 0 and hard[m.outer]))
        for b in self.blocks:
            b.hard = b.mark >= 0 and hard[b.mark]
        return self.blocks

    def flush(self) -> None:
        if not self.runs:
            return
        runs, self.runs = self.runs, []
        decoded = [(html.unescape(s) if "&" in s else s, link) for s, link in runs]
        text = " ".join("".join(s for s, _ in decoded).split())
        if text:
            top = self.open[-1]
            words = text.count(" ") + 1
            linked = min(words, sum(len(s.split()) for s, link in decoded if link))
            self.blocks.append(Block(text, words, linked, top.tag, top.mark, top.soft, top.main))

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag == "p":
            self.close("p", {"article", "main", "section", "div", "body", "li", "td", "aside"})
        elif tag == "li":
            self.close("li", {"ul", "ol", "menu"})
        if tag == "hr":
            return
        up = self.open[-1]
        sure, named = tag in _BOILERPLATE and tag != "form", set()
        for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            value, name = a or b or c, name.lower()
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
                    name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                sure = True
            elif name in ("class", "id", "role"):
                named |= _names(value)
        if tag in _KEEP_OPEN:
            comment = bool(named & {"comment", "comments", "reply", "ad", "advert", "promo"})
            # an article is not inside what was left open before it
            inside = up.mark >= 0 and (up.main or comment)
            mark = self.mark(True) if sure or comment else up.mark if inside else -1
            self.push(_Open(tag, mark, False, up.main or tag in ("main", "article")))
            return
        marked = sure or tag == "form" or bool(named & _HARD)
        soft = tag == "header" or bool(named & _SOFT)
        if tag == "header" and not up.main and self.count["nav"] + self.count["form"]:
            marked = True
        self.push(_Open(tag, self.mark(sure) if marked else up.mark, up.soft or soft, up.main))

    def end(self, tag: str) -> None:
        self.flush()
        self.close(tag, set())

    def close(self, tag: str, stop: set[str]) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.count.subtract(o.tag for o in self.open[i:])
                del self.open[i:]
                if self.link is not None and len(self.open) < self.link:
                    self.link = None          # the element around it has ended
                return
            if self.open[i].tag in stop:
                return


def page_blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page."""
    page = page or ""
    reader, at = _Reader(), 0
    folded, unclosed = None, set()
    comment = len(page)
    if "<!--" in page:                    # one that nothing closes runs to the end
        comment = page.find("<!--", max(page.rfind("-->"), 0))
        comment = len(page) if comment < 0 else comment
    last = page.rfind(">", 0, comment) + 1
    for m in iter(lambda: _MARKUP.search(page, at, last), None):
        reader.text(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(m.group(1))
        if tag in _RAW:
            if not ends and not m.group(3).endswith("/") and tag not in unclosed:
                if folded is None:
                    folded = _ascii_lower(page)
                stop = folded.find(f"</{tag}", at)
                if stop >= 0:
                    close = page.find(">", stop)
                    at = close + 1 if close >= 0 else len(page)
                elif tag in ("script", "style", "template", "xmp"):
                    at = len(page)
                else:
                    unclosed.add(tag)
        elif tag == "a":
            reader.anchor(ends)
        elif tag == "br":
            reader.text(" ")
        elif tag in _BLOCK:
            if ends:
                reader.end(tag)
            else:
                reader.start(tag, m.group(3))
    reader.text(page[at:comment])
    return reader.done()


def _ascii_lower(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    has_main = float(any(b.in_main for b in blocks))
    near = [(0, 0.0), *((b.words, b.density) for b in blocks), (0, 0.0)]
    return np.array([
        [b.words, b.density, *near[i], *near[i + 2], b.hard, b.soft, b.in_main, has_main,
         b.tag in _HEADINGS, b.tag in _PARAGRAPHS, b.tag in _LISTS]
        for i, b in enumerate(blocks)], dtype=float).reshape(-1, len(FEATURES))


class Tree:
    """A binary decision tree with Gini splits, grown until leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.value = bool(y.mean() >= 0.5)
        self.split: tuple[int, float] | None = None
        if depth == 0 or (y == y[0]).all():
            return
        best = None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], y[order]
            left, n = np.cumsum(t)[:-1], np.arange(1, len(t))
            right, m = t.sum() - left, len(t) - n
            gini = 2 * left * (1 - left / n) + 2 * right * (1 - right / m)
            gini[v[1:] == v[:-1]] = np.inf
            if len(gini) and gini.min() < np.inf and (best is None or gini.min() < best[0] - 1e-12):
                k = int(gini.argmin())
                best = (float(gini[k]), j, (v[k] + v[k + 1]) / 2)
        if best is None:
            return
        self.split = best[1:]
        low = x[:, best[1]] <= best[2]
        self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        low = x[:, self.split[0]] <= self.split[1]
        out = np.empty(len(x), dtype=bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def learned_tree(table: str = LABELLED) -> Tree:
    rows = np.array([[float(v) for v in line.split()] for line in table.strip().splitlines()])
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    """The main text of one page: its blocks joined by an empty line."""
    blocks = page_blocks(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, ok in zip(blocks, tree.predict(block_features(blocks))) if ok)


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with the main text in ``out_col`` (in
    place of a column of that name) and its code points in ``n_chars``."""
    bounded_batches(pages.sparkSession)
    fields = [T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = schema_with(pages.drop(html_col), *fields)
    order = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = learned_tree()
        for b in batches:
            texts = [main_text(x.as_py(), tree) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                b.columns[:len(order)]
                + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=order + [out_col, "n_chars"])

    return pages.select(*order, F.col(html_col).alias(fresh(pages, "_html"))).mapInArrow(run, schema)
