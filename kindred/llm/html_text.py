"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Every node is content or not; a potential joins each node
with its parent, and others tie a node to what is seen of it: its tag, words of its class and id, its share of link text, the length of
its text. Both kinds are log ratios of counts over labelled pages. Messages go up from the leaves
and down from the root, which gives each node's exact marginal; text of nodes that are more likely content than
not is kept. The labelled pages come from a generator of page layouts, as the tables have none.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Elements that start a block of text; others are parts of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as text of the page and runs to their end tag, or else to the page's end.
HIDDEN = "script|style|textarea|iframe|title"
#: Others, which hold elements and end with their parent; only what stands before an end tag of their own is left out.
ASIDE = frozenset("noscript template select button svg object video audio canvas".split())
_ASIDE = re.compile(rf"<(?:{'|'.join(sorted(ASIDE))})\b", re.I)
SECTIONS = frozenset("article main nav aside footer header form section dialog".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What the start of an element ends, if it is the innermost block: the end tags that pages leave out.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{HIDDEN})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*>",
    re.S | re.I,
)
_UNFINISHED = re.compile("<[a-zA-Z/!?]")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN_BY = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\x09-\x0D\x20\xa0  -     　\x85]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    own: int = 0
    own_links: int = 0
    stops: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _asides(text: str) -> dict[int, int]:
    """Where elements of ASIDE that are closed start and end. One that its parent's end, or the page's, cuts off isn't among them."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()

    def pop() -> int:
        tag, at = stack.pop()
        held[tag] -= 1
        return at

    for m in _TOKEN.finditer(text):
        tag = (m["tag"] or "").lower()
        if tag not in ASIDE and tag not in BLOCKS or tag in VOID:
            continue
        if m["end"]:
            if held[tag]:
                while stack[-1][0] != tag:
                    pop()
                at = pop()
                if tag in ASIDE:
                    out[at] = m.end()
        elif not m["rest"].endswith("/"):
            if tag in BLOCKS and stack and stack[-1][0] == "p":
                pop()
            if tag in ("button", "select") and held[tag]:  # these don't nest
                while stack[-1][0] != tag:
                    pop()
                pop()
            stack.append((tag, m.start()))
            held[tag] += 1
        elif tag in ASIDE:
            out[m.start()] = m.end()
    return out


def parse(text: str) -> Page:
    """Block elements in page order, each after its parent, and the page's blocks of text with the node they stand in.

    Never fails: broken markup is read as browsers do in the common cases (end tags left out, elements never closed). A line break (br) ends a
    block, as it ends a line of the page. Of what follows the last tag only an unfinished tag is left out.
    """
    page = Page([Node("html", -1)])
    stack, run, linked, in_link = [0], [], [], False
    held: Counter[str] = Counter()

    def pop() -> str:
        tag = page.nodes[stack.pop()].tag
        held[tag] -= 1
        return tag

    def flush() -> None:
        nonlocal run, linked
        if run:
            block = _SPACE.sub(" ", entities.unescape("".join(run))).strip(" ")
            if block:
                node = page.nodes[stack[-1]]
                node.own += len(block)
                node.own_links += min(len(block), len(_SPACE.sub(" ", "".join(linked)).strip(" ")))
                node.stops += block[-1] in ".!?:;…\"”»"
                page.blocks.append((stack[-1], block))
        run, linked = [], []

    at = 0
    asides = _asides(text) if _ASIDE.search(text) else {}
    for m in _TOKEN.finditer(text):
        if m.start() < at:  # in an element that is left out
            continue
        if m.start() > at:
            piece = text[at : m.start()]
            run.append(piece)
            if in_link:
                linked.append(piece)
        at = asides.get(m.start(), m.end())
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
        elif tag == "br":
            flush()
        elif tag in ("head", "html", "body") and not m["end"]:
            flush()
            if tag == "body":
                page.nodes[0].names += _names(m["rest"])
        elif tag in BLOCKS:
            flush()
            in_link = False
            if m["end"]:
                if held[tag]:  # an end tag that ends nothing is passed over without a look at the stack
                    while pop() != tag:
                        pass
            else:
                top = page.nodes[stack[-1]].tag
                while len(stack) > 1 and (top == "p" or top in ENDS.get(tag, ()) or re.fullmatch("h[1-6]", top) and re.fullmatch("h[1-6]", tag)):
                    pop()
                    top = page.nodes[stack[-1]].tag
                rest = m["rest"]
                page.nodes.append(Node(tag, stack[-1], _names(rest) if rest else (), bool(rest and _HIDDEN_BY.search(rest))))
                if tag not in VOID and not rest.endswith("/"):
                    stack.append(len(page.nodes) - 1)
                    held[tag] += 1
    cut = _UNFINISHED.search(text, at)
    run.append(text[at : cut.start() if cut else len(text)])
    flush()
    return page


def _names(rest: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for m in _NAMES.finditer(rest) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())))


def _kinds(page: Page) -> list[list[str]]:
    """What is seen of each node, as names of discrete features."""
    n = len(page.nodes)
    total, links, stops, below = [x.own for x in page.nodes], [x.own_links for x in page.nodes], [x.stops for x in page.nodes], [0] * n
    for i in range(n - 1, 0, -1):
        up = page.nodes[i].parent
        total[up] += total[i]
        links[up] += links[i]
        stops[up] += stops[i]
        below[up] += 1 + below[i]
    out = []
    around: list[tuple[tuple[str, ...], str]] = []  # names of the nearest ancestor that has any, and the nearest sectioning element
    for i, x in enumerate(page.nodes):
        up = page.nodes[x.parent] if i else x
        names, section = around[x.parent] if i else ((), "html")
        around.append((up.names or names, up.tag) if i and up.tag in SECTIONS else (up.names or names, section))
        share = links[i] / total[i] if total[i] else -1.0
        seen = ["tag:" + ("h" if re.fullmatch("h[2-6]", x.tag) else x.tag), "links:" + ("none" if share < 0 else "0" if share == 0 else "low" if share < 0.3 else "mid" if share < 0.7 else "high")]
        seen.append("own:" + ("0" if not x.own else "20" if x.own < 20 else "80" if x.own < 80 else "300" if x.own < 300 else "more") + ("." if x.stops else ""))
        seen += ["name:" + w for w in x.names]
        seen += ["under:" + w for w in around[i][0]]
        seen.append("in:" + around[i][1])
        if x.hidden:
            seen.append("hidden")
        out.append(seen)
    return out


@dataclass(frozen=True)
class Model:
    """Log potentials: of features for content against the rest; of a node's label given its parent's; of the root."""

    seen: dict[str, float]
    edge: tuple[tuple[float, float], tuple[float, float]]
    root: float


def fit(pages: list[tuple[str, list[bool]]]) -> Model:
    """pages: html and the label of each node that parse() finds, in order. Counts are smoothed by one."""
    seen, edge, of = (Counter(), Counter()), Counter(), Counter()
    for text, labels in pages:
        page = parse(text)
        if len(labels) != len(page.nodes):
            raise ValueError("a label for each node is needed")
        for i, (x, kinds) in enumerate(zip(page.nodes, _kinds(page), strict=True)):
            of[labels[i]] += 1
            for k in kinds:
                seen[labels[i]][k] += 1
            if i:
                edge[labels[x.parent], labels[i]] += 1
    ratio = {k: math.log((seen[1][k] + 0.5) / (of[True] + 1)) - math.log((seen[0][k] + 0.5) / (of[False] + 1)) for k in {*seen[0], *seen[1]}}
    rows = tuple(tuple(math.log((edge[p, c] + 1) / (edge[p, False] + edge[p, True] + 2)) for c in (False, True)) for p in (False, True))
    return Model(ratio, rows, math.log(0.01))


def marginals(page: Page, model: Model) -> list[float]:
    """Each node's probability of being content, by one pass of messages up the tree and one down."""
    n = len(page.nodes)
    own = [max(-12.0, min(12.0, sum(model.seen.get(k, 0.0) for k in kinds))) for kinds in _kinds(page)]
    own[0] += model.root
    # log messages to the parent and beliefs, as (not content, content)
    up = [(0.0, 0.0)] * n
    gathered = [[0.0, x] for x in own]
    edge = model.edge
    for i in range(n - 1, 0, -1):
        a, b = gathered[i]
        up[i] = (_add(edge[0][0] + a, edge[0][1] + b), _add(edge[1][0] + a, edge[1][1] + b))
        parent = gathered[page.nodes[i].parent]
        parent[0] += up[i][0]
        parent[1] += up[i][1]
    belief = [(0.0, 0.0)] * n
    belief[0] = tuple(gathered[0])
    for i in range(1, n):
        p = belief[page.nodes[i].parent]
        a, b = p[0] - up[i][0], p[1] - up[i][1]  # the parent without this child's own message
        top = max(a, b)
        a, b = a - top, b - top
        belief[i] = (gathered[i][0] + _add(a + edge[0][0], b + edge[1][0]), gathered[i][1] + _add(a + edge[0][1], b + edge[1][1]))
    return [1 / (1 + math.exp(max(-700.0, min(700.0, a - b)))) for a, b in belief]


def _add(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def extract(text: str | None, model: Model) -> str:
    """The kept blocks of a page in its order, joined by newlines; empty if there are none."""
    page = parse(text or "")
    likely = marginals(page, model)
    return "\n".join(block for i, block in page.blocks if likely[i] > 0.5)


# Labelled pages.


class _Maker:
    """Builds a page and its nodes' labels side by side."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], [False]

    def word(self) -> str:
        return "".join(self.rng.choice("ba ne ti ro su ke mo la vi do en ar is".split()) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 30) -> str:
        return self.words(low, high).capitalize() + self.rng.choice((".",) * 12 + ("", "", "!", "?", " ###", "***"))

    def open(self, tag: str, label: bool, names: str = "") -> None:
        form = self.rng.choice((' class="{}"', ' id="{}"', " class='{}'")) if names else ""
        self.out.append(f"<{tag}{form.format(names)}>")
        self.labels.append(label)

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def text(self, value: str) -> None:
        self.out.append(value)

    def element(self, tag: str, label: bool, value: str, names: str = "") -> None:
        self.open(tag, label, names)
        self.text(value)
        self.close(tag)

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def links(self, label: bool = False) -> None:
        self.open("ul", label)
        for _ in range(self.rng.randint(2, 9)):
            self.element("li", label, f'<a href="/{self.word()}">{self.words(1, 4)}</a>')
        self.close("ul")

    def clutter(self, kind: str) -> None:
        r = self.rng
        tag, names = r.choice(_CLUTTER[kind])
        self.open(tag, False, names)
        if kind in ("menu", "related"):
            if self.maybe(0.3):
                self.element(r.choice(("h2", "h3", "p")), False, self.words(1, 3))
            self.links()
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.element(r.choice(("p", "div")), False, f"<label>{self.words(1, 4)}</label><input name=x>")
            if self.maybe(0.4):
                self.text(self.sentence(3, 10))
        elif kind == "comments":
            self.element(r.choice(("h2", "h3")), False, self.words(1, 3))
            for _ in range(r.randint(1, 6)):
                self.open(r.choice(("div", "li", "article", "section")), False, r.choice(("comment", "comment-body", "reply", "")))
                inner = self.out[-1]
                if self.maybe(0.5):
                    self.element("div", False, self.words(1, 2), r.choice(("author", "meta", "comment-author")))
                for _ in range(r.randint(1, 3)):
                    self.element("p", False, self.sentence(2, 40))
                self.close(re.match(r"<(\w+)", inner)[1])
        elif kind == "header":
            if self.maybe(0.6):
                self.element(r.choice(("h1", "div", "p")), False, f'<a href="/">{self.words(1, 3)}</a>' if self.maybe(0.7) else self.words(1, 4))
            if self.maybe(0.6):
                self.links()
            if self.maybe(0.3):
                self.element("p", False, self.words(2, 8))
        elif kind == "notice":
            for _ in range(r.randint(1, 2)):
                self.element("p", False, self.sentence(5, 25)) if self.maybe(0.6) else self.text(self.sentence(5, 20))
        elif kind == "footer":
            if self.maybe(0.5):
                self.links()
            for _ in range(r.randint(0, 2)):
                self.element("p", False, "&copy; " + self.sentence(2, 14))
            self.text(r.choice(("&copy; 2020 ", "")) + self.words(1, 12) + r.choice(("", ".")))
        else:  # advert, sidebar
            for _ in range(r.randint(0, 3)):
                self.element(r.choice(("p", "div", "h3")), False, self.sentence(2, 25) if self.maybe(0.7) else f'<a href="/x">{self.words(2, 6)}</a>')
            if self.maybe(0.7):
                self.text(self.sentence(2, 20))
            if kind == "sidebar" and self.maybe(0.6):
                self.links()
        self.close(tag)

    def article(self) -> None:
        r = self.rng
        wraps = [r.choice(_ARTICLE) for _ in range(r.choice((1, 1, 1, 2)))]
        for tag, names in wraps:
            self.open(tag, True, names)
        if self.maybe(0.7):
            self.element("h1", True, self.words(2, 12))
        for _ in range(r.randint(1, 22)):
            x = r.random()
            if x < 0.74:
                value = " ".join(self.sentence(1, 25) for _ in range(r.choice((1, 1, 2, 3, 6))))
                if self.maybe(0.15):
                    value += f' <a href="/y">{self.words(1, 4)}</a> ' + self.sentence(1, 9)
                if self.maybe(0.05):
                    self.open("p", True)
                    self.text(value)  # never closed
                    if r.random() < 0.5:
                        self.text("<br>")
                else:
                    self.element("p", True, value, r.choice(("", "", "", "", "lead", "paragraph")))
            elif x < 0.82:
                self.element(r.choice(("h2", "h3")), True, self.words(1, 8))
            elif x < 0.87:
                tag = r.choice(("ul", "ol"))
                self.open(tag, True)
                for _ in range(r.randint(2, 6)):
                    self.element("li", True, self.sentence(2, 16))
                self.close(tag)
            elif x < 0.90:
                self.open("blockquote", True)
                self.element("p", True, self.sentence(4, 30))
                self.close("blockquote")
            elif x < 0.92:
                self.element("pre", True, self.words(3, 30))
            elif x < 0.94:
                self.open("table", True)
                for _ in range(r.randint(2, 4)):
                    self.open("tr", True)
                    for _ in range(3):
                        self.element("td", True, self.words(1, 3))
                    self.close("tr")
                self.close("table")
            elif x < 0.96:
                self.open("figure", True)
                self.element("figcaption", True, self.sentence(3, 14))
                self.close("figure")
            else:
                self.clutter(r.choice(("advert", "related", "advert", "form", "notice")))
        if self.maybe(0.2):
            self.clutter("comments")
        for tag, _ in reversed(wraps):
            self.close(tag)

    def page(self) -> tuple[str, list[bool]]:
        r = self.rng
        shell = [r.choice(("wrapper", "page", "container", "site", "layout", "")) for _ in range(r.choice((0, 0, 1, 2)))]
        for names in shell:
            self.open("div", False, names)
        for kind, p in (("header", 0.6), ("menu", 0.8), ("notice", 0.3), ("advert", 0.5), ("sidebar", 0.3)):
            if self.maybe(p):
                self.clutter(kind)
        self.article()
        for kind, p in (("comments", 0.35), ("related", 0.3), ("sidebar", 0.3), ("advert", 0.3), ("form", 0.25), ("notice", 0.15), ("footer", 0.85)):
            if self.maybe(p):
                self.clutter(kind)
        for _ in shell:
            self.close("div")
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{''.join(self.out)}</body></html>", self.labels


_ARTICLE = [("article", "")] * 4 + [("main", ""), ("article", "post"), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post-content"), ("section", "story"), ("div", "main"), ("div", "text"), ("td", "content"), ("div", "story-body"), ("section", "article")]
_CLUTTER = {
    "menu": [("nav", ""), ("nav", ""), ("nav", "menu"), ("div", "nav"), ("div", "menu"), ("div", "navbar"), ("div", "breadcrumb"), ("nav", "main-nav"), ("ul", "navigation"), ("div", "topbar"), ("div", "navigation")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("header", "page-header"), ("div", "banner"), ("div", "top")],
    "footer": [("footer", ""), ("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "bottom"), ("div", "legal")],
    "sidebar": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "side"), ("aside", "widget"), ("div", "newsletter"), ("div", "about-author")],
    "advert": [("div", "ad"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "promo"), ("div", "sponsored"), ("div", "advertisement"), ("section", "promo"), ("div", "ad-banner"), ("div", "sponsor"), ("p", "ad")],
    "notice": [("div", "cookie-notice"), ("div", "cookie"), ("div", "notice"), ("div", "consent"), ("div", "alert"), ("section", "notice"), ("div", "gdpr"), ("div", "popup"), ("div", "modal"), ("dialog", ""), ("div", "paywall"), ("div", "subscribe")],
    "form": [("form", ""), ("form", "search"), ("form", "newsletter"), ("form", "signup"), ("div", "search"), ("div", "login"), ("form", "contact")],
    "related": [("div", "related"), ("section", "related-posts"), ("div", "share"), ("div", "social"), ("div", "tags"), ("ul", "share"), ("div", "recommended"), ("aside", "related"), ("div", "more"), ("div", "pagination"), ("div", "popular")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "disqus"), ("section", "responses"), ("div", "reader-comments"), ("div", "discussion"), ("div", "replies")],
}


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[bool]]]:
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]


@functools.cache
def default_model(pages: int = 1500) -> Model:
    return fit([(text, labels) for text, labels in labelled_pages(pages) if len(parse(text).nodes) == len(labels)])


def extract_pages(pages: DataFrame, model: Model | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page. Null html is empty; rows that repeat an id count each."""
    model = model or default_model()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
