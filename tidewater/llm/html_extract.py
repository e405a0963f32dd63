"""Main text of web pages from boosted trees over DOM nodes.

A page becomes a tree of block nodes; inline elements belong to their block, and
text that stands beside blocks (loose text) makes nodes of its own, one for each
run between blocks, rules or empty lines of ``<br>``. Each node has features of its
tag, the tokens of its class, id and role (its own and its ancestors'), its
subtree's text and link density, depth and place among its siblings. Boosted
trees, trained in numpy on generated pages of many layouts, say how likely a
node is boilerplate, a container or content.

Decoding is hierarchical: below boilerplate everything is boilerplate, below
content there is content or boilerplate, and a container decides nothing for
its children. The best consistent labelling of the whole tree is found by
dynamic programming, so ancestors and descendants never contradict each other.
The text is that of all content nodes, in page order.

No text at all are: scripts, styles, comments, the head, form controls, and what a
browser shows only where it cannot show the element itself (``noscript``,
``object``, ``iframe``, ``canvas``, ``audio``, ``video``, and the titles, descriptions and
annotations inside ``svg`` and ``math``; their visible text is kept). Character
references are decoded once; white space runs become one blank.

Defined cases: null or empty html gives an empty text; a page without any tag
is text that stands alone and is kept; markup that never ends is closed at the
end; repeated rows give repeated rows; other columns are ignored. Every page
is parsed whole, also a very long one, whose nodes one task holds.
"""

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import read, schema, ship
from tidewater.llm.boosting import BoostedTrees

DROP, CONTAIN, KEEP = 0, 1, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title desc metadata annotation annotation-xml iframe object select textarea button option canvas audio video".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "math semantics mrow mi mo mn ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mfenced "
    "svg g text tspan textpath defs".split()
)
LOOSE = "#run"
#: Blocks without blocks inside whose text is cut at empty lines of breaks.
SPLIT = frozenset("#page html body div section main article center td form".split())
#: A start tag of the second kind ends an open element of the first.
ENDS = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: What such an implied end never crosses.
WALLS = frozenset("table ul ol dl body html div article section main td th".split())
TAGS = (
    "#run html body main article section div nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure figcaption address dl dt dd fieldset details"
).split()
TOKENS = (
    "ad ads advert banner sponsor promo nav menu breadcrumb pagination header masthead footer copyright sidebar aside widget comment reply discussion "
    "cookie consent notice alert popup modal newsletter subscribe signup login search form share social related recommend tags meta byline "
    "content article post entry story main body text"
).split()


class LinkText(str):
    """Text inside a link."""


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "parts", "links")

    def __init__(self, tag: str, tokens: frozenset, parent: "Node | None"):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        #: Texts and child nodes in order.
        self.parts: list = []
        #: Characters inside links.
        self.links = 0


def _tokens(attributes) -> frozenset:
    found = set()
    for name, value in attributes:
        if value and name in ("class", "id", "role", "itemprop", "aria-label"):
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            found.update(t for t in re.split(r"[^a-z]+", spaced) if t)
    return frozenset(found)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", frozenset(), None)
        #: Open elements: (tag, block node or None, silent).
        self.open: list[tuple[str, Node | None]] = []
        self.block = self.root
        self.silent = 0
        self.link = 0

    def _pop(self) -> None:
        tag, node = self.open.pop()
        if node is not None:
            self.block = node.parent or self.root
        if tag in SILENT:
            self.silent -= 1
        if tag == "a":
            self.link -= 1

    def handle_starttag(self, tag, attrs):
        if not self.silent and (tag == "br" or tag == "hr"):
            self.block.parts.append(BREAK if tag == "br" else RULE)
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if tag in ENDS.get(name, ()):
                while len(self.open) > k:
                    self._pop()
                break
            if name in WALLS:
                break
        node = None
        if tag not in INLINE:
            if tag in SILENT:
                self.silent += 1
            elif not self.silent:
                node = Node(tag, _tokens(attrs), self.block)
                self.block.children.append(node)
                self.block.parts.append(node)
                self.block = node
        if tag == "a":
            self.link += 1
        self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return

    def handle_data(self, data):
        if not self.silent and data:
            self.block.parts.append(LinkText(data) if self.link else data)


#: A line end and a rule, as they stand in ``Node.parts``.
BREAK, RULE = "\n\v", "\n\v\v"


def _runs(parts: list) -> list[list]:
    """Texts and child nodes, cut before and after each node, at rules, and where two or more breaks follow each other."""
    out: list[list] = [[]]
    breaks = 0
    for part in parts:
        if not isinstance(part, str):
            out += [[part], []]
            breaks = 0
        elif part is RULE or part is BREAK:
            breaks += 1
            if part is RULE or breaks > 1:
                out.append([])
            out[-1].append(" ")
        else:
            out[-1].append(part)
            breaks = 0 if part.strip() else breaks
    return out


def _links(parts: list) -> int:
    return sum(len(p) for p in parts if type(p) is LinkText)


def settle(root: Node) -> list[Node]:
    """All nodes, parents before children; the first is the page itself. Loose text moves into nodes of its own."""
    nodes, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        nodes.append(node)
        runs = _runs(node.parts)
        if not node.children and (len(runs) == 1 and node.tag not in ("html", "body") or node.tag not in SPLIT):
            node.parts = [" " if p is BREAK or p is RULE else p for p in node.parts]
            node.links = _links(node.parts)
            continue
        own: list = []
        for run in runs:
            if len(run) == 1 and not isinstance(run[0], str):
                own.append(run[0])
            elif "".join(run).strip():
                made = Node(LOOSE, frozenset(), node)
                made.parts = run
                own.append(made)
        node.children = node.parts = own
        waiting.extend(reversed(own))
    return nodes


def parse(html: str) -> list[Node]:
    """All nodes, parents before children; the first is the page itself."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return settle(builder.root)


_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_TOKEN_AT = {t: i for i, t in enumerate(TOKENS)}
#: Plural and joined forms count as their token.
_LONG = tuple(t for t in TOKENS if len(t) > 4)
_FIRST_TAG = len(TAGS) + 2 * len(TOKENS)
_FIRST_STAT = _FIRST_TAG + len(TAGS)
STATS = 16
WIDTH = _FIRST_STAT + STATS


@functools.lru_cache(4096)
def _token_columns(tokens: frozenset) -> tuple[int, ...]:
    found = {_TOKEN_AT[t] for t in tokens if t in _TOKEN_AT}
    found |= {_TOKEN_AT[t[:-1]] for t in tokens if t[:-1] in _TOKEN_AT and t.endswith("s")}
    found |= {_TOKEN_AT[long] for t in tokens for long in _LONG if long in t}
    return tuple(sorted(found))


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    x = np.zeros((n, WIDTH), np.float32)
    own = np.zeros((n, 6))  # characters, link characters, words, stops, paragraphs, blocks
    for i, node in enumerate(nodes):
        text = " ".join([p for p in node.parts if isinstance(p, str)])
        words = text.split()
        own[i] = len("".join(words)), node.links, len(words), text.count(".") + text.count(","), node.tag == "p" and bool(words), 1
    sums = own.copy()
    for i in range(n - 1, 0, -1):
        sums[at[id(nodes[i].parent)]] += sums[i]
    page = sums[0] + 1e-9
    depth = np.zeros(n)
    place = {id(child): k for node in nodes for k, child in enumerate(node.children)}
    articles = [sum(child.tag == "article" for child in node.children) for node in nodes]
    stat = x[:, _FIRST_STAT:]
    for i, node in enumerate(nodes):
        if node.tag in _TAG_AT:
            x[i, _TAG_AT[node.tag]] = 1
        for k in _token_columns(node.tokens):
            x[i, len(TAGS) + k] = 1
        if i:
            up = at[id(node.parent)]
            depth[i] = depth[up] + 1
            inherited = slice(len(TAGS) + len(TOKENS), _FIRST_TAG)
            x[i, inherited] = np.maximum(x[up, inherited], x[up, len(TAGS) : len(TAGS) + len(TOKENS)])
            x[i, _FIRST_TAG:_FIRST_STAT] = np.maximum(x[up, _FIRST_TAG:_FIRST_STAT], x[up, : len(TAGS)])
            above = sums[up]
            stat[i, 8:14] = place[id(node)], len(node.parent.children), sums[i, 0] / (above[0] + 1), above[1] / (above[0] + 1), above[4], above[0] / page[0]
            stat[i, 14] = articles[up] > (node.tag == "article")
        chars, links, words, stops, paragraphs, blocks = sums[i]
        stat[i, :8] = np.log1p(chars), links / (chars + 1), stops / (words + 1), paragraphs, blocks, chars / blocks, chars / page[0], np.log1p(own[i, 0])
        stat[i, 15] = depth[i]
    return x


def decode(nodes: list[Node], chances: np.ndarray, steps: np.ndarray | None = None) -> list[int]:
    """The most likely consistent labelling.

    ``steps[above, below]``: what a label gains under a parent's label.
    """
    steps = np.zeros((3, 3)) if steps is None else steps
    at = {id(x): i for i, x in enumerate(nodes)}
    best = chances.astype(float).copy()
    for i in range(len(nodes) - 1, 0, -1):
        up, own = at[id(nodes[i].parent)], best[i]
        best[up, DROP] += own[DROP] + steps[DROP, DROP]
        best[up, CONTAIN] += (own + steps[CONTAIN]).max()
        best[up, KEEP] += max(own[DROP] + steps[KEEP, DROP], own[KEEP] + steps[KEEP, KEEP])
    label = [CONTAIN] * len(nodes)
    for i in range(1, len(nodes)):
        above = label[at[id(nodes[i].parent)]]
        own = best[i] + steps[above]
        if above == DROP:
            label[i] = DROP
        elif above == KEEP:
            label[i] = KEEP if own[KEEP] >= own[DROP] else DROP
        else:
            label[i] = int(own.argmax())
    return label


def text_of(nodes: list[Node], label: list[int]) -> str:
    if len(nodes) == 1:
        return " ".join("".join(p for p in nodes[0].parts if isinstance(p, str)).split())
    at = {id(x): i for i, x in enumerate(nodes)}
    out: list[str] = []
    waiting: list = [nodes[0]]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        keep = label[at[id(part)]]
        if keep == DROP:
            continue
        out.append(" ")
        waiting.append(" ")
        waiting.extend(p for p in reversed(part.parts) if keep == KEEP or not isinstance(p, str))
    return " ".join("".join(out).split())


class Extractor:
    def __init__(self, trees: BoostedTrees, steps: np.ndarray):
        self.trees, self.steps = trees, steps

    def texts(self, pages: list[str]) -> list[str]:
        trees = [parse(h) for h in pages]
        if not trees:
            return []
        chances = self.trees.log_chances(np.concatenate([features(t) for t in trees]))
        out, at = [], 0
        for nodes in trees:
            out.append(text_of(nodes, decode(nodes, chances[at : at + len(nodes)], self.steps)))
            at += len(nodes)
        return out


# Training pages -------------------------------------------------------------

#: Share of blocks whose names say nothing.
STRANGE = 0.08
_SYLLABLES = "an ba co de el fi go ha in jo ka le mi no or pe qui ra su te un ve wo xa zu th er on st ing".split()


def _words(rng, low: int, high: int) -> str:
    def word() -> str:
        return "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))

    out = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.integers(low, high + 1))]
    return " ".join(out).capitalize() + ("." if rng.random() < 0.8 else "")


def _pick(rng, options):
    return options[int(rng.integers(len(options)))]


def _element(rng, tag: str, names: list[str], inside: str, label: int, always: bool = False) -> str:
    """Markup of a block with its label; names are possible class or id values."""
    kind = _pick(rng, ["class", "class", "id", "role" if tag != "p" else "class"])
    name = f' {kind}="{_pick(rng, names)}"' if names and (always or rng.random() < 0.7) else ""
    if name and rng.random() < STRANGE:  # names that say nothing
        name = f' {kind}="{"".join(rng.choice(_SYLLABLES, 3))}-{rng.integers(99)}"'
    return f'<{tag}{name} data-label="{label}">{inside}</{tag}>'


def _loose(rng, low: int, high: int, label: int) -> str:
    """Text beside blocks, with its label."""
    return f'<span data-label="{label}">{_words(rng, low, high)}</span>'


def _boilerplate(rng) -> str:
    links = lambda low, high: "<ul>" + "".join(f'<li><a href="#">{_words(rng, 1, 3)}</a></li>' for _ in range(rng.integers(low, high))) + "</ul>"
    paragraph = lambda low, high: f"<p>{_words(rng, low, high)}</p>"
    made = {
        "nav": lambda: _element(rng, _pick(rng, ["nav", "nav", "div"]), ["nav", "main-menu", "menu", "navbar", "site-nav", "breadcrumbs"], links(3, 9), DROP, True),
        "header": lambda: _element(rng, _pick(rng, ["header", "header", "div"]), ["header", "masthead", "site-header", "top-header"], f"<h1>{_words(rng, 1, 4)}</h1>" * int(rng.random() < 0.5) + _pick(rng, [links(2, 6), paragraph(2, 10)]), DROP, True),
        "footer": lambda: _element(rng, _pick(rng, ["footer", "footer", "div"]), ["footer", "site-footer", "copyright", "page-footer"], _pick(rng, ["&copy; " + _words(rng, 2, 18), paragraph(3, 20), links(2, 8) + _words(rng, 2, 9)]), DROP, True),
        "aside": lambda: _element(rng, _pick(rng, ["aside", "aside", "div"]), ["sidebar", "side-bar", "widget", "related", "recommended", "right-sidebar"], f"<h3>{_words(rng, 1, 4)}</h3>" + _pick(rng, [links(2, 7), paragraph(3, 30), paragraph(2, 12) + links(1, 4)]), DROP, True),
        "ad": lambda: _element(rng, _pick(rng, ["div", "div", "section", "p", "aside"]), ["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement"], _words(rng, 2, 25), DROP, True),
        "notice": lambda: _element(rng, _pick(rng, ["div", "section"]), ["cookie-notice", "cookies", "notice", "consent-banner", "alert", "popup", "modal"], paragraph(4, 30), DROP, True),
        "form": lambda: _element(rng, _pick(rng, ["form", "form", "div"]), ["newsletter", "subscribe", "signup", "login", "search-form"], paragraph(2, 12) + "<label>" + _words(rng, 1, 3) + "</label><input><button>x</button>", DROP, True),
        "comments": lambda: _element(rng, _pick(rng, ["div", "section", "ul"]), ["comments", "comment-list", "reader-comments", "discussion", "replies"], "".join(_element(rng, _pick(rng, ["div", "li", "article"]), ["comment", "reply"], paragraph(3, 45), DROP, True) for _ in range(rng.integers(1, 6))), DROP, True),
        "share": lambda: _element(rng, "div", ["share", "social", "tags", "post-meta", "pagination"], links(2, 5), DROP, True),
    }
    return made[_pick(rng, list(made))]()


def _article(rng) -> str:
    parts = [f'<{h} data-label="2">{_words(rng, 1, 14)}</{h}>' for h in [_pick(rng, ["h1", "h2", "h1"])] if rng.random() < 0.85]
    short = rng.random() < 0.3  # some articles are a few words in all
    style = rng.random()
    if style < 0.12:  # paragraphs are loose text between empty lines
        body = "<br><br>".join(_loose(rng, 1, 8, 2) if short else _loose(rng, 8, 90, 2) for _ in range(rng.integers(1, 7)))
        return "".join(parts) + body + (_boilerplate(rng) if rng.random() < 0.15 else "")
    if style < 0.3:
        parts.insert(int(rng.integers(len(parts) + 1)), _loose(rng, 2, 40, 2))
    for _ in range(rng.integers(1, 4 if short else 9)):
        roll = rng.random()
        if short or roll < 0.72:
            body = _words(rng, 1, 6) if short else _words(rng, 1, 12) if rng.random() < 0.25 else _words(rng, 15, 120)
            parts.append(f'<p data-label="2">{body}</p>')
        elif roll < 0.78:
            parts.append('<ul data-label="2">' + "".join(f'<li data-label="2">{_words(rng, 2, 15)}</li>' for _ in range(rng.integers(2, 6))) + "</ul>")
        elif roll < 0.82:
            parts.append(f'<blockquote data-label="2"><p data-label="2">{_words(rng, 5, 40)}</p></blockquote>')
        elif roll < 0.86:
            parts.append(f'<h2 data-label="2">{_words(rng, 1, 8)}</h2>')
        elif roll < 0.875:
            parts.append(_loose(rng, 3, 60, 2) + _pick(rng, ["<br>", "<br><br>", "<hr>", ""]))
        elif roll < 0.89:
            parts.append(f'<pre data-label="2">{_words(rng, 4, 30)}</pre>')
        elif roll < 0.92:
            cells = "".join(f'<tr data-label="2"><td data-label="2">{_words(rng, 1, 4)}</td><td data-label="2">{_words(rng, 1, 4)}</td></tr>' for _ in range(3))
            parts.append(f'<table data-label="2">{cells}</table>')
        else:
            parts.append(_boilerplate(rng))
    return "".join(parts)


def training_page(rng) -> str:
    """A page of a random layout; block elements carry their label."""
    tag = _pick(rng, ["article", "article", "main", "div", "section"])
    names = ["content", "post", "article-body", "entry-content", "story", "main-content", "post-text"]
    article = _element(rng, tag, names, _article(rng), KEEP, tag in ("div", "section"))
    if rng.random() < 0.12:  # a bare page
        inside = _article(rng) if rng.random() < 0.5 else article
        return inside if rng.random() < 0.5 else f'<html data-label="1"><body data-label="1">{inside}</body></html>'
    before = "".join(_boilerplate(rng) for _ in range(rng.integers(0, 4)))
    after = "".join(_boilerplate(rng) for _ in range(rng.integers(0, 4)))
    if rng.random() < 0.1:  # an article without an element of its own
        article = _article(rng)
    if rng.random() < 0.06:  # loose text that is none of it
        after += '<a href="#" ' + _loose(rng, 1, 4, 0)[5:-7] + "</a>"
    inside = before + article + after
    for _ in range(rng.integers(0, 3)):
        wrap = _pick(rng, ["div", "main", "section", "div"])
        split = rng.random() < 0.5
        shell = _element(rng, wrap, ["wrapper", "page", "container", "layout", "row"], inside, CONTAIN)
        inside = shell if not split else _boilerplate(rng) + shell + _boilerplate(rng)
    if rng.random() < 0.15:  # tags that may be left out
        return inside
    return f'<html data-label="1"><head><title>x</title></head><body data-label="1">{inside}</body></html>'


class _Labelled(_Builder):
    def __init__(self):
        super().__init__()
        self.labels: dict[int, int] = {}
        self.marks: list[int | None] = []
        self.texts: dict[int, int] = {}

    def handle_starttag(self, tag, attrs):
        before = self.block
        super().handle_starttag(tag, attrs)
        given = dict(attrs).get("data-label")
        if self.block is not before and given is not None:
            self.labels[id(self.block)] = int(given)
        elif tag in ("span", "a"):
            self.marks.append(None if given is None else int(given))

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if tag in ("span", "a"):
            self.marks.pop()

    def handle_data(self, data):
        super().handle_data(data)
        if self.marks and self.marks[-1] is not None and self.block.parts and isinstance(self.block.parts[-1], str):
            self.texts[id(self.block.parts[-1])] = self.marks[-1]


def labelled(page: str) -> tuple[list[Node], list[int]]:
    """The nodes of a training page and their labels."""
    builder = _Labelled()
    builder.feed(page)
    builder.close()
    nodes = settle(builder.root)
    label_of: dict[int, int] = {}
    for node in nodes:
        above = label_of[id(node.parent)] if node.parent else CONTAIN
        if node.tag == LOOSE:
            own = next((builder.texts[id(p)] for p in node.parts if id(p) in builder.texts), None)
            found = own if own is not None else KEEP if above == KEEP else DROP
            label_of[id(node)] = DROP if above == DROP else found
        else:
            # Unlabelled blocks are inside boilerplate.
            label_of[id(node)] = builder.labels.get(id(node), CONTAIN if node.parent is None else DROP)
    return nodes, [label_of[id(n)] for n in nodes]


@functools.cache
def trained(pages: int = 700, seed: int = 3) -> Extractor:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    pairs = np.ones((3, 3))
    for _ in range(pages):
        nodes, labels = labelled(training_page(rng))
        at = {id(x): i for i, x in enumerate(nodes)}
        for i, node in enumerate(nodes[1:], 1):
            pairs[labels[at[id(node.parent)]], labels[i]] += 1
        xs.append(features(nodes))
        ys += labels
    below = pairs / pairs.sum(1, keepdims=True)
    steps = np.log(below) - np.log(pairs.sum(0) / pairs.sum())
    return Extractor(BoostedTrees().fit(np.concatenate(xs), np.array(ys), 3), steps)


def extract_text(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns and ``text`` of every page."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for series in parts:
            found = series.tolist()
            out: list[str] = []
            for at in range(0, len(found), 200):
                out += own.texts(found[at : at + 200])
            yield pd.Series(out, dtype=object)

    extract = F.pandas_udf(run, "string")
    return pages.select(*keys, extract(F.coalesce(F.col(html), F.lit(""))).alias("text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
