"""Main text of HTML pages by a graphical model over the page's tree.

Each element is a variable that is content or not. Potentials join it to what can be seen of it
(its kind, the words in its class, id and role, lengths, links, punctuation) and to its parent.
Messages go from the leaves to the root and back, once each, which gives the exact marginal
of every element; text whose element is more likely content than not is kept. The potentials are
trained on labelled pages by gradient ascent on their likelihood, with the same messages.

All pages of a slice are one forest, so a message pass is a few array operations per depth.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartulary.llm.common import slices

# Elements nested deeper than this hang on the element of this depth; no text is lost.
MAX_DEPTH = 200
TRAINING_PAGES = 300

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template noscript textarea title iframe svg object select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot title legend".split())
#: Opening one of these ends an open one of those, up to the element that bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}

KINDS = {
    "root": "html body",
    "article": "article main",
    "section": "section div center span figure details",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "paragraph": "p blockquote pre figcaption dd dt address",
    "list": "ul ol dl menu",
    "item": "li",
    "table": "table tbody thead tfoot tr td th",
    "navigation": "nav",
    "header": "header",
    "footer": "footer",
    "aside": "aside dialog",
    "form": "form fieldset legend label search input",
    "inline": "a b i em strong small time u code",
}
# Words in class, id and role by what they stand for.
FAMILIES = {
    "advert": "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored adsense adbox adslot adunit",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar topbar skip toc",
    "side": "sidebar side aside rail complementary widget widgets related recommended recommendations more popular trending teaser teasers",
    "head": "header masthead branding logo sitehead",
    "foot": "footer foot bottom copyright contentinfo legal colophon imprint",
    "comments": "comment comments reply replies discussion disqus respond feedback reader responses thread",
    "notice": "cookie cookies consent gdpr notice alert alertdialog popup modal overlay newsletter subscribe subscription signup paywall dialog message warning announcement",
    "form": "form search login signin register contact input poll survey",
    "share": "share sharing social follow tags tag meta byline author bio print",
    "hidden": "hidden invisible offscreen",
    "content": "article content post entry story text main body page copy prose",
}
#: Kinds that stand for a part of the page by themselves.
APART = ("root", "article", "navigation", "header", "footer", "aside", "form")
_KIND = {t: i for i, tags in enumerate(KINDS.values()) for t in tags.split()}
_FAMILY = {w: i for i, words in enumerate(FAMILIES.values()) for w in words.split()}
_N_MARKS = len(KINDS) + 1 + len(FAMILIES)
_MEASURES = 14

# Quotes open a value only right after an equals sign; a quote that is never closed ends with the page.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"?+|'[^']*+'?+|[^\s>]*+))?+""")
_READ = ("class", "id", "role", "style", "hidden", "aria-hidden")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@functools.lru_cache(maxsize=50_000)
def marks(tag: str, attributes: str) -> tuple[int, ...]:
    """Which kind of element a tag makes, and the families its attributes name."""
    found = {_KIND.get(tag, len(KINDS))}
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name not in _READ:
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            found.add(len(KINDS) + 1 + _FAMILY["hidden"])
        elif name == "style":
            if _HIDES.search(value):
                found.add(len(KINDS) + 1 + _FAMILY["hidden"])
        else:
            for word in _PARTS.findall(value):
                if word.lower() in _FAMILY:
                    found.add(len(KINDS) + 1 + _FAMILY[word.lower()])
    return tuple(sorted(found))


@dataclass
class Forest:
    """The elements of some pages, parents before children, and the pages' blocks of text."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    marked: list[tuple[int, ...]] = field(default_factory=list)
    #: Whether a mark in the source says that the element is content; for training only.
    label: list[str | None] = field(default_factory=list)
    #: Per page a list of blocks, each a list of (element, text).
    blocks: list[list[list[tuple[int, str]]]] = field(default_factory=list)
    #: (element, characters, whether in a link) of each text.
    texts: list[tuple[int, str, bool]] = field(default_factory=list)

    def add(self, source: str) -> None:
        """Parse a page as browsers do, as far as it matters to blocks of text."""
        page = len(self.blocks)
        blocks: list[list[tuple[int, str]]] = []
        self.blocks.append(blocks)
        block: list[tuple[int, str]] = []
        root = self._node(-1, 0, page, (_KIND["html"],), None)
        # Open elements: tag, its node, whether text is dropped, whether in a link.
        stack: list[tuple[str, int, bool, bool]] = [("", root, False, False)]
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal block
            if block:
                blocks.append(block)
                block = []

        def text(raw: str) -> None:
            _, node, dropped, linked = stack[-1]
            if dropped or not raw:
                return
            if "&" in raw:
                raw = html.unescape(raw)
            block.append((node, raw))
            self.texts.append((node, raw, linked))

        def pop(to: int) -> None:
            for tag, *_ in stack[to:]:
                if tag in BLOCK:
                    flush()
                    break
            del stack[to:]

        while at < end:
            found = _TOKEN.search(source, at)
            if not found:
                text(source[at:])
                break
            text(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if not tag:
                continue
            if not found[4]:
                break  # the page ends inside a tag
            tag = tag.lower()
            if found[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if tag not in ("body", "html"):
                            pop(i)
                        break
                    if stack[i][0] in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot"):
                        if tag not in BLOCK:
                            break
                if tag in BLOCK:
                    flush()
                continue
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in ("td", "th", "button", "table", "object"):
                        break
            if tag in ENDS:
                ended, bound = ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bound:
                        break
                    if stack[i][0] in ended:
                        pop(i)
                        if tag != "tr":
                            break
            if tag in BLOCK:
                flush()
            if tag == "br":
                block.append((stack[-1][1], " "))
            if tag in VOID:
                continue
            seen = marks(tag, found[3])
            _, parent, dropped, linked = stack[-1]
            node = parent
            if tag in BLOCK or len(seen) > 1 or "data-content" in found[3]:
                label = None
                if "data-content" in found[3]:
                    label = "1" if 'data-content="1"' in found[3] else "0"
                above = parent
                while self.depth[above] >= MAX_DEPTH:
                    above = self.parent[above]
                node = self._node(above, self.depth[above] + 1, page, seen, label)
            dropped = dropped or tag in NEVER
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                if tag not in NEVER and close:
                    block.append((node, source[at : close.start()]))
                at = close.end() if close else end
                continue
            if found[3].endswith("/") and tag not in BLOCK:
                continue
            stack.append((tag, node, dropped, linked or tag == "a"))
        flush()

    def _node(self, parent: int, depth: int, page: int, seen: tuple, label: str | None) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.page.append(page)
        self.marked.append(seen)
        self.label.append(label)
        return len(self.parent) - 1


@dataclass
class Arrays:
    """A forest as arrays: features, and elements by depth."""

    features: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray


def arrays(forest: Forest) -> Arrays:
    n = len(forest.parent)
    parent = np.array(forest.parent, np.int64)
    depth = np.array(forest.depth, np.int64)
    page = np.array(forest.page, np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
    marked = np.zeros((n, _N_MARKS))
    sizes = np.fromiter(map(len, forest.marked), np.int64, n)
    marked[np.repeat(np.arange(n), sizes), [m for ms in forest.marked for m in ms]] = 1
    # Characters, characters in links, punctuation, words: own, then of all elements below.
    own = np.zeros((n, 4))
    if forest.texts:
        node = np.array([t[0] for t in forest.texts])
        chars = np.array([len(t[1].strip()) for t in forest.texts], float)
        linked = np.array([t[2] for t in forest.texts])
        stops = np.array([t[1].count(".") + t[1].count(",") for t in forest.texts], float)
        words = np.array([t[1].count(" ") + 1 for t in forest.texts], float) * (chars > 0)
        for k, x in enumerate((chars, chars * linked, stops, words)):
            own[:, k] = np.bincount(node, x, n)
    total = own.copy()
    for level in reversed(levels[1:]):
        np.add.at(total, parent[level], total[level])
    whole = total[:, 0][np.flatnonzero(parent < 0)][page] + 1
    before = np.cumsum(own[:, 0]) - own[:, 0]
    before = (before - before[np.flatnonzero(parent < 0)][page]) / whole
    chars = total[:, 0]
    link = total[:, 1] / np.maximum(chars, 1)
    measures = np.stack(
        [
            np.ones(n),
            np.minimum(np.log1p(chars) / 8, 1.5),
            np.minimum(np.log1p(own[:, 0]) / 8, 1.5),
            link,
            link > 0.5,
            np.minimum(total[:, 2] / (total[:, 3] + 1), 0.5) * 2,
            chars / whole,
            before < 0.05,
            before > 0.9,
            chars == 0,
            own[:, 0] > 120,
            (own[:, 0] > 0) & (own[:, 0] < 30),
            np.minimum(depth / 10, 1),
            total[:, 2] == 0,
        ],
        axis=1,
    ).astype(float)
    # Plain elements follow their parent more closely than parts that name themselves.
    kind = np.zeros(n, np.int64)
    kind[marked[:, [list(KINDS).index(k) for k in APART]].any(axis=1)] = 1
    kind[marked[:, len(KINDS) + 1 :].any(axis=1)] = 2
    return Arrays(np.concatenate([measures, marked], axis=1), parent, levels, kind)


@dataclass(frozen=True)
class Potentials:
    """Weights of features, and tables (by kind of child: parent's state, child's state)."""

    weights: np.ndarray
    pairs: np.ndarray


def marginals(data: Arrays, model: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each element is content, and of each pair of states with its parent."""
    n = len(data.parent)
    unary = np.zeros((n, 2))
    unary[:, 1] = data.features @ model.weights
    pair = model.pairs[data.kind]  # element, parent's state, own state
    below = unary.copy()  # own potential and all messages from below
    up = np.zeros((n, 2))
    for level in reversed(data.levels[1:]):
        up[level] = np.logaddexp.reduce(pair[level] + below[level][:, None, :], axis=2)
        np.add.at(below, data.parent[level], up[level])
    belief = below.copy()
    joint = np.zeros((n, 2, 2))
    for level in data.levels[1:]:
        rest = belief[data.parent[level]] - up[level]
        joint[level] = pair[level] + rest[:, :, None] + below[level][:, None, :]
        belief[level] = np.logaddexp.reduce(joint[level], axis=1)
    belief -= np.logaddexp.reduce(belief, axis=1, keepdims=True)
    children = data.parent >= 0
    joint[children] -= np.logaddexp.reduce(joint[children].reshape(-1, 4), axis=1)[:, None, None]
    return np.exp(belief[:, 1]), np.exp(joint) * children[:, None, None]


def train(pages: list[str], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Potentials:
    """Potentials fitted to labelled pages.

    An element's label is that of the nearest ``data-content`` attribute at it or above it; an
    element that holds content somewhere below is content itself, so paths to content stay open.
    """
    forest = Forest()
    for page in pages:
        forest.add(page)
    data = arrays(forest)
    truth = np.zeros(len(data.parent))
    for i, (p, label) in enumerate(zip(forest.parent, forest.label, strict=True)):
        truth[i] = float(label) if label else (truth[p] if p >= 0 else 0)
    for i in range(len(truth) - 1, 0, -1):
        if data.parent[i] >= 0 and truth[i]:
            truth[data.parent[i]] = 1
    children = np.flatnonzero(data.parent >= 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(
        seen,
        (data.kind[children], truth[data.parent[children]].astype(int), truth[children].astype(int)),
        1,
    )
    weights, pairs = np.zeros(data.features.shape[1]), np.zeros((3, 2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(pairs)], [np.zeros_like(weights), np.zeros_like(pairs)]
    for step in range(1, steps + 1):
        content, joint = marginals(data, Potentials(weights, pairs))
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, data.kind, joint)
        slopes = (
            data.features.T @ (truth - content) / len(truth) - decay * weights,
            (seen - expected) / len(truth) - decay * pairs,
        )
        for k, (value, slope) in enumerate(zip((weights, pairs), slopes, strict=True)):
            moments[0][k][...] = 0.9 * moments[0][k] + 0.1 * slope
            moments[1][k][...] = 0.99 * moments[1][k] + 0.01 * slope**2
            value += rate * (moments[0][k] / (1 - 0.9**step)) / (np.sqrt(moments[1][k] / (1 - 0.99**step)) + 1e-8)
    return Potentials(weights, pairs)


def extract(forest: Forest, model: Potentials) -> list[str]:
    """The main text of each page: a line per block."""
    if not forest.parent:
        return []
    content = (marginals(arrays(forest), model)[0] > 0.5).tolist()
    out = []
    for blocks in forest.blocks:
        lines = (" ".join("".join([t for node, t in block if content[node]]).split()) for block in blocks)
        out.append("\n".join([line for line in lines if line]))
    return out


class _Writer:
    """Labelled pages in many layouts, made of invented words."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = "ba ce di fo gu la me ni or pa qui ra se ti un ve wo xa zel the an er in es".split()

        self.plain = False  # prose without punctuation
        self.short = False  # paragraphs of a few words

    def words(self, low: int, high: int) -> list[str]:
        r = self.r
        return ["".join(r.choices(self.syllables, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]

    def sentence(self, low: int = 3, high: int = 18) -> str:
        found = self.words(low, high)
        if self.plain:
            return " ".join(found)
        comma = self.r.random() < 0.4 and len(found) > 4
        return (" ".join(found[:3]) + ("," if comma else "") + " " + " ".join(found[3:])).strip().capitalize() + "."

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def one(self, *options: str) -> str:
        return self.r.choice(options)

    def named(self, tag: str, names: list[str], inner: str, label: str = "0") -> str:
        name = self.r.choice(names)
        extra = "" if not name else f' {self.one("class", "class", "id")}="{name}"'
        return f'<{tag}{extra} data-content="{label}">{inner}</{tag}>'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{w}">{w}</a>' for w in self.words(low, high)]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.one(" | ", " ", " &middot; ").join(items)

    def junk(self) -> str:
        kind = self.r.randrange(8)
        if kind == 0:
            return self.named(self.one("div", "div", "aside", "section"), ["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner-ad"], self.one(self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>"))
        if kind == 1:
            return self.named(self.one("aside", "div", "div"), ["sidebar", "side-bar", "related", "widget", "right-rail", "more-stories"], f"<h3>{self.sentence(1, 4)}</h3>" + self.one(self.links(3, 8), f"<p>{self.prose(1, 3)}</p>"))
        if kind == 2:
            return self.named(self.one("div", "section", "aside"), ["notice", "cookie-notice", "cookie", "consent-banner", "newsletter", "alert", "popup", "subscribe-box"], f"<p>{self.prose(1, 3)}</p>" + self.one("", "<button>Ok</button>"))
        if kind == 3:
            return self.named("form", ["", "search", "login-form", "contact"], f"<label>{self.sentence(1, 3)}</label><input name=q><p>{self.sentence(2, 8)}</p><button>Go</button>")
        if kind == 4:
            comments = "".join(f'<{t} class="{self.one("comment", "reply", "item")}"><b>{self.words(1, 2)[0]}</b><p>{self.prose(1, 4)}</p></{t}>' for t in [self.one("div", "li")] * self.r.randint(1, 5))
            return self.named(self.one("div", "section", "section", "ol"), ["comments", "comment-list", "reader-comments", "discussion", "responses"], self.one("", f"<h3>{self.sentence(1, 3)}</h3>") + comments)
        if kind == 5:
            return self.named(self.one("div", "ul", "p"), ["share", "social-links", "tags", "byline", "breadcrumb", "pagination"], self.links(2, 5))
        if kind == 6:
            return self.named("nav", ["", "menu", "toc"], self.links(3, 8))
        return self.named(self.one("aside", "aside", "div"), ["", "promo", "widget"] if self.r.random() < 0.3 else ["sidebar"], f"<p>{self.prose(1, 4)}</p>")

    def paragraph(self) -> str:
        r, prose = self.r, self.prose(1, 7)
        if self.short:
            return f"<p>{self.sentence(1, 4)}</p>"
        if r.random() < 0.15:
            prose += f' <a href="/x">{self.sentence(1, 4)}</a> {self.prose(1, 2)}'
        if r.random() < 0.1:
            prose = f"<b>{prose}<br>"
            return f"<p>{prose}"
        if r.random() < 0.08:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if r.random() < 0.05:
            return f"<blockquote><p>{prose}</p></blockquote>"
        if r.random() < 0.04:
            return f"<pre>{prose}</pre>"
        if r.random() < 0.05:
            rows = "".join(f"<tr><td>{self.sentence(1, 4)}</td><td>{self.sentence(1, 4)}</td></tr>" for _ in range(3))
            return f"<table>{rows}</table>"
        if r.random() < 0.1:
            return f"<h2>{self.sentence(2, 7)}</h2>"
        if r.random() < 0.05:
            return f"<p>{self.sentence(1, 3)}</p>"
        return f"<p>{prose}</p>" if r.random() < 0.95 else f"<p>{prose}"

    def page(self) -> str:
        r = self.r
        self.plain, self.short = r.random() < 0.2, r.random() < 0.15
        body = [f"<h1>{self.sentence(2, 12).rstrip(self.one('', '.'))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([r.randint(1, 12), r.randint(1, 12), r.randint(1, 60)])):
            body.append(self.paragraph())
            if r.random() < 0.04:
                body.append(self.junk())
        if r.random() < 0.25:
            body.append(self.junk())
        self.plain = r.random() < 0.2
        inner = "".join(body)
        if r.random() < 0.6:
            main = f'<article data-content="1">{inner}</article>'
            if r.random() < 0.3:
                main = f"<main>{main}</main>"
        elif r.random() < 0.4:
            main = f'<main data-content="1">{inner}</main>'
        else:
            main = self.named(self.one("div", "div", "section"), ["content", "post", "article-body", "entry-content", "story", "text", "main", ""], inner, "1")
        parts = []
        if r.random() < 0.4:
            title = self.one("h2", "div", "p")
            parts.append(self.named("header", ["", "header", "site-header"], f"<{title}>{self.sentence(1, 5)}</{title}>" + self.one("", self.links(2, 6))))
        elif r.random() < 0.2:
            parts.append(self.named("div", ["header", "masthead", "top-bar"], f"<p>{self.sentence(1, 8)}</p>"))
        if r.random() < 0.8:
            parts.append(self.named(self.one("nav", "nav", "div"), ["menu", "nav", "navbar", "main-menu"], self.links(3, 9)) if r.random() < 0.5 else f'<nav data-content="0">{self.links(3, 9)}</nav>')
        for _ in range(r.choice([0, 1, 1, 2])):
            parts.append(self.junk())
        parts.append(main)
        for _ in range(r.choice([0, 0, 1, 2])):
            parts.append(self.junk())
        foot = self.one(self.prose(1, 3), "&copy; " + self.sentence(), self.links(2, 6), f"<p>{self.prose(1, 2)}</p>")
        if r.random() < 0.8:
            parts.append(f'<footer data-content="0">{foot}</footer>')
        elif r.random() < 0.5:
            parts.append(self.named("div", ["footer", "site-footer", "copyright"], foot))
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(parts)}</body></html>"


def labelled_pages(number: int = TRAINING_PAGES, seed: int = 7) -> list[str]:
    """Pages whose elements say in ``data-content`` whether they are content."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(number)]


@functools.lru_cache(maxsize=1)
def trained() -> Potentials:
    """Potentials trained on the labelled pages, once per process."""
    return train(labelled_pages())


def extract_pages(
    pages: DataFrame,
    html_column: str = "html",
    text_column: str = "text",
    model: Potentials | None = None,
) -> DataFrame:
    """``pages`` without the source and with its main text, a line per block.

    White space inside a block becomes one space, character references are decoded, blocks stand
    in the page's order. A null or empty page has an empty text. A column of that name is
    replaced, all others stay. No row moves; memory is bounded by a slice of pages.
    """
    kept = pages.drop(text_column) if text_column != html_column else pages
    fields = [f for f in kept.schema.fields if f.name != html_column]
    schema = T.StructType([*fields, T.StructField(text_column, T.StringType())])
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html_column):
            forest = Forest()
            for page in part.column(html_column).to_pylist():
                forest.add(page or "")
            texts = pa.array(extract(forest, shared.value), pa.string())
            rest = part.drop_columns([html_column])
            yield rest.append_column(pa.field(text_column, pa.string()), texts)

    return kept.mapInArrow(run, schema)
