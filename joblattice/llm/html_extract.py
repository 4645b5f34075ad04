"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every stretch of text in it is a node with a binary
label: main content or not (an element is content if some text below it is).  A
node has a unary potential, linear in features of its tag, the words of its
class, id and role, its text's length, links and punctuation; every parent-child
edge has a 2 x 2 potential, one table for elements and one for text.  Messages
of the sum-product algorithm pass upward from the leaves and downward from the
root, level by level for a whole batch of pages at once; they yield the exact
marginal of each node, and text of marginal 0.5 or more is the main text.

Training maximises the likelihood of labelled pages by gradient ascent, whose
gradient needs the same marginals.  The labelled pages come as HTML in which
``data-label="1"`` stands on the elements that hold content; ``labelled_pages``
writes such pages from a seed over many layouts, and ``train_pages`` bounds how
many are fitted.  The parameters (some hundred numbers) go to the tasks.

Text: character references are decoded, white space inside a block becomes one
blank, a line break counts as white space, blocks are joined in page order by an
empty line.  Scripts, styles, form controls, the head and comments of the markup
are never text.

Edge cases: null or empty html gives an empty text; html without tags is one
block; tags left open or closed twice follow the usual rules (a block ends a
paragraph, a list item the one before it; the first content ends an open head; a
block ends a form control that is never closed); a quote that is never closed
doesn't reach beyond its tag; text outside of any tag's ``>`` at the end is no
text; a document of any depth and length is read whole, in time that grows with
its length; plain wrappers of a single element are passed over, however deep they
nest; repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element kinds of HTML, and words that page authors give to parts of a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr img br picture source data ruby rt rp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas video audio head title select textarea button input option datalist".split())
CONTROLS = frozenset("button select option datalist svg math object canvas video audio".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
WRAPPERS = frozenset("div section html body table tr td form fieldset".split()) | {""}
RAW = frozenset("script style textarea title noscript iframe template".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = frozenset("table ul ol dl body".split())
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset menu dialog body html address details".split()
HINTS = {
    "content": "article content main post story entry body text prose page",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs links",
    "frame": "header footer masthead topbar bottom copyright legal colophon",
    "side": "sidebar side aside rail related recommended popular trending more widget tags archive",
    "notice": "cookie cookies consent gdpr notice notification alert banner popup modal overlay disclaimer toast paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion",
    "talk": "comment comments discussion discuss replies reply respond disqus feedback thread reviews",
    "form": "form subscribe newsletter signup login search share social sharing follow contact",
}
_HINT_OF = {w: k for k, (_, ws) in enumerate(HINTS.items()) for w in ws.split()}
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
_N_TEXT = 9
N_FEATURES = 2 * (len(TAGS) + 1) + 2 * len(HINTS) + _N_TEXT + 4 + 2 * (len(HINTS) + 2)

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOTICE = re.compile(r"^[©®]|all rights reserved", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true|\bhidden\b", re.IGNORECASE)


@dataclass
class Tree:
    """Nodes in page order; node 0 is the root.  ``text`` is None for elements."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[int] = field(default_factory=lambda: [len(TAGS)])
    hints: list[int] = field(default_factory=lambda: [0])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])
    hidden: list[bool] = field(default_factory=lambda: [False])
    label: list[bool] = field(default_factory=lambda: [False])


class _Reader:
    """The tags of a page, one after the other; no stretch of the page is searched twice for the same thing."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.quotes = True
        self.ends: dict[str, int] = {}

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Start and end of the next tag, ``/`` if it closes, name and attributes; comments have no name."""
        page, start = self.page, at
        while (start := page.find("<", start)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                return start, end + 3 if end >= 0 else self.n, "", "", ""
            if page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                return start, end + 1 if end >= 0 else self.n, "", "", ""
            m = _NAME.match(page, start)
            if m:
                end = self._closing(m.end())
                return start, min(end + 1, self.n), m[1], m[2].lower(), page[m.end() : end]
            start += 1
        return self.n, self.n, "", "", ""

    def _closing(self, at: int) -> int:
        """Where the tag's ``>`` stands; quoted values are skipped, until a quote is found to be left open."""
        seek = at
        while self.quotes:
            m = _STOP.search(self.page, seek)
            if m and m[0] == ">":
                return m.start()
            seek = self.page.find(m[0][-1], m.end()) + 1 if m else 0
            self.quotes = seek > 0
        end = self.page.find(">", at)
        return end if end >= 0 else self.n

    def end_tag(self, name: str, at: int) -> int:
        """Where the next end tag of a name begins, -1 if there is none."""
        known = self.ends.get(name, 0)
        if 0 <= known < at or name not in self.ends:
            m = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(self.page, at)
            known = self.ends[name] = m.start() if m else -1
        return known

    def left_open(self, name: str, at: int) -> bool:
        """A control that begins here isn't closed before another of its kind begins."""
        end = self.end_tag(name, at)
        return end < 0 or bool(re.compile(rf"<{name}(?=[\s/>])", re.IGNORECASE).search(self.page, at, end))


def parse(page: str) -> Tree:
    """The block tree of a page."""
    tree, reader = Tree(), _Reader(page)
    stack: list[tuple[str, int]] = [("", 0)]
    places: dict[str, list[int]] = defaultdict(list)  # of each name's open elements on the stack
    pieces: list[str] = []
    links = in_link = silent = 0
    loose = 0  # where the stack holds a control that is never closed

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            _add(tree, stack[-1][1], len(TAGS), 0, text, links, False, tree.label[stack[-1][1]])
        links = 0

    def close(upto: int) -> None:
        nonlocal silent, loose
        flush()
        while len(stack) > upto:
            name = stack.pop()[0]
            places[name].pop()
            silent -= name in SILENT
        if loose >= upto:
            loose = 0

    at, n = 0, len(page)
    while at < n:
        start, end, closing, name, attributes = reader.next(at)
        raw = page[at:start]
        if raw and stack[-1][0] == "head" and not raw.isspace():
            close(len(stack) - 1)
        if raw and not silent:
            plain = html.unescape(raw) if "&" in raw else raw
            pieces.append(plain)
            links += len(plain) * bool(in_link)
        at = end
        if not name:
            continue
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name not in INLINE and places[name]:
                close(places[name][-1])
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD or name in CONTROLS and name == stack[-1][0]:
            close(len(stack) - 1)
        elif loose and name in ENDS_P:
            close(loose)
        if name in INLINE:
            if name == "br" and not silent:
                pieces.append(" ")
            in_link += name == "a"
            continue
        in_link = 0
        if name in ENDS_P and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in ENDS_SAME:
            latest = lambda names: max((places[x][-1] for x in names if places[x]), default=0)
            same = latest(ENDS_SAME[name])
            if same and same >= latest(FENCES):
                close(same)
        flush()
        if name in VOID or attributes.endswith("/") and name in ("svg", "iframe"):
            continue
        if name in RAW:
            to = reader.end_tag(name, at)
            if to >= 0:
                at = reader.next(to)[1]
            elif name in ("script", "style"):
                at = n
            elif name in ("title", "textarea"):
                at = page.find("<", at)
                at = at if at >= 0 else n
            continue
        hints = 0
        for value in _NAMES.findall(attributes):
            for word in _NAME_WORD.findall(value):
                k = _HINT_OF.get(word.lower())
                hints |= 0 if k is None else 1 << k
        parent = stack[-1][1]
        marked = tree.label[parent] or 'data-label="1"' in attributes
        node = _add(tree, parent, _TAG_OF.get(name, len(TAGS)), hints, None, 0, bool(_HIDDEN.search(attributes)), marked)
        places[name].append(len(stack))
        stack.append((name, node))
        silent += name in SILENT
        if name in CONTROLS and not loose and reader.left_open(name, at):
            loose = len(stack) - 1
    close(1)
    flush()
    return _without_wrappers(tree)


def _without_wrappers(tree: Tree) -> Tree:
    """The tree without plain elements whose only child is an element."""
    n = len(tree.parent)
    children, only_child = [0] * n, [0] * n
    for i in range(1, n):
        children[tree.parent[i]] += 1
        only_child[tree.parent[i]] = i
    plain = {_TAG_OF.get(t, len(TAGS)) for t in WRAPPERS}
    gone = [i > 0 and children[i] == 1 and tree.text[i] is None and tree.text[only_child[i]] is None and tree.tag[i] in plain and not tree.hints[i] and not tree.hidden[i] for i in range(n)]
    if not any(gone):
        return tree
    new, place = Tree([], [], [], [], [], [], []), [0] * n
    for i in range(n):
        if gone[i]:
            place[i] = place[tree.parent[i]]
            continue
        place[i] = len(new.parent)
        new.parent.append(place[tree.parent[i]] if i else -1)
        for name in ("tag", "hints", "text", "linked", "hidden", "label"):
            getattr(new, name).append(getattr(tree, name)[i])
    return new


def _add(tree: Tree, parent: int, tag: int, hints: int, text: str | None, linked: int, hidden: bool, label: bool) -> int:
    for column, value in zip((tree.parent, tree.tag, tree.hints, tree.text, tree.linked, tree.hidden, tree.label), (parent, tag, hints, text, linked, hidden, label), strict=True):
        column.append(value)
    return len(tree.parent) - 1


def _depths(tree: Tree) -> list[int]:
    out: list[int] = []
    for parent in tree.parent:  # a parent stands before its children
        out.append(out[parent] + 1 if parent >= 0 else 0)
    return out


def _around(tree: Tree) -> list[int]:
    """What lies around each node, as bits: the hints of its ancestors, an article or main part, a part that is never content by its tag."""
    bits = {_TAG_OF[t]: 1 << len(HINTS) for t in ("article", "main")} | {_TAG_OF[t]: 2 << len(HINTS) for t in ("nav", "footer", "aside", "form", "menu", "dialog")}
    out: list[int] = []
    for parent in tree.parent:
        out.append(out[parent] | tree.hints[parent] | bits.get(tree.tag[parent], 0) if parent >= 0 else 0)
    return out


class Forest:
    """The trees of several pages as arrays, in levels from the roots."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees])
        self.offsets = np.cumsum(sizes) - sizes
        flat = lambda name: [x for t in trees for x in getattr(t, name)]
        parent = np.array(flat("parent"))
        self.parent = np.where(parent < 0, -1, parent + np.repeat(self.offsets, sizes))
        self.texts = flat("text")
        depth = np.array([d for t in trees for d in _depths(t)])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.is_text = np.array([t is not None for t in self.texts])
        self.kind = self.is_text.astype(np.int64)
        self.features = self._features(np.array(flat("tag")), np.array(flat("hints")), np.array(flat("linked")), np.array(flat("hidden")), np.array([x for t in trees for x in _around(t)]))
        self.label = self._labels(np.array(flat("label")))

    def _features(self, tag: np.ndarray, hints: np.ndarray, linked: np.ndarray, hidden: np.ndarray, around: np.ndarray) -> np.ndarray:
        n, tags = len(tag), len(TAGS) + 1
        x = np.zeros((n, N_FEATURES))
        up = np.maximum(self.parent, 0)
        own = np.where(self.is_text, tag[up], tag)
        x[np.arange(n), own + tags * self.kind] = 1
        bits = (np.where(self.is_text, hints[up], hints)[:, None] >> np.arange(len(HINTS))) & 1
        at = 2 * tags
        x[:, at : at + len(HINTS)] = bits * ~self.is_text[:, None]
        x[:, at + len(HINTS) : at + 2 * len(HINTS)] = bits * self.is_text[:, None]
        at += 2 * len(HINTS)
        chars = np.array([len(t) if t is not None else 0 for t in self.texts])
        stops = np.array([sum(map(t.count, ".,;:!?")) if t is not None else 0 for t in self.texts])
        words = np.array([t.count(" ") + 1 if t is not None else 0 for t in self.texts])
        leaf = self.is_text
        x[leaf, at] = np.minimum(linked[leaf] / np.maximum(chars[leaf], 1), 1)
        x[leaf, at + 1] = np.minimum(stops[leaf] / np.maximum(words[leaf], 1), 0.5)
        for k, edge in enumerate((3, 8, 20, 50, 120)):
            x[leaf, at + 2 + k] = words[leaf] >= edge
        x[leaf, at + 7] = [_NOTICE.search(t) is not None for t in self.texts if t is not None]
        x[leaf, at + 8] = 1
        at += _N_TEXT
        x[:, at] = ~leaf
        x[:, at + 1] = hidden
        x[:, at + 2] = self.parent < 0
        inside, in_links = chars.astype(np.float64), np.minimum(linked, chars).astype(np.float64) * leaf
        for level in self.levels[:0:-1]:  # of an element the text of all that lies in it
            np.add.at(inside, self.parent[level], inside[level])
            np.add.at(in_links, self.parent[level], in_links[level])
        x[:, at + 3] = in_links / np.maximum(inside, 1) * ~leaf
        at, wide = at + 4, len(HINTS) + 2
        bits = (around[:, None] >> np.arange(wide)) & 1
        x[:, at : at + wide] = bits * ~leaf[:, None]
        x[:, at + wide : at + 2 * wide] = bits * leaf[:, None]
        return x

    def _labels(self, marked: np.ndarray) -> np.ndarray:
        label = marked & self.is_text
        for level in self.levels[:0:-1]:
            np.logical_or.at(label, self.parent[level], label[level])
        return label.astype(np.int64)


@dataclass
class Model:
    """Weights of the features for "content", and the edge potentials by kind of child, label of parent, label of child."""

    weights: np.ndarray
    edges: np.ndarray


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """P(content) of each node, the joint of each node with its parent (by parent label, own label), and the log partition sum."""
    n = len(forest.parent)
    inside = np.zeros((n, 2))
    inside[:, 1] = forest.features @ model.weights
    table = model.edges[forest.kind]
    message = np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        message[level] = _log_sum(table[level] + inside[level][:, None, :], 2)
        np.add.at(inside, forest.parent[level], message[level])
    roots = forest.levels[0] if len(forest.levels) else np.zeros(0, np.int64)
    total = float(_log_sum(inside[roots], 1).sum()) if len(roots) else 0.0
    belief = np.zeros((n, 2))
    belief[roots] = inside[roots] - _log_sum(inside[roots], 1)[:, None]
    joint = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        up = forest.parent[level]
        both = (belief[up] - message[level])[:, :, None] + table[level] + inside[level][:, None, :]
        joint[level] = np.exp(both)
        belief[level] = _log_sum(both, 1)
    return np.exp(belief[:, 1]), joint, total


def fit(pages: list[str], rounds: int = 150, rate: float = 0.12, shrink: float = 0.005) -> Model:
    """Maximum likelihood with a squared penalty, by Adam steps on the exact gradient."""
    forest = Forest([parse(p) for p in pages])
    x, y = forest.features, forest.label
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    theta = np.zeros(N_FEATURES + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        model = Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))
        p, joint, _ = marginals(forest, model)
        guess = np.zeros((2, 2, 2))
        np.add.at(guess, forest.kind[child], joint[child])
        grad = np.concatenate([x.T @ (y - p), (seen - guess).ravel()]) / len(pages) - shrink * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p or "") for p in pages]
    forest = Forest(trees)
    p, _, _ = marginals(forest, model)
    out = []
    for tree, a in zip(trees, forest.offsets.tolist(), strict=True):
        keep = p[a : a + len(tree.parent)] >= 0.5
        out.append("\n\n".join(t for t, k in zip(tree.text, keep, strict=True) if k and t is not None))
    return out


# ------------------------------------------------------------ labelled pages


class _Writer:
    """Writes one labelled page: invented words in one of many layouts."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def one(self, *of):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        made = ["".join(self.one("ta", "re", "mi", "so", "lun", "the", "der", "que", "con", "el", "ing", "an") for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        text = " ".join(w + (self.one(",", ".") if self.chance(0.12) else "") for w in made)
        return text[:1].upper() + text[1:] + (self.one(".", "", ".") if n < 5 else ".")

    def links(self, low: int, high: int) -> str:
        item = self.one("<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li><a href='/x'>{}</a>")
        body = "".join(item.format(self.words(1, 4)) for _ in range(int(self.rng.integers(low, high + 1))))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def part(self, kind: str, inner: str) -> str:
        """Something that isn't content, named as its authors would, or only by its tag."""
        names = HINTS[kind].split()
        tag = {"menu": ("nav", "div", "nav", "ul"), "frame": ("header", "footer", "div"), "side": ("aside", "div", "section"), "notice": ("div", "section", "dialog", "aside"), "advert": ("div", "aside", "section"), "talk": ("section", "div"), "form": ("form", "div", "form")}[kind]
        tag = self.one(*tag)
        if (kind == "menu" or inner.startswith("&copy;")) and self.chance(0.25):  # nothing but what it holds tells what it is
            return self.one("<div>{}</div>", '<div class="top">{}</div>', '<div class="{}">{{}}</div>'.format(self.words(1, 1).strip(".,").lower()), "<div><div>{}</div></div>", "<section>{}</section>").format(inner)
        lone = tag in ("nav", "header", "footer", "aside", "form", "dialog") and self.chance(0.5)
        name = "" if lone else f' {self.one("class", "class", "id")}="{self.one("", "", "site-", "box ", "c-")}{self.one(*names)}{self.one("", "", "-box", "_1", " wide")}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def junk(self) -> str:
        kind = self.one("menu", "frame", "side", "notice", "advert", "form")
        prose = lambda: self.one("<p>{}</p>", "{}", "<span>{}</span>", "<div>{}</div>").format(self.words(1, 40))
        inner = {"menu": lambda: self.links(3, 8), "frame": lambda: self.one("&copy; ", "&copy; All rights reserved. ", "", "<h1>") + prose() + self.one("", self.links(1, 4)), "side": lambda: self.one("<h3>" + self.words(1, 4) + "</h3>", "") + self.one(self.links(2, 6), prose()), "form": lambda: f"<label>{self.words(1, 4)}</label><input name='q'>" + self.one("", prose()) + "<button>Go</button>"}.get(kind, prose)()
        return self.part(kind, inner)

    def block(self) -> str:
        """A block of content."""
        low, high = self.one((1, 2), (3, 12), (8, 40), (30, 160))
        text = self.words(low, high)
        if self.chance(0.15):
            text = text.replace(" ", " <a href='/y'>", 1) + "</a>"
        return self.one("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li><li>" + self.words(2, 12) + "</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<div>{}</div>", "<table><tr><td>{}</td><td>" + self.words(1, 6) + "</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>").format(text)

    def page(self) -> str:
        inside = []
        for _ in range(1 if self.chance(0.25) else int(self.rng.integers(1, 14))):
            if self.chance(0.08):
                inside.append(self.junk())
            inside.append(f'<div data-label="1">{self.block()}</div>' if self.chance(0.1) else self.block().replace(">", ' data-label="1">', 1))
        head = f'<h1 data-label="1">{self.words(1, 12)}</h1>' if self.chance(0.75) else ""
        names = self.one("", "", ' class="{}"', ' id="{}"').format(self.one(*HINTS["content"].split()) + self.one("", "-body", "-wrap", "Area"))
        if head and self.chance(0.25):
            head = self.one("<header>{}</header>", '<header class="post-header">{}</header>', '<div class="title">{}</div>', "<header><div>{}</div></header>").format(head)
        tag = self.one("article", "article", "main", "div", "section", "div")
        body = f"<{tag}{names}>{head}{''.join(inside)}</{tag}>"
        if self.chance(0.35):
            body = self.one("<main>{}</main>", '<div id="wrap">{}</div>', '<div class="row"><div class="col">{}</div></div>', '<div class="page">{}</div>').format(body)
        before = [self.junk() for _ in range(int(self.rng.integers(0, 4)))]
        if self.chance(0.7):
            before.insert(0, self.part("menu", self.links(3, 8)))
        after = [self.junk() for _ in range(int(self.rng.integers(0, 3)))]
        if self.chance(0.35):
            said = "".join(self.one('<div class="comment"><p>{}</p></div>', "<article><p>{}</p></article>", "<li><p>{}</p></li>", "<p>{}</p>").format(self.words(2, 60)) for _ in range(int(self.rng.integers(1, 6))))
            after.insert(0, self.part("talk", self.one("<h3>" + self.words(1, 3) + "</h3>", "") + said))
        if self.chance(0.7):
            after.append(self.part("frame", "&copy; " + self.words(1, 20)))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [_Writer(rng).page() for _ in range(n)]


@functools.lru_cache(maxsize=4)
def fitted(train_pages: int, seed: int) -> Model:
    """The model of a number of labelled pages, fitted once per process."""
    return fit(labelled_pages(train_pages, seed))


def extract(pages: DataFrame, model: Model | None = None, train_pages: int = 400, seed: int = 11) -> DataFrame:
    """page_id, url, text and n_chars of every page; without a model one is fitted on ``train_pages`` labelled pages."""
    model = model or fitted(train_pages, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = main_texts(batch.column(2).to_pylist(), model)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
