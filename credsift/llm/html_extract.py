"""Main text of HTML pages by gradient-boosted trees over DOM nodes, decoded over the hierarchy.

A tolerant parser makes a tree of the block elements and of the text runs between them. Trees boosted on logistic loss give every
node a probability of being main text from its tag, attribute tokens, depth, subtree density, links, place and siblings. The
labelling of highest likelihood in which nothing below a dropped node is kept is found in one pass up and one down,
so ancestor and descendant never contradict each other.

There is no labelled table, so the trees are trained on pages that `made_page` writes in many layouts, with or without telling
tags and attributes; their labels are known.

A block's character references are decoded, its white space turned into single spaces and trimmed; blocks are joined by
newlines in page order. <br> is white space.

Defined results: a null or empty page has empty text; pages without tags are one block; unclosed and stray tags are mended as
browsers do in the common cases; other columns, repeated rows and empty tables pass through untouched.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from html import unescape
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import common

# Elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style textarea title noscript template select option button iframe noembed noframes datalist".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An element of the key ends an open one of the value, unless one of SCOPE lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl div article section aside nav body html form blockquote main header footer".split())
SCOPE_OF_P = SCOPE | {"td", "th", "li"}
#: Attribute tokens that tell a role, by role.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pager pagination sitemap skip dropdown submenu",
    "head": "header masthead topbar branding logo top hero",
    "foot": "footer foot bottom colophon copyright legal imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more trending popular archive tags tagcloud",
    "notice": "cookie cookies consent gdpr notice notices alert warning banner modal popup overlay toast paywall subscribe newsletter signup disclaimer privacy",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense commercial partner",
    "form": "form search login signin register contact share sharing social follow feedback poll vote buttons toolbar",
    "talk": "comment comments commentlist discussion disqus reply replies respond response responses thread reader readers reviews",
    "main": "article content main post entry story text prose body maincontent articlebody postbody entrycontent page",
}
ROLE_OF = {t: k for k, (_, tokens) in enumerate(TOKENS.items()) for t in tokens.split()}
ROLES = len(TOKENS)
TAG_KINDS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul ol menu dl", "li dt dd", "h1", "h2 h3 h4 h5 h6", "table tbody thead tr", "td th", "blockquote", "pre", "figure figcaption", "#text", "body html")
TAG_OF = {t: k for k, tags in enumerate(TAG_KINDS) for t in tags.split()}

#: A comment or the like, a tag, or the start of a tag that doesn't end.
MARKUP = re.compile(r"<(?:!--(?:.*?-->|.*)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|()))", re.S)
START = re.compile(r"<(?:!--(?:.*?-->|.*)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+))", re.S)
BREAK = re.compile("[>\"']")
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop|data-component|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("chars", "children", "depth", "form", "link", "order", "parent", "parts", "roles", "stops", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, roles: int = 0):
        self.tag, self.parent, self.roles = tag, parent, roles
        self.children: list[Node] = []
        self.parts: list[tuple[str, bool]] | None = None  # text of a leaf, with whether it is in a link
        self.depth = parent.depth + 1 if parent else 0
        self.tags = self.form = 0


def roles_of(attributes: str) -> int:
    """Bits of the roles that the attribute tokens tell."""
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        for token in SPLIT.findall(CAMEL.sub(" ", value).lower()):
            role = ROLE_OF.get(token)
            if role is not None:
                found |= 1 << role
    return found


class Markup:
    """The tags of a page, in one pass of linear time: (start, end, "/" of an end tag, name, attributes), name None for comments and the like.

    A tag ends at the first > outside of quotes. Where there is none its < is text. Places from which a search for that end has
    failed are remembered, so that no later tag searches the rest of a page again.
    """

    def __init__(self, html: str):
        self.html, self.failed = html, set()
        self.last = {c: html.rfind(c) for c in ">\"'"}

    def end_of(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes start at `at`, -1 for none."""
        passed = []
        while at not in self.failed and at <= self.last[">"]:
            passed.append(at)
            m = BREAK.search(self.html, at)
            if m[0] == ">":
                return m.start()
            if self.last[m[0]] <= m.start():
                break
            at = self.html.index(m[0], m.end()) + 1
        self.failed.update(passed)
        return -1

    def tags(self, skip):
        """skip() is the place before which nothing counts any more."""
        html, place, careful = self.html, 0, False
        while m := (START if careful else MARKUP).search(html, max(place, skip())):
            start, place = m.span()
            if m[2] is None:
                yield start, place, "", None, ""
            elif not careful and m[4] is None:
                yield start, place, m[1], m[2], m[3]
            else:
                # from the first tag without an end on, ends are searched with a memory
                careful = True
                end = self.end_of(place)
                if end < 0:
                    place = start + 1
                else:
                    yield start, end + 1, m[1], m[2], html[place:end]
                    place = end + 1


class Open:
    """Open elements, inline ones too, each with the block that it stands in; finds the innermost of a name without walking."""

    def __init__(self, root: Node):
        self.stack = [("html", root)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes, self.cells = [0], [0], [0]
        self.lists: dict[str, tuple[list[int], ...]] = {}

    def push(self, tag: str, node: Node) -> None:
        at = len(self.stack)
        self.stack.append((tag, node))
        found = self.places.get(tag)
        if found is None:
            self.places[tag] = [at]
        else:
            found.append(at)
        for kept in self.kept(tag):
            kept.append(at)

    def kept(self, tag: str) -> tuple[list[int], ...]:
        """The lists that an element of this name stands in."""
        found = self.lists.get(tag)
        if found is None:
            found = self.lists[tag] = tuple(kept for kept, tags in ((self.blocks, BLOCKS), (self.scopes, SCOPE), (self.cells, SCOPE_OF_P)) if tag in tags)
        return found

    def pop(self, to: int) -> list[str]:
        """Ends the elements from place `to` on; their names, innermost first."""
        ended = []
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            for kept in self.kept(tag):
                kept.pop()
            ended.append(tag)
        return ended

    def innermost(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else 0

    def outermost(self, tags: set[str], above: int) -> int:
        """Place of the outermost of these elements above a place, 0 for none."""
        return min((p[bisect_right(p, above)] for t in tags if (p := self.places.get(t)) and p[-1] > above), default=0)


def parse(html: str) -> Node:
    """Tree of block elements and text runs."""
    root = node = Node("html", None)
    still = Open(root)
    run: Node | None = None
    linked = dropped = 0
    place = 0

    def text(piece: str) -> None:
        nonlocal run
        if dropped or not piece:
            return
        if run is None:
            if piece.isspace():
                return
            run = Node("#text", node)
            run.parts = []
            node.children.append(run)
        run.parts.append((piece, linked > 0))

    def close(to: int) -> None:
        nonlocal node, run, linked, dropped
        for tag in still.pop(to):
            linked -= tag == "a"
            dropped -= tag in DROPPED
            if tag in BLOCKS:
                run = None
        node = still.stack[-1][1]

    for start, end, slash, tag, attributes in Markup(html).tags(lambda: place):
        text(html[place:start])
        place = end
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            at = still.innermost(tag)
            # an inline end tag doesn't end a block
            if at and (tag in BLOCKS or tag in DROPPED or at >= still.blocks[-1]):
                close(at)
            continue
        if tag in CLOSES_P and (at := still.innermost("p")) and at > still.cells[-1]:
            close(at)
        ends = ENDS.get(tag)
        if ends and (at := still.outermost(ends, still.scopes[-1])):
            close(at)
        if tag == "body" and still.places.get("head"):
            close(still.places["head"][0])
        if tag == "br":
            text(" ") if run is not None else None
        if tag in BLOCKS and tag != "html":
            run = None
            if not dropped and tag != "hr":
                new = Node(tag, node, roles_of(attributes) if attributes else 0)
                node.children.append(new)
                node = new
        elif not dropped:
            node.tags += 1
            node.form += tag in ("input", "button", "select", "textarea", "label")
        if tag in RAW:
            m = RAW_END[tag].search(html, place)
            if tag not in DROPPED:
                text(html[place : m.start() if m else len(html)])
            place = html.find(">", m.end()) + 1 or len(html) if m else len(html)
        elif tag not in VOID and tag != "html" and not attributes.endswith("/"):
            linked += tag == "a"
            dropped += tag in DROPPED
            still.push(tag, node)
        elif tag in BLOCKS and tag != "html" and tag != "hr":
            node = still.stack[-1][1]
    if place < len(html):
        text(html[place:])
    return root


def measured(root: Node) -> list[Node]:
    """Nodes in page order, with the sums of their subtrees; single runs are merged into their element."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.children) == 1 and node.children[0].parts is not None:
            node.parts, node.children = node.children[0].parts, []
        node.order = len(order)
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.chars = node.link = node.stops = 0
        if node.parts is not None:
            for piece, in_link in node.parts:
                n = len(piece)
                node.chars += n
                if in_link:
                    node.link += n
                node.stops += piece.count(".") + piece.count(",") + piece.count("!") + piece.count("?")
            node.tags += 1
        for child in node.children:
            node.chars += child.chars
            node.link += child.link
            node.stops += child.stops
            node.tags += child.tags + 1
            node.form += child.form
    return order


def block_text(node: Node) -> str:
    return " ".join("".join([unescape(p) if "&" in p else p for p, _ in node.parts]).split())


def features(order: list[Node]) -> np.ndarray:
    """One row a node."""
    total = max(1, order[0].chars)
    seen, above, rows = 0, {}, []
    place = {child.order: k for node in order for k, child in enumerate(node.children)}
    for node in order:
        parent = node.parent
        upper = above[parent.order] if parent is not None else (0, 0)
        tag = TAG_OF.get(node.tag, 1)
        # roles and telling tags of the ancestors
        above[node.order] = (upper[0] | node.roles, upper[1] | 1 << tag)
        row = [
            tag, node.depth, log1p(node.chars), node.link / (node.chars + 1), node.chars / (node.tags + 1), node.stops / (node.chars + 1) * 100, node.form, len(node.children), node.chars / total, seen / total,
        ]
        row += [node.roles >> k & 1 for k in range(ROLES)]
        row += [upper[0] >> k & 1 for k in range(ROLES)]
        row += [upper[1] >> k & 1 for k in (3, 4, 5, 6, 7, 8, 9, 10)]
        if parent is None:
            row += [0] * 12
        else:
            mates = parent.children
            at = place[node.order]
            before, after = mates[at - 1] if at else None, mates[at + 1] if at + 1 < len(mates) else None
            row += [at, len(mates) - 1 - at, parent.chars / total, parent.link / (parent.chars + 1), node.chars / (parent.chars + 1), TAG_OF.get(parent.tag, 1)]
            for mate in (before, after):
                row += [-1, -1, -1] if mate is None else [log1p(mate.chars), mate.link / (mate.chars + 1), TAG_OF.get(mate.tag, 1)]
        rows.append(row)
        if node.parts is not None:
            seen += node.chars
    return np.array(rows, np.float32)


class Trees:
    """Gradient-boosted regression trees on logistic loss, by histograms of binned features."""

    def __init__(self, count: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 4.0):
        self.count, self.depth, self.rate, self.bins, self.least = count, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        n, width = b.shape
        self.base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        f = np.full(n, self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
            feature, cut = np.full(2**self.depth - 1, -1, np.int64), np.zeros(2**self.depth - 1, np.int64)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                local = at - first
                best = np.full(nodes, 1e-6)
                for j in range(width):
                    key = local * self.bins + b[:, j]
                    gs = np.bincount(key, g, nodes * self.bins).reshape(nodes, -1).cumsum(1)
                    hs = np.bincount(key, h, nodes * self.bins).reshape(nodes, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least * 0.05) | (ht - hs < self.least * 0.05)] = 0
                    k = gain.argmax(1)
                    v = gain[np.arange(nodes), k]
                    better = v > best
                    best[better] = v[better]
                    feature[first : first + nodes][better], cut[first : first + nodes][better] = j, k[better]
                split = feature[at]
                right = (split >= 0) & (b[np.arange(n), np.maximum(split, 0)] > cut[at])
                at = 2 * at + 1 + right
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f, rows = np.full(len(b), self.base), np.arange(len(b))
        for feature, cut, value in self.trees:
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                split = feature[at]
                at = 2 * at + 1 + ((split >= 0) & (b[rows, np.maximum(split, 0)] > cut[at]))
            f += value[at - (2**self.depth - 1)]
        return f


def decode(order: list[Node], odds: np.ndarray) -> list[bool]:
    """Whether each node is kept: the likeliest labels in which all below a dropped node is dropped; the page itself is kept."""
    gain = odds.tolist()  # of keeping a node over dropping it, given that its ancestors are kept
    for node in reversed(order):
        if gain[node.order] > 0 and node.parent is not None:
            gain[node.parent.order] += gain[node.order]
    kept = [False] * len(order)
    for node in order:
        kept[node.order] = node.parent is None or kept[node.parent.order] and gain[node.order] > 0
    return kept


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page."""
    orders = [measured(parse(p)) if p else [] for p in pages]
    some = [features(o) for o in orders if o]
    if not some:
        return [""] * len(pages)
    odds, out, at = trees.log_odds(np.concatenate(some)), [], 0
    for order in orders:
        kept = decode(order, odds[at : at + len(order)])
        at += len(order)
        out.append("\n".join(t for n in order if n.parts is not None and kept[n.order] and (t := block_text(n))))
    return out


def main_text(spark, trees: Trees, html: Column) -> Column:
    """Column of the main text of each whole page."""
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series(extract(list(pages), shared.value), dtype=object)

    return of(html)


#: Stands before main text on training pages, so labels survive parsing.
MARK = "\ue000"
#: Pages of the training set.
TRAIN_PAGES = 700


class Writer:
    """Writes training pages: random words in random layouts, main text marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        out = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        return " ".join(out)

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.r.choice("....!?") for _ in range(self.r.randint(least, most)))

    def named(self, tag: str | None, role: str | None, body: str, telling: float = 0.85) -> str:
        """An element that tells its role by tag, attributes, both, or neither."""
        r = self.r
        use_tag = tag if tag and r.random() < 0.6 else "div" if r.random() < 0.8 else "section"
        attributes = ""
        if role and (r.random() < telling if use_tag == tag else r.random() < 0.97):
            token = r.choice(TOKENS[role].split())
            if r.random() < 0.4:
                token = r.choice((f"{token}-{self.words(1, 1)}", f"{self.words(1, 1)}_{token}", f"{token} {self.words(1, 1)}", f"{self.words(1, 1)}{token.capitalize()}"))
            attributes = f' {r.choice(("class", "class", "id", "role" if r.random() < 0.2 else "class"))}="{token}"'
        elif r.random() < 0.4:
            attributes = f' class="{self.words(1, 1)}{r.randint(0, 99)}"'
        return f"<{use_tag}{attributes}>{body}</{use_tag}>"

    def link(self) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>'

    def links(self) -> str:
        r = self.r
        items = [self.link() for _ in range(r.randint(2, 9))]
        return r.choice((lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{i}</div>" for i in items), lambda: " ".join(items)))()

    def prose(self, main: bool, most: int = 6) -> str:
        mark = MARK if main else ""
        text = self.sentences(1, most)
        if self.r.random() < 0.25:
            cut = text.split(" ")
            k = self.r.randrange(len(cut))
            cut[k] = self.r.choice(("<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>")).format(cut[k])
            text = " ".join(cut)
        return mark + text

    def advert(self) -> str:
        return self.named("aside", "ad", self.r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", self.link(), f"<h4>{self.words(1, 4)}</h4><p>{self.sentences(1, 2)}</p>{self.link()}")), 1.0)

    def notice(self) -> str:
        body = self.r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>")) + self.r.choice(("", "<button>ok</button>", self.link()))
        return self.named(None, "notice", body, 1.0)

    def form(self) -> str:
        label = self.words(1, 4)
        inner = self.r.choice((f"<label>{label}</label><input>", f"<p>{self.sentences(1, 2)}</p><input><button>go</button>", f"{label} <input> <select><option>a</option></select>"))
        return f"<form{self.r.choice(('', ' class=form', ' id=search'))}>{inner}</form>"

    def talk(self) -> str:
        r = self.r
        each = lambda: f"<p>{self.sentences(1, 3)}</p>" if r.random() < 0.7 else self.sentences(1, 3)
        inner = "".join(r.choice((f"<div class=comment><b>{self.words(1, 2)}</b> {each()}{self.link()}</div>", f"<li><cite>{self.words(1, 2)}</cite>{each()}</li>", f"<div><span>{self.words(1, 2)}</span>{each()}</div>", f"<article class='comment'>{each()}</article>", each())) for _ in range(r.randint(1, 6)))
        head = f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.7 else ""
        return self.named("section", "talk", head + inner + (self.form() if r.random() < 0.4 else ""), 1.0)

    def side(self) -> str:
        r = self.r
        parts = [r.choice((lambda: f"<h3>{self.words(1, 3)}</h3>" + self.links(), lambda: f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1, 3)}</p>", self.advert, self.form, lambda: f"<p>{self.sentences(1, 2)}</p>"))() for _ in range(r.randint(1, 4))]
        return self.named("aside", "side", "".join(parts))

    def foot(self) -> str:
        r = self.r
        parts = [r.choice((lambda: f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", self.links, lambda: f"<p>{self.sentences(1, 3)}</p>", lambda: f"&copy; {self.words(1, 3)}"))() for _ in range(r.randint(1, 3))]
        return self.named("footer", "foot", "".join(parts), 0.7)

    def head(self) -> str:
        r = self.r
        parts = [r.choice((lambda: f"<h1>{self.words(1, 4)}</h1>", lambda: self.link(), lambda: f"<p>{self.sentences(1, 1)}</p>", lambda: self.named("nav", "menu", self.links()), lambda: f"<div>{self.words(1, 3)}</div>"))() for _ in range(r.randint(1, 3))]
        return self.named("header", "head", "".join(parts), 0.8)

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<{(h := r.choice(('h1', 'h1', 'h2')))}>{MARK}{self.words(2, 12)}</{h}>"
            out.append(f"<header>{title}</header>" if r.random() < 0.1 else title)
        for _ in range(r.choice((0, 1, 1, 2, 4, 8, 14))):
            k = r.random()
            if k < 0.7:
                out.append(r.choice((f"<p>{self.prose(True)}</p>", f"<p>{self.prose(True)}", f"<p><b>{self.prose(True)}<br><p>{self.prose(True)}</p>", f"<p>{self.prose(True, 1)}</p>")))
            elif k < 0.76:
                out.append(f"<h2>{MARK}{self.words(1, 7)}</h2><p>{self.prose(True)}</p>")
            elif k < 0.81:
                out.append(r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{self.prose(True, 2)}</li>" for _ in range(r.randint(2, 5)))))
            elif k < 0.84:
                out.append(f"<blockquote>{r.choice(('<p>{}</p>', '{}')).format(self.prose(True, 2))}</blockquote>")
            elif k < 0.87:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.89:
                out.append(f"<figure><img src=x><figcaption>{self.prose(True, 1)}</figcaption></figure>")
            elif k < 0.91:
                out.append(f"<pre>{MARK}{self.words(3, 20)}</pre>")
            elif k < 0.93:
                out.append(f"<div>{self.prose(True)}</div>")
            else:
                out.append(r.choice((self.advert, self.notice, self.form, lambda: self.named(None, "form", self.links(), 1.0), lambda: self.named("aside", "side", f"<h4>{self.words(1, 3)}</h4>" + self.links(), 1.0)))())
        if r.random() < 0.12:
            out.append(self.talk())
        body = "".join(out)
        if r.random() < 0.7:
            body = f"<article>{body}</article>"
        elif r.random() < 0.7:
            body = f'<div class="{r.choice(TOKENS["main"].split())}">{body}</div>'
        else:
            body = f"<div>{body}</div>"
        return body

    def page(self) -> str:
        r = self.r
        before = [p() for p, share in ((self.notice, 0.15), (self.head, 0.5), (lambda: self.named("nav", "menu", self.links()), 0.7), (self.advert, 0.4), (self.form, 0.1), (self.side, 0.12), (lambda: self.named("nav", "menu", " &gt; ".join(self.link() for _ in range(3))), 0.1)) if r.random() < share]
        after = [p() for p, share in ((self.talk, 0.4), (self.advert, 0.2), (self.side, 0.35), (self.notice, 0.12), (self.form, 0.1), (self.foot, 0.75)) if r.random() < share]
        body = self.article()
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inner = r.random() < 0.5 and after
            body = self.named("main", r.choice((None, "main")), body + (after.pop(0) if inner else ""))
        body = "".join(before) + body + "".join(after)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


_trained: dict[tuple[int, int], Trees] = {}


def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Trees:
    """Trees fitted on made pages; the same for every call."""
    if (pages, seed) not in _trained:
        writer, xs, ys, ws = Writer(seed), [], [], []
        for _ in range(pages):
            order = measured(parse(writer.page()))
            marked = [0] * len(order)
            for node in reversed(order):
                if node.parts is not None and any(MARK in p for p, _ in node.parts):
                    marked[node.order] = node.chars
                if node.parent is not None:
                    marked[node.parent.order] += marked[node.order]
            xs.append(features(order))
            ys += [2 * m > n.chars for m, n in zip(marked, order, strict=True)]
            ws += [2.0 if n.parts is not None else 1.0 for n in order]
        _trained[pages, seed] = Trees().fit(np.concatenate(xs), np.array(ys, float), np.array(ws))
    return _trained[pages, seed]
