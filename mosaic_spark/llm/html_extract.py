"""Main-text extraction with gradient-boosted trees over DOM nodes.

A page becomes a tree of elements and text leaves. Each node has features of its
subtree (density, links, tag counts), attribute tokens of itself and above, depth
and sibling statistics. Boosted trees give three log-probabilities a node: keep the
whole subtree, drop it, or mixed. Decoding is hierarchical: a dynamic program finds
the best labelling in which a kept or dropped node decides all that is below it,
so an ancestor and a descendant never contradict each other.

The trees are trained here, on invented pages of a seeded generator whose layouts,
tags and attribute names vary; no page of the corpus is used. Whole pages are read:
nothing is cut or capped."""

from __future__ import annotations

import functools
import html as entities
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Invented pages that the trees are trained on.
TRAINING_PAGES, ROUNDS, LEAF_DEPTH, BINS, RATE = 260, 24, 4, 24, 0.3

# Element categories of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SCOPES = set("ul ol dl table select button html body article section div nav aside main header footer form td th li".split())
#: Groups of tags and of attribute tokens that features count.
TAGS = ["nav menu", "header", "footer", "aside", "form fieldset", "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "a", "table thead tbody tr td th", "figure figcaption", "blockquote", "pre code", "b i em strong span u small", "button input select option textarea label", "script style noscript template svg iframe object", "head title meta link", "#text", "html body"]
TOKENS = [
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip", "header masthead branding logo hero topbar top", "footer colophon copyright bottom legal",
    "sidebar aside rail widget related recommended trending popular more secondary complementary", "ad ads advert advertisement adverts sponsor sponsored promo promotion banner adbox",
    "cookie cookies consent notice gdpr alert popup modal newsletter subscribe paywall overlay message toast announcement warning", "share sharing social tweet follow",
    "comment comments commentlist reply replies disqus discussion respond reader", "content article post story entry main body text page prose", "form search login signup contact", "byline author date meta tags tag category caption",
]
_TAG = {t: i for i, g in enumerate(TAGS) for t in g.split()}
_TOKEN = {t: i for i, g in enumerate(TOKENS) for t in g.split()}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_LIMIT = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'<>/=]+)""")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """``block`` is the nearest element of itself and above that is not inline, and
    ``part`` the nearest that is no heading either."""

    __slots__ = ("tag", "tokens", "hidden", "parent", "kids", "text", "block", "part")

    def __init__(self, tag: str, parent: Node | None, text: str = "") -> None:
        self.tag, self.parent, self.text, self.kids, self.tokens, self.hidden = tag, parent, text, [], (), False
        inline = parent is not None and tag in INLINE
        self.block = parent.block if inline else self
        self.part = parent.part if inline or tag in HEADINGS else self
        if parent is not None:
            parent.kids.append(self)


class Lexer:
    """Tags, comments and texts of a page in one forward pass. Whether a tag that holds
    a place outside quotes comes to its end does not depend on where it begins, so
    places that lead nowhere are remembered and each is passed once."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.limits = [m.start() for m in _LIMIT.finditer(page)]
        self.dead: set[int] = set()
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def tag_end(self, at: int) -> int:
        """Place of the bracket that closes a tag of which ``at`` is outside quotes, or -1."""
        k, passed = bisect_left(self.limits, at), []
        while k < len(self.limits) and self.last[">"] >= at:
            at = self.limits[k]
            if at in self.dead:
                break
            if self.page[at] == ">":
                return at
            passed.append(at)
            if self.last[self.page[at]] == at:
                break
            at = self.page.index(self.page[at], at + 1) + 1
            k = bisect_left(self.limits, at)
        self.dead.update(passed)
        return -1

    def next(self, at: int):
        """(start, end, kind, match, raw) of the next markup from ``at``: kind "tag",
        "text" (character data) or "" (nothing to show); None where none is left."""
        page, n = self.page, len(self.page)
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, n if end < 0 else end + 3, "", None, ""
            if page.startswith("<![CDATA[", at):
                end = page.find("]]>", at + 9)
                return at, n if end < 0 else end + 3, "text", None, page[at + 9 : n if end < 0 else end]
            if page.startswith(("<!", "<?"), at):
                if self.last[">"] > at:
                    return at, page.index(">", at) + 1, "", None, ""
            elif m := _NAME.match(page, at + 1):
                end = self.tag_end(m.end())
                if end >= 0:
                    return at, end + 1, "tag", m, page[m.end() : end]
            at += 1
        return None


def parse(page: str) -> Node:
    """A tree from any text, in time proportional to it; unclosed and misnested tags
    never fail."""
    root = here = Node("#root", None)
    lexer, at, n = Lexer(page), 0, len(page)
    opened: Counter = Counter()  # open elements of each tag, so that nothing is looked for in vain

    def up_to(node: Node) -> Node:
        nonlocal here
        while here is not node:
            opened[here.tag] -= 1
            here = here.parent
        return node

    while at < n:
        found = lexer.next(at)
        stop = found[0] if found else n
        if stop > at:
            Node("#text", here, entities.unescape(page[at:stop]))
        if not found:
            break
        _, at, kind, m, raw = found
        if kind == "text":
            Node("#text", here, raw)
        if kind != "tag":
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                up_to(up.parent)
            continue
        up_to(_implied(here, tag, opened))
        node = Node(tag, here)
        if raw.strip(" /"):
            _attributes(node, raw)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            end = close.start() if close else n
            if tag in ("textarea", "title"):
                Node("#text", node, entities.unescape(page[at:end]))
            at = close.end() if close else n
        elif tag not in VOID and not (raw.endswith("/") and tag in ("svg", "path", "use", "g", "circle", "rect")):
            here = node
            opened[tag] += 1
    return root


def _implied(here: Node, tag: str, opened: Counter) -> Node:
    """The element that a new one belongs to, as some close others by their mere start."""
    if tag in CLOSES_P and opened["p"]:
        up = here.part if tag in HEADINGS else here.block
        if up.tag == "p":
            return up.parent
    same = SAME_CLOSES.get(tag)
    if same and any(opened[t] for t in same):
        up = here
        while up.parent is not None and up.tag not in same and up.tag not in ("ul", "ol", "dl", "table", "select"):
            up = up.parent
        while up.tag in same:
            up = up.parent
            if up.tag not in same or tag in ("li", "option"):
                return up
    return here


def _attributes(node: Node, raw: str) -> None:
    found = []
    for name, a, b, c, bare in _ATTR.findall(raw):
        name, value = (name or bare).lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            found += [t.lower() for t in _SPLIT.split(value) if t]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            node.hidden = True
    node.tokens = tuple({_TOKEN[t] for t in found if t in _TOKEN})


_N_OWN = len(TAGS) + 2 * len(TOKENS) + 9
N_FEATURES = _N_OWN + 21
_ABOVE = [_TAG[t] for t in "nav header footer aside form article main script".split()]


def features(root: Node) -> tuple[list[Node], np.ndarray, list[int]]:
    """Nodes in page order, their feature rows, and each one's parent's place."""
    nodes, place, parents = [], {}, []
    stack = [root]
    while stack:
        x = stack.pop()
        place[id(x)] = len(nodes)
        parents.append(place[id(x.parent)] if x.parent is not None else -1)
        nodes.append(x)
        stack += reversed(x.kids)
    n = len(nodes)
    f = np.zeros((n, N_FEATURES), np.float32)
    # subtree sums: chars, link chars, elements, p, li, inputs, links, stops, leaves
    s = np.zeros((n, 9))
    above = np.zeros((n, len(_ABOVE)), bool)
    tokens_above = np.zeros((n, len(TOKENS)), bool)
    in_link, depth = np.zeros(n, bool), np.zeros(n)
    for i, x in enumerate(nodes):
        p = parents[i]
        if p >= 0:
            above[i], tokens_above[i], in_link[i], depth[i] = above[p], tokens_above[p], in_link[p], depth[p] + 1
        k = _TAG.get(x.tag)
        if k is not None:
            f[i, k] = 1
            if k in _ABOVE:
                above[i, _ABOVE.index(k)] = True
        for t in x.tokens:
            f[i, len(TAGS) + t] = 1
            tokens_above[i, t] = True
        in_link[i] |= x.tag == "a"
        if x.tag == "#text":
            c = len(" ".join(x.text.split()))
            s[i, [0, 1, 7, 8]] = c, c * in_link[i], len(re.findall(r"[.,;:!?](?=\s|\Z)", x.text)), c > 0
        else:
            s[i, 2:7] = 1, x.tag == "p", x.tag == "li", x.tag in ("input", "select", "textarea", "button"), x.tag == "a"
    f[:, len(TAGS) + len(TOKENS) : len(TAGS) + 2 * len(TOKENS)] = tokens_above
    f[:, len(TAGS) + 2 * len(TOKENS) : _N_OWN - 1] = above
    f[:, _N_OWN - 1] = [x.hidden for x in nodes]
    for i in range(n - 1, 0, -1):
        s[parents[i]] += s[i]
    total = max(1.0, s[0, 0])
    up = np.maximum(parents, 0)
    count, rank, same = np.ones(n), np.zeros(n), np.zeros(n)
    for x in nodes:
        kinds: dict[str, int] = {}
        for k in x.kids:
            kinds[k.tag] = kinds.get(k.tag, 0) + 1
        for r, k in enumerate(x.kids):
            i = place[id(k)]
            count[i], rank[i], same[i] = len(x.kids), r, kinds[k.tag] / len(x.kids)
    chars = np.maximum(s[:, 0], 1)
    f[:, _N_OWN:] = np.stack([
        depth, np.log1p(s[:, 0]), s[:, 0] / total, s[:, 1] / chars, np.log1p(s[:, 0] / (1 + s[:, 2])), np.log1p(s[:, 2]), np.log1p(s[:, 3]), np.log1p(s[:, 4]), np.log1p(s[:, 5]), np.log1p(s[:, 6]), s[:, 7] / chars * 100,
        np.log1p(s[:, 0] / np.maximum(1, s[:, 8])), np.log1p(count), rank / count, same, np.log1p(s[up, 0]), s[up, 1] / np.maximum(s[up, 0], 1), s[:, 0] / np.maximum(s[up, 0], 1), s[:, 3] / (1 + s[:, 2]), s[:, 4] / (1 + s[:, 2]), in_link,
    ], axis=1)
    return nodes, f, parents


class Boosted:
    """Softmax gradient boosting with histogram trees of a fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int = 3, rounds: int = ROUNDS, depth: int = LEAF_DEPTH) -> Boosted:
        self.depth, self.classes = depth, classes
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)
        n, m = binned.shape
        flat = binned + np.arange(m) * BINS
        score = np.zeros((n, classes))
        self.trees = []
        for _ in range(rounds):
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for c in range(classes):
                g, h = (y == c) - p[:, c], p[:, c] * (1 - p[:, c])
                tree, leaf = self._tree(flat, binned, g, h, m)
                self.trees.append(tree)
                score[:, c] += tree[2][leaf]
        return self

    def _tree(self, flat, binned, g, h, m):
        depth, at = self.depth, np.zeros(len(g), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        for d in range(depth):
            size = m * BINS
            key = (at[:, None] * size + flat).ravel()
            sg, sh = (np.bincount(key, np.repeat(v, m), 2**d * size).reshape(2**d, m, BINS).cumsum(axis=2) for v in (g, h))
            tg, th = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
            gain[(sh < 1) | (th - sh < 1)] = 0
            best = gain.reshape(2**d, -1).argmax(axis=1)
            fine = gain.reshape(2**d, -1)[np.arange(2**d), best] > 1e-3
            i = 2**d - 1 + np.arange(2**d)
            feature[i], cut[i] = best // BINS, np.where(fine, best % BINS, BINS)
            at = at * 2 + (binned[np.arange(len(at)), feature[2**d - 1 + at]] > cut[2**d - 1 + at])
        value = RATE * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + 1)
        return (feature, cut, value), at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)
        score, rows = np.zeros((len(x), self.classes)), np.arange(len(x))
        for t, (feature, cut, value) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                i = 2**d - 1 + at
                at = at * 2 + (binned[rows, feature[i]] > cut[i])
            score[:, t % self.classes] += value[at]
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


KEEP, DROP, MIXED = 0, 1, 2


def decode(parents: list[int], logp: np.ndarray, is_leaf: np.ndarray) -> np.ndarray:
    """Best labels under the hierarchy, by sums from the leaves up and choices from
    the root down."""
    n = len(parents)
    keep, drop, mixed = logp[:, KEEP].copy(), logp[:, DROP].copy(), logp[:, MIXED].copy()
    mixed[is_leaf] = -np.inf
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] = max(keep[i], drop[i], mixed[i])
        p = parents[i]
        if p >= 0:
            keep[p] += keep[i]
            drop[p] += drop[i]
            mixed[p] += best[i]
    label = np.zeros(n, np.int64)
    for i in range(n):
        p = parents[i]
        label[i] = label[p] if p >= 0 and label[p] != MIXED else int(np.argmax((keep[i], drop[i], mixed[i])))
    return label


def extract(pages: list[str | None], trees: Boosted | None = None) -> list[str]:
    """Main text of every page; empty where there is none."""
    trees = trees or model()
    parsed = [features(parse(p or "")) for p in pages]
    logp = trees.log_probabilities(np.concatenate([f for _, f, _ in parsed])) if parsed else np.zeros((0, 3))
    out, at = [], 0
    for nodes, f, parents in parsed:
        rows = logp[at : at + len(nodes)]
        at += len(nodes)
        leaf = np.array([not x.kids for x in nodes])
        # elements without text say nothing
        silent = f[:, _N_OWN + 1] == 0
        rows = np.where(silent[:, None], 0.0, rows)
        label = decode(parents, rows, leaf)
        parts: list[str] = []
        _walk(nodes[0], {id(x): k for x, k in zip(nodes, label)}, parts)
        out.append(" ".join("".join(parts).split()))
    return out


def _walk(root: Node, label: dict[int, int], parts: list[str]) -> None:
    stack: list[Node | str] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag == "#text":
            if label[id(x)] == KEEP:
                parts.append(x.text)
        elif x.tag not in ("script", "style", "noscript", "template", "head"):
            edge = " " if x.tag not in INLINE else ""
            stack.append(edge)
            stack += reversed(x.kids)
            stack.append(edge)


_MARK = "\ue000"


def invented_page(rng: random.Random) -> str:
    """A page of a random layout; text chunks of the article start with a mark."""
    syllables = ["ta", "re", "on", "ing", "el", "mi", "sou", "ver", "da", "lo", "ki", "est", "an", "ur", "pe"]

    def words(k: int, stop: str = ".") -> str:
        out = []
        for _ in range(max(1, k)):
            w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
            out.append(w + rng.choice(["", "", "", "", ",", stop, "&amp;", "***"] if rng.random() < 0.5 else [""]))
        return " ".join(out).capitalize() + (stop if rng.random() < 0.8 else "")

    def named(plain: str, *names: str) -> tuple[str, str]:
        r = rng.random()
        if r < 0.45:
            return f"<{plain}>", plain
        tag = plain if r < 0.65 else rng.choice(["div", "div", "section"])
        return f'<{tag} {rng.choice(["class", "id", "class"])}="{rng.choice(names)}{rng.choice(["", " x1", "-wrap", " wide", "-2"])}">', tag

    def boxed(opening: tuple[str, str], body: str) -> str:
        return f"{opening[0]}{body}</{opening[1]}>"

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{words(1, "")}">{words(rng.randint(1, 4), "")}</a></{tag}>' for _ in range(k))

    def advert() -> str:
        names = ("ad", "advert", "ads", "sponsored", "promo", "banner-ad", "advertisement", "adbox")
        return f'<{(t := rng.choice(["div", "div", "aside", "section"]))} class="{rng.choice(names)}">{rng.choice(["", "<p>"])}{words(rng.randint(2, 25))}</{t}>'

    def form() -> str:
        return f'<form{rng.choice(["", " class=newsletter", " id=search"])}><label>{words(3)}</label><input name=q><select><option>{words(1)}<option>{words(1)}</select><textarea>{words(4)}</textarea><button>{words(1)}</button>{rng.choice(["", f"<p>{words(8)}</p>"])}</form>'

    def notice() -> str:
        return f'<{(t := rng.choice(["div", "div", "section", "aside"]))} class="{rng.choice(["cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "newsletter", "paywall", "announcement"])}">{rng.choice(["", "<p>"])}{words(rng.randint(5, 40))} <button>OK</button></{t}>'

    def related() -> str:
        return boxed(named("aside", "sidebar", "related", "widget", "rail", "trending", "recommended"), rng.choice(["", f"<h3>{words(2)}</h3>"]) + rng.choice([f"<ul>{links(rng.randint(2, 7))}</ul>", f"<p>{words(rng.randint(10, 60))}</p>", f"<p>{words(20)}</p><ul>{links(3)}</ul>"]))

    def share() -> str:
        return f'<div class="{rng.choice(["share", "social", "sharing-buttons"])}">{links(3, "span")}</div>'

    def comments() -> str:
        each = lambda: f'<{(t := rng.choice(["li", "div", "article"]))} class="{rng.choice(["comment", "reply", "comment-body"])}"><b>{words(1, "")}</b><p>{words(rng.randint(5, 60))}</p></{t}>'
        t = rng.choice(["section", "div", "ol"])
        return f'<{t} {rng.choice(["id", "class"])}="{rng.choice(["comments", "commentlist", "discussion", "disqus", "reader-comments", "respond"])}">{rng.choice(["", f"<h3>{words(2)}</h3>"])}{"".join(each() for _ in range(rng.randint(1, 6)))}</{t}>'

    def prose(k: int) -> str:
        text = words(k)
        if rng.random() < 0.35:
            text += rng.choice([f' <b>{_MARK}{words(3)}</b> {_MARK}{words(5)}', f' <a href="/x">{_MARK}{words(2)}</a>{_MARK}, {words(8)}', f"<br>{_MARK}{words(6)}", f" <em>{_MARK}{words(2)}", f" <code>{_MARK}{words(1)}</code>"])
        return _MARK + text

    def block() -> str:
        r, close = rng.random(), rng.random() < 0.75
        if r < 0.66:
            return f"<p>{rng.choice(['', '', '<b>'])}{prose(rng.choice([1, 2, 10, 30, 60, 120]))}{'</p>' if close else ''}"
        if r < 0.76:
            return f"<h2>{prose(rng.randint(1, 6))}</h2>"
        if r < 0.85:
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{prose(rng.randint(1, 20))}{'</li>' if close else ''}" for _ in range(rng.randint(2, 8))) + f"</{t}>"
        if r < 0.9:
            return f"<blockquote>{rng.choice(['', '<p>'])}{prose(25)}</blockquote>"
        if r < 0.94:
            return "<table>" + "".join(f"<tr><td>{prose(2)}</td><td>{prose(3)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if r < 0.97:
            return f'<figure><img src="a.png"><figcaption>{prose(8)}</figcaption></figure>'
        return rng.choice([f"<pre>{prose(10)}</pre>", f"<div>{prose(40)}</div>", f"<div><p>{prose(40)}</p></div>"])

    body = [block() for _ in range(rng.choice([1, 1, 2, 4, 8, 14]))]
    for extra in (advert, related, form, share, notice):
        if rng.random() < 0.15:
            body.insert(rng.randint(0, len(body)), extra())
    title = f"<h1>{_MARK}{words(rng.randint(1, 9))}</h1>" if rng.random() < 0.8 else ""
    main = rng.choice([named("article", "article", "post", "content", "story", "entry"), named("main", "main-content", "post-body", "article-text", "content"), ("<article>", "article"), ('<div class="content">', "div"), ('<td class="story">', "td")])
    article = boxed(main, title + "".join(body) + (comments() if rng.random() < 0.12 else ""))
    if main[1] == "td":
        article = f"<table><tr><td>{links(3, 'p')}</td>{article}</tr></table>"
    if rng.random() < 0.3:
        article = f"<main>{article}</main>" if main[1] != "main" else f'<div class="wrap">{article}</div>'
    chance = lambda p, f: f() if rng.random() < p else ""
    nav = lambda: boxed(named("nav", "menu", "navbar", "nav", "breadcrumb", "navigation"), f"<ul>{links(rng.randint(2, 9))}</ul>" if rng.random() < 0.8 else links(4, "span"))
    head = lambda: boxed(named("header", "header", "masthead", "site-header", "topbar", "branding"), rng.choice([f"<h1>{words(2)}</h1>", f"<a href=/>{words(2)}</a>", f"<p>{words(6)}</p>"]) + chance(0.4, nav))
    foot = lambda: boxed(named("footer", "footer", "site-footer", "colophon", "copyright"), rng.choice([f"&copy; {words(3)}", f"<p>&copy; {words(12)}</p><ul>{links(3)}</ul>", f"{words(30)}"]))
    before = [chance(0.5, head), chance(0.75, nav), chance(0.3, notice), chance(0.45, advert), chance(0.15, form)]
    after = [chance(0.3, related), chance(0.35, comments), chance(0.25, advert), chance(0.2, form), chance(0.15, notice), chance(0.1, share), chance(0.8, foot)]
    middle = before[2:]
    rng.shuffle(middle)
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(before[:2] + middle)}<!-- x -->{article}{''.join(after)}<script>track(1)</script></body></html>"


@functools.cache
def model() -> Boosted:
    """The trained trees; the same in every process."""
    rng, xs, ys = random.Random(20240131), [], []
    for _ in range(TRAINING_PAGES):
        root = parse(invented_page(rng))
        stack, truth = [root], {}
        order = []
        while stack:
            x = stack.pop()
            order.append(x)
            stack += x.kids
        for x in reversed(order):
            if x.tag == "#text":
                plain = bool(x.text.strip())
                truth[id(x)] = ({_MARK in x.text} if plain else set())
                x.text = x.text.replace(_MARK, "")
            else:
                truth[id(x)] = set().union(*(truth[id(k)] for k in x.kids)) if x.kids else set()
        nodes, f, _ = features(root)
        for x, row in zip(nodes, f):
            if t := truth[id(x)]:
                xs.append(row)
                ys.append(MIXED if len(t) == 2 else KEEP if True in t else DROP)
    return Boosted().fit(np.array(xs), np.array(ys))


def extract_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row per page.

    Character references are decoded, white space inside a block becomes one space,
    blocks join by one space in page order. Null or empty html, and pages without an
    article, give the empty text. Rows that repeat an id are extracted each. An empty
    table gives an empty result."""

    trees = model()  # trained once, sent along with the tasks: some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 100):
                part = b.slice(i, 100)
                texts = extract(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
