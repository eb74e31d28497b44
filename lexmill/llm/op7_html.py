"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

A page is read into its block elements. Each node gets features of its subtree (text, link and punctuation density,
blocks), its tag, the tokens of its class, id and role, its depth and siblings, and its ancestors. Boosted trees give
the chance that it holds article text. Decoding maximises the sum of log-chances over the tree under one rule: below
a dropped node everything is dropped. So no node can contradict its ancestors.

The trees are trained here, on pages that synthetic_page() makes from many layouts (seeded, TRAIN_PAGES of them).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import table

TRAIN_PAGES = 600
ROUNDS = 110
DEPTH = 5
RATE = 0.25
BINS = 24
SEED = 7

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_ATTRS = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。，]")

#: Contents that are never text of the page; contents that are text up to the end tag, whatever is in them.
DROPPED = frozenset("script style".split())
RAW = frozenset("textarea title iframe noembed xmp".split())
#: Elements that a head may hold; any other one ends it. Elements that hold no blocks; a block ends them.
IN_HEAD = frozenset("title meta link base script style noscript template".split())
INLINE = frozenset("button select option optgroup datalist".split())
MEDIA = frozenset("svg canvas object video audio template noscript".split())
BLOCK = frozenset(
    "html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main aside nav header "
    "footer form fieldset legend blockquote pre figure figcaption details summary address hr menu dialog center ins hgroup search".split()
)
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TAG_GROUPS = (
    frozenset({"article", "main"}), frozenset({"section", "div", "center", "body", "html"}), frozenset({"p", "blockquote", "pre"}),
    frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}), frozenset({"ul", "ol", "li", "dl", "dt", "dd"}),
    frozenset({"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"nav", "menu"}), frozenset({"aside"}), frozenset({"header"}),
    frozenset({"footer"}), frozenset({"form", "fieldset", "legend", "search"}), frozenset({"figure", "figcaption"}), frozenset({"#text"}), frozenset({"dialog", "ins", "address", "details", "summary"}),
    frozenset({"head", "title"}), INLINE | {"textarea"}, MEDIA | {"iframe", "noembed"},
)
#: Attribute tokens by what they tell.
TOKEN_GROUPS = (
    frozenset("article content main post entry body story text articlebody maincontent blog page prose copy".split()),
    frozenset("nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager topnav menubar tabs skip".split()),
    frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted adsbygoogle adslot dfp banner commercial affiliate".split()),
    frozenset("sidebar side aside rail widget widgets secondary complementary".split()),
    frozenset("footer foot bottom copyright colophon contentinfo legal disclaimer imprint".split()),
    frozenset("header head masthead top topbar logo branding site tagline".split()),
    frozenset("cookie cookies consent notice notices alert alerts warning gdpr popup modal overlay paywall privacy message toast announcement dialog".split()),
    frozenset("comment comments commentlist reply replies respond discussion disqus thread reader feedback review reviews".split()),
    frozenset("form login signup signin register subscribe subscription newsletter search contact field email".split()),
    frozenset("share sharing social related recommended recommendations more trending popular tags tag meta byline links follow outbrain taboola teaser".split()),
    frozenset("hidden noprint sr screen invisible print".split()),
)
_WHICH = {w: i for i, g in enumerate(TOKEN_GROUPS) for w in g}
#: Bins that attribute tokens are hashed into, besides.
TOKEN_BINS = 40
_MARK = "\ue000"


@lru_cache(maxsize=20_000)
def _attr_tokens(attrs: str) -> tuple[int, int]:
    """Bits of the token groups that a tag's attributes touch, and of the bins of all their tokens."""
    bits = bins = 0
    for m in _ATTRS.finditer(attrs):
        value = _CAMEL.sub(r"\1 \2", m.group(1) or m.group(2) or m.group(3) or "").lower()
        for w in re.split(r"[^a-z]+", value):
            if w:
                bins |= 1 << xxhash.xxh32_intdigest(w) % TOKEN_BINS
            k = _WHICH.get(w)
            if k is not None:
                bits |= 1 << k
    if re.search(r"(?i)\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attrs):
        bits |= 1 << (len(TOKEN_GROUPS) - 1)
    return bits, bins


_TAG_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}


class Page:
    """Block nodes of a page in page order: parent, tag, attribute groups and bins, own text, link characters.

    Only the contents of scripts and styles are left out. An element that is never closed ends with its parent; a head
    ends at the first tag or text that cannot stand in one.
    """

    __slots__ = ("bins", "bits", "links", "parent", "tag", "text")

    def __init__(self, source: str):
        self.parent, self.tag, self.bits, self.bins, self.text, self.links = [-1], ["html"], [0], [0], [""], [0]
        stack, pieces, state = [0], [], [0, 0]  # state: link depth, link characters of the run
        opened: dict[str, int] = {}  # how often a tag is on the stack
        at, n = 0, len(source)

        def flush() -> None:
            raw = "".join(pieces)
            if raw and not raw.isspace():
                self._add(stack[-1], "#text", (0, 0))
                self.text[-1] = " ".join(html.unescape(raw).split())
                self.links[-1] = state[1]
            pieces.clear()
            state[1] = 0

        def cut(k: int) -> None:
            for i in stack[k:]:
                opened[self.tag[i]] -= 1
            del stack[k:]

        def leave(tag: str) -> None:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        cut(k)
                        return

        def enter(tag: str, attrs: str) -> None:
            self._add(stack[-1], tag, _attr_tokens(attrs))
            stack.append(len(self.tag) - 1)
            opened[tag] = opened.get(tag, 0) + 1

        def text(t: str) -> None:
            if t:
                if opened.get("head") and self.tag[stack[-1]] == "head" and not t.isspace():
                    flush()
                    leave("head")
                pieces.append(t)
                if state[0]:
                    state[1] += len(t.strip())

        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            tag = (m.group(2) or m.group(5) or "").lower()
            if not tag:
                continue
            closing, attrs = (m.group(1) or m.group(4)) == "/", m.group(3) or m.group(6) or ""
            if opened.get("head") and not closing and tag not in IN_HEAD:
                flush()
                leave("head")
            if (tag in DROPPED or tag in RAW) and not closing:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                if tag in DROPPED:
                    at = end.end() if end else n
                else:
                    flush()
                    enter(tag, attrs)
                    if end:  # without an end tag, what follows is read as usual, below no node of this kind
                        raw = source[at : end.start()]
                        pieces.append(raw if tag == "xmp" or "<" not in raw else _TOKEN.sub(" ", raw))
                        at = end.end()
                        flush()
                    leave(tag)
            elif tag in ("br", "hr", "wbr"):
                if tag != "wbr":
                    text(" ")
                if tag == "hr":
                    flush()
            elif tag == "a":
                state[0] = 0 if closing else 1
            elif tag in INLINE or tag in MEDIA:
                flush()
                if closing:
                    leave(tag)
                elif not attrs.endswith("/"):
                    if tag in INLINE and self.tag[stack[-1]] == tag:
                        leave(tag)
                    enter(tag, attrs)
            elif tag in BLOCK:
                flush()
                if tag in ("html", "body"):
                    if not closing:
                        bits, bins = _attr_tokens(attrs)
                        self.bits[0] |= bits
                        self.bins[0] |= bins
                    continue
                if closing:
                    leave(tag)
                    continue
                state[0] = 0
                while self.tag[stack[-1]] in INLINE:
                    cut(len(stack) - 1)
                if self.tag[stack[-1]] == "p":
                    cut(len(stack) - 1)
                if tag in CLOSES:
                    same, until = CLOSES[tag]
                    if any(opened.get(t) for t in same):
                        for k in range(len(stack) - 1, 0, -1):
                            t = self.tag[stack[k]]
                            if t in until:
                                break
                            if t in same:
                                cut(k)
                                break
                enter(tag, attrs)
        flush()

    def _add(self, parent: int, tag: str, tokens: tuple[int, int]) -> None:
        self.parent.append(parent)
        self.tag.append(tag)
        self.bits.append(tokens[0])
        self.bins.append(tokens[1])
        self.text.append("")
        self.links.append(0)


N_FEATURES = 18 + len(TAG_GROUPS) + 2 * len(TOKEN_GROUPS) + len(TAG_GROUPS) + TOKEN_BINS


def features(page: Page) -> np.ndarray:
    """(nodes, N_FEATURES) of a page."""
    n = len(page.tag)
    chars, links, words, punct, blocks, paras, first = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    kids, index, depth, marks = [0] * n, [0] * n, [0] * n, [0.0] * n
    upbits, uptags = [0] * n, [0] * n
    seen = 0.0
    for i in range(n):
        t, p = page.text[i], page.parent[i]
        first[i] = seen
        if p >= 0:
            index[i] = kids[p]
            kids[p] += 1
            depth[i] = depth[p] + 1
            upbits[i] = upbits[p] | page.bits[p]
            uptags[i] = uptags[p] | (1 << _TAG_GROUP.get(page.tag[p], 13))
        if t:
            chars[i] = len(t)
            links[i] = min(page.links[i], len(t))
            words[i] = t.count(" ") + 1
            punct[i] = len(_PUNCT.findall(t))
            blocks[i] = 1
            paras[i] = page.tag[p] == "p" if p >= 0 else 0
            marks[i] = "©" in t
            seen += len(t)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        words[p] += words[i]
        punct[p] += punct[i]
        blocks[p] += blocks[i]
        paras[p] += paras[i]
        marks[p] += marks[i]
    par = np.maximum(np.array(page.parent), 0)
    c, li, w, pu, bl, pa_, fi = (np.array(x) for x in (chars, links, words, punct, blocks, paras, first))
    kid, ind, dep, mk = np.array(kids), np.array(index), np.array(depth), np.array(marks)
    total = max(c[0], 1.0)
    out = np.zeros((n, N_FEATURES), np.float32)
    cols = (
        np.log1p(c), li / np.maximum(c, 1), c / total, c / np.maximum(c[par], 1), dep, ind / np.maximum(kid[par], 1), np.log1p(kid[par]), np.log1p(kid), c / np.maximum(bl, 1),
        pu / np.maximum(w, 1), np.log1p(pa_), pa_ / np.maximum(bl, 1), np.log1p(bl), fi / total, (fi + c) / total, c / np.maximum(w, 1), mk > 0, np.log1p(pa_[par]),
    )
    for j, x in enumerate(cols):
        out[:, j] = x
    at = len(cols)
    out[np.arange(n), at + np.array([_TAG_GROUP.get(t, 13) for t in page.tag])] = 1
    at += len(TAG_GROUPS)
    bits, up, ut = np.array(page.bits), np.array(upbits), np.array(uptags)
    out[:, at : at + len(TOKEN_GROUPS)] = (bits[:, None] >> np.arange(len(TOKEN_GROUPS))) & 1
    at += len(TOKEN_GROUPS)
    out[:, at : at + len(TOKEN_GROUPS)] = (up[:, None] >> np.arange(len(TOKEN_GROUPS))) & 1
    at += len(TOKEN_GROUPS)
    out[:, at : at + len(TAG_GROUPS)] = (ut[:, None] >> np.arange(len(TAG_GROUPS))) & 1
    at += len(TAG_GROUPS)
    out[:, at:] = (np.array(page.bins, np.int64)[:, None] >> np.arange(TOKEN_BINS)) & 1
    return out


class Trees:
    """Boosted regression trees for the logistic loss, on histograms; complete trees of DEPTH levels."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(n, self.base)
        rng = np.random.default_rng(SEED)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            some, cols = rng.permutation(n)[: n // 2], np.sort(rng.permutation(m)[: (m + 1) // 2])  # each round sees half of the rows and features
            w = len(cols)
            code = (binned[np.ix_(some, cols)] + np.arange(w) * BINS).ravel()
            gr, hr = np.repeat(g[some], w), np.repeat(h[some], w)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                k = 1 << level
                flat = np.repeat(node[some] * w * BINS, w) + code
                gs, hs = (np.bincount(flat, v, k * w * BINS).reshape(k, w, BINS) for v in (gr, hr))
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 2) | (ht - hl < 2)] = -1
                best = gain.reshape(k, -1).argmax(1)
                for v in range(k):
                    f, b = divmod(int(best[v]), BINS)
                    if gain[v, f, b] > 1e-6 and b < len(self.edges[cols[f]]):
                        feature[k - 1 + v], cut[k - 1 + v] = cols[f], self.edges[cols[f]][b]
                node = 2 * node + (x[np.arange(n), feature[k - 1 + node]] > cut[k - 1 + node])
            top = np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + 1)
            self.trees.append((feature, cut.astype(np.float64), self.rate * top))
            z += self.rate * top[node]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def decode(parent: list[int], logit: np.ndarray) -> list[bool]:
    """Which nodes to keep: most likely labels such that all below a dropped node are dropped."""
    z = np.clip(logit, -12, 12)
    yes, no = (-np.logaddexp(0, -z)).tolist(), (-np.logaddexp(0, z)).tolist()
    n = len(parent)
    keep, drop = yes[:], no[:]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [keep[0] > drop[0]]
    for i in range(1, n):
        out.append(out[parent[i]] and keep[i] > drop[i])
    return out


def synthetic_page(rng: np.random.Generator) -> str:
    """A page of a random layout; article text is marked with a private-use character in each block."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = pick(("er", "in", "th", "an", "re", "on", "st"), ("le", "ou", "é", "ai", "que", "ment"), ("ung", "sch", "ein", "ä", "ver"), ("ción", "os", "ñ", "ar", "do"))

    def words(lo: int, hi: int) -> str:
        ws = ["".join(pick(*syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(lo, hi)))]
        out = []
        for w in ws:
            out.append(w + (pick(",", ".", ".", "!", ":") if chance(0.14) else ""))
        return style(" ".join(out).capitalize() + pick(".", "", "."))

    odd = pick(" ", " ", " ", " | ", "%%% ", "### ", "!! ", "&amp;&amp; ")  # articles of odd style are articles as well
    style = lambda t: t.replace(" ", odd)
    noise = "".join(pick(*"abcdefghkmqrz") for _ in range(6))
    cls = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick("", noise + " ", "js-")}{pick(*names)}{pick("", "-" + noise, "__wrap", " clearfix")}"')
    prose = lambda: words(5, pick(12, 60, 120))
    link = lambda: f'<a href="/{noise}">{words(1, 4)}</a>'
    lst = lambda k: "<ul>" + "".join(f"<li>{link()}{pick('</li>', '</li>', '')}" for _ in range(k)) + "</ul>"

    def comments() -> str:
        items = "".join(f"<{t}>{'<p>' + link() + '</p>' if chance(0.5) else ''}<p>{prose()}</p></{t}>" for t in [pick("li", "div")] for _ in range(int(rng.integers(1, 6))))
        return f"<{(t := pick('div', 'section', 'ol'))}{cls('comments', 'commentlist', 'reader-comments', 'discussion', 'replies', 'comment-thread')}>{'<h3>' + words(1, 3) + '</h3>' if chance(0.5) else ''}{items}</{t}>"

    def boiler(kind: str) -> str:
        if kind == "nav":
            return pick(f"<nav{pick('', cls('nav', 'menu'))}>{lst(int(rng.integers(3, 9)))}</nav>", f"<div{cls('menu', 'nav', 'navbar', 'topnav', 'breadcrumbs', 'navigation')}>{pick(lst(5), ' | '.join(link() for _ in range(5)))}</div>", f"<ul{cls('menu', 'nav')}>{''.join(f'<li>{link()}</li>' for _ in range(5))}</ul>")
        if kind == "ad":
            return f"<{(t := pick('div', 'div', 'aside', 'section', 'p', 'ins'))}{cls('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'ad-slot', 'adsbygoogle')}>{pick('', '<p>', '<b>')}{pick(words(3, 10), prose())}{link() if chance(0.3) else ''}</{t}>"
        if kind == "side":
            inner = pick(lst(4), f"<p>{prose()}</p>", f"<h3>{words(1, 4)}</h3>{lst(4)}<p>{prose()}</p>")
            return pick(f"<aside{pick('', cls('sidebar', 'related', 'widget'))}>{inner}</aside>", f"<div{cls('sidebar', 'side', 'widget', 'rail', 'secondary')}>{inner}</div>")
        if kind == "notice":
            return f"<{(t := pick('div', 'div', 'section', 'p', 'dialog'))}{cls('cookie-notice', 'cookie', 'consent', 'notice', 'alert', 'paywall', 'gdpr', 'popup', 'warning', 'announcement')}>{pick('', '<p>') if t != 'p' else ''}{pick(words(4, 12), prose())}{'<button>' + words(1, 2) + '</button>' if chance(0.5) else ''}</{t}>"
        if kind == "form" and chance(0.3):
            return pick(f"<svg><title>{words(1, 3)}</title><text>{words(1, 3)}</text></svg>", f"<select>{''.join(f'<option>{words(1, 2)}' for _ in range(6))}</select>", f"<iframe src=x>{words(2, 8)}</iframe>", f"<video controls>{words(3, 8)}</video>", f"<form><textarea>{words(1, 9)}</textarea><button>{words(1, 2)}</button></form>", f"<div><button>{words(1, 3)}</button></div>", f"<template>{prose()}</template>")
        if kind == "form":
            return f"<form{pick('', cls('newsletter', 'search', 'login', 'subscribe', 'contact-form'))}>{'<p>' + prose() + '</p>' if chance(0.5) else ''}<label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button></form>"
        if kind == "social":
            return f"<div{cls('share', 'social', 'related', 'tags', 'recommended', 'follow', 'trending')}>{pick(lst(4), words(2, 8), f'<h3>{words(1, 3)}</h3>{lst(3)}')}</div>"
        if kind == "comments":
            return comments()
        if kind == "header":
            return pick(f"<header{pick('', cls('header', 'masthead'))}>{pick('<h1>', '<div>', '<p>')}{words(1, 6)}{pick('', boiler('nav'))}</header>", f"<div{cls('header', 'masthead', 'topbar', 'site-header')}>{words(1, 8)}{pick('', lst(3))}</div>")
        return pick(f"<footer{pick('', cls('footer'))}>{pick('&copy; ', '', '<p>')}{pick(words(3, 12), prose())}{lst(3) if chance(0.3) else ''}</footer>", f"<div{cls('footer', 'copyright', 'bottom', 'site-footer')}>&copy; {words(2, 12)}</div>")

    inner_kinds = ("ad", "social", "form", "notice", "side", "comments", "nav", "footer", "header")

    def article() -> str:
        parts = [f"<h1>{_MARK}{words(2, 9)}</h1>"] if chance(0.75) else []
        for _ in range(int(rng.integers(1, pick(3, 8, 16)))):
            r = rng.random()
            if r < 0.04:
                odd_piece = pick(f"<button>{words(1, 3)}</button>", f"<math><mi>{words(1, 2)}</mi></math>", f"<noscript>{words(2, 6)}</noscript>", f"<object>{words(2, 6)}</object>")
                parts.append(f"<p>{_MARK}{prose()} {odd_piece.replace('>', '>' + _MARK, 1)} {_MARK}{prose()}</p>")
            elif r < 0.06:
                parts.append(f"<xmp>{_MARK}{prose()}</xmp>")
            elif r < 0.72:
                parts.append(f"<p>{_MARK}{pick('', '<b>', '<em>')}{pick(words(1, 5), prose(), prose(), prose())}{pick('', '', '<br>', link() + ' ' + words(1, 5))}{pick('</p>', '</p>', '')}")
            elif r < 0.79:
                parts.append(f"<h2>{_MARK}{words(1, 6)}</h2>")
            elif r < 0.85:
                parts.append(f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{_MARK}{words(2, 20)}</li>" for _ in range(int(rng.integers(1, 5)))) + f"</{t}>")
            elif r < 0.9:
                parts.append(f"<{(t := pick('blockquote', 'pre', 'figcaption'))}>{_MARK}{prose()}</{t}>")
            elif r < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{_MARK}{words(1, 5)}</td><td>{_MARK}{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<div>{_MARK}{prose()}</div>")
            if chance(0.1):
                parts.append(boiler(pick(*inner_kinds)))
        if chance(0.2):
            parts.append(boiler(pick("comments", "social", "footer", "form")))
        body = "".join(parts)
        if chance(0.08):
            body = "".join(f"{_MARK}{prose()}<br><br>" for _ in range(int(rng.integers(1, 6))))
        if chance(0.3):
            body = f"<div{cls('content', 'entry', 'post-body', 'article-body', 'text', noise)}>{body}</div>"
        shell = pick("article", "article", "article", "main", "div", "div", "section", "td")
        names = ("content", "main", "post", "article", "story", "entry-content", "main-content", noise, noise + "2")
        attrs = pick("", cls(*names)) if shell in ("article", "main") else cls(*names)
        out = f"<{shell}{attrs}>{body}</{shell}>"
        return f"<table><tr><td>{lst(4)}</td>{out}</tr></table>" if shell == "td" else out

    before = [boiler(k) for k in ("notice", "header", "nav", "ad", "form", "side", "social") if chance(0.4)]
    after = [boiler(k) for k in ("side", "social", "ad", "comments", "form", "footer", "notice", "nav") if chance(0.4)]
    if chance(0.3):
        rng.shuffle(before)
    main = article()
    if chance(0.35):
        main = f"<{(t := pick('div', 'main', 'section'))}{pick('', cls('container', 'wrapper', 'page', 'main', noise))}>{main}{after.pop() if after and chance(0.5) else ''}</{t}>"
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body{pick("", cls("home", "single-post", noise))}>' + "".join(before) + main + "".join(after) + pick("</body></html>", "</body></html>", "")
    return page


@lru_cache(maxsize=1)
def trained() -> Trees:
    """Trees fitted to TRAIN_PAGES synthetic pages; the same in every process."""
    rng = np.random.default_rng(SEED)
    xs, ys = [], []
    for _ in range(TRAIN_PAGES):
        page = Page(synthetic_page(rng))
        marks = [t.count(_MARK) for t in page.text]
        page.text = [t.replace(_MARK, "") for t in page.text]
        for i in range(len(marks) - 1, 0, -1):
            marks[page.parent[i]] += marks[i]
        xs.append(features(page))
        ys.append(np.array(marks) > 0)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    x = [features(p) for p in pages]
    z = np.split(trees.logit(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])
    return [" ".join(t for t, k in zip(p.text, decode(p.parent, own)) if k and t) for p, own in zip(pages, z)]


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text (string) and n_chars (long) in place of html_col; columns of these names are replaced.

    A null or empty page, and one without article text, has an empty text. White space is what str.split() takes for
    it. An empty table gives an empty table.
    """
    pages = pages.drop("text", "n_chars")
    trees = trained()
    rest = [f for f in pages.schema.fields if f.name != html_col]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 200):
                b = big.slice(at, 200)
                texts = extract(b.column(html_col).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, T.StructType(rest + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op7_html_extraction": query}
SQL: dict[str, str] = {}
