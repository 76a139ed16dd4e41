"""Operator 3, HTML extraction by a tree-structured graphical model.

Block elements of a page are the nodes of a tree; each is content or not. A node's potential is log-linear in
its features (tag, words of class and id, own text, links, place), and each parent-child pair has potentials
that depend on the child's kind. Sum-product messages go upward and downward once, which on a tree gives exact
marginals; the text of nodes whose content marginal is over one half, in page order, is the main text. The
weights are learned here from labelled pages by gradient ascent on the likelihood (expected features come from
the same messages); `labelled_pages` writes such pages with known labels, in families of unlike layouts.

Outside the model, by rule: elements that a reader never sees or only handles (RAW and SKIPPED: scripts, styles,
templates, options, buttons, players) hold no text; unclosed and stray tags are repaired as browsers do, each in
time that does not grow with the page; a head ends at the first element or text that can't be in one.

Defined cases: null or empty html, and pages without content, give the empty string; a page without any block
element is one block of text, its own main text. Repeated rows are rows of their own; an empty table stays empty.
"""

from __future__ import annotations

import bisect
import functools
import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import blocks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|iframe|svg|select|title|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed values of the HTML standard.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("button option datalist object canvas audio video head".split())
HEAD = set("base link meta noscript script style template title".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th pre blockquote figure figcaption nav header footer aside form address noscript body html br hr".split()
#: Words in class, id and role by what they say; a word counts where it begins or ends a part of the name.
WORDS = {
    "advert": "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion dfp adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pager pagination",
    "side": "sidebar side aside rail widget related recommended recommendations trending popular more teaser links",
    "foot": "footer foot copyright legal colophon imprint bottom",
    "head": "header head masthead logo top branding",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup paywall message warning disclaimer",
    "comment": "comment comments reply replies discussion respond disqus feedback reader responses",
    "share": "share sharing social follow tweet facebook tools buttons",
    "form": "form search login register contact field",
    "meta": "meta byline author date time tags tag category categories info published",
    "content": "content article post entry story body text main maintext articlebody prose page hentry single",
}
_KIND = {w: k for k, words in WORDS.items() for w in words.split()}
LENGTHS, SHARES = (0, 1, 25, 80, 250, 1000), (0.0, 0.2, 0.5, 0.8)
EDGE_KINDS = ("plain", "heading", "bound", "main")
NAMES = [f"tag:{t}" for t in [*TAGS, "other"]] + [f"name:{k}" for k in WORDS] + [f"own:{x}" for x in LENGTHS] + [f"all:{x}" for x in LENGTHS] + [f"linked:{x}" for x in SHARES] + [f"all_linked:{x}" for x in SHARES] + ["bias", "sentence", "commas", "early", "late", "in_article", "copyright", "in_comment", "in_bound"]
_AT = {name: i for i, name in enumerate(NAMES)}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kinds", "parent", "depth", "runs", "own", "linked", "order")

    def __init__(self, tag: str, kinds: tuple[str, ...], parent: int, depth: int, order: int):
        self.tag, self.kinds, self.parent, self.depth, self.order = tag, kinds, parent, depth, order
        self.runs: list[tuple[int, str]] = []  # (place in the page, text of one block)
        self.own = self.linked = 0


@functools.lru_cache(10_000)
def kinds_of(attrs: str) -> tuple[str, ...]:
    found = []
    for m in _ATTR.finditer(attrs):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "")
        for word in re.split(r"[\W_\d]+", value.lower()):
            if word in _KIND and _KIND[word] not in found:
                found.append(_KIND[word])
    return tuple(found)


class Parser:
    """Block elements of a page as nodes, parents first, with their runs of text, white space collapsed.

    Open elements lie on a stack; `at` has the places of each tag's and `blocks` those of block elements, so that
    no tag makes it look through the stack. An inline element that ends below others is left as a dead place.
    """

    def __init__(self):
        self.nodes = [Node("html", (), -1, 0, 0)]
        self.stack: list[str | None] = ["html"]  # None: dead
        self.node_at, self.blocks, self.at = [0], [0], {}
        self.bits: list[tuple[str, bool]] = []
        self.links = self.skipped = self.place = 0

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, -1 without one."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def flush(self) -> None:
        if not self.bits:
            return
        text = _SPACE.sub(" ", "".join(x for x, _ in self.bits)).strip()
        if text:
            node = self.nodes[self.node_at[-1]]
            node.runs.append((self.place, text))
            node.own += len(text)
            node.linked += min(len(text), sum(len(x.strip()) for x, linked in self.bits if linked))
            self.place += 1
        self.bits.clear()

    def left(self, tag: str) -> None:
        self.at[tag].pop()
        self.links -= tag == "a"
        self.skipped -= tag in SKIPPED

    def close_to(self, i: int) -> None:
        """Ends the element at place i and all inside it."""
        self.flush()
        while len(self.stack) > i:
            tag = self.stack.pop()
            self.node_at.pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            if tag is not None:
                self.left(tag)

    def end(self, tag: str) -> None:
        i = self.last(tag)
        if i < 0:
            if tag in ("p", "br"):
                self.flush()
        elif tag not in INLINE:
            self.close_to(i)
        elif i > self.blocks[-1] or tag == "a":  # a link around blocks ends here too
            self.left(tag)
            self.stack[i] = None
            while self.stack[-1] is None:
                self.stack.pop()
                self.node_at.pop()

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(tag)
        self.node_at.append(node)

    def start(self, tag: str, attrs: str) -> None:
        if (head := self.last("head")) >= 0 and tag not in HEAD:
            self.close_to(head)
        if tag in ("br", "hr"):
            self.flush()
        elif tag in VOID or attrs.endswith("/") and tag in INLINE or tag == "html":
            return
        elif tag in INLINE:
            self.links += tag == "a"
            self.push(tag, self.node_at[-1])
        else:
            self.flush()
            if tag in CLOSES_P and self.blocks[-1] and self.stack[self.blocks[-1]] == "p":
                self.close_to(self.blocks[-1])
            if tag in CLOSED_BY:
                scope = max(map(self.last, SCOPE[tag]))
                ends = [self.at[t] for t in CLOSED_BY[tag] if self.last(t) > scope]
                if ends and tag in ("tr", "thead", "tbody", "tfoot"):  # all that are open in the table
                    self.close_to(min(x[bisect.bisect_right(x, scope)] for x in ends))
                elif ends:
                    self.close_to(max(x[-1] for x in ends))
            self.skipped += tag in SKIPPED
            parent = self.node_at[-1]
            self.nodes.append(Node(tag, kinds_of(attrs) if attrs else (), parent, self.nodes[parent].depth + 1, self.place))
            self.blocks.append(len(self.stack))
            self.push(tag, len(self.nodes) - 1)

    def text(self, text: str) -> None:
        if self.skipped and (head := self.last("head")) >= 0 and self.stack[-1] == "head" and text.strip():
            self.close_to(head)
        if not self.skipped:
            self.bits.append((html_lib.unescape(text) if "&" in text else text, self.links > 0))


def parse(page: str | None) -> list[Node]:
    """The page's block elements, parents first; each has its runs of text, white space collapsed."""
    own = Parser()
    for m in _TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            own.text(text)
        elif m["tag"] is not None:
            tag = m["tag"].lower()
            own.end(tag) if m["end"] else own.start(tag, m["attrs"])
    own.flush()
    return own.nodes


def bucket(x: float, steps: tuple) -> int:
    for i in range(len(steps) - 1, -1, -1):
        if x >= steps[i]:
            return i
    return 0


_BOUND_TAGS, _BOUND_KINDS = {"nav", "header", "footer", "aside", "form"}, {"advert", "menu", "side", "foot", "notice", "comment", "share", "form"}


def described(nodes: list[Node]) -> tuple[list[list[int]], list[int]]:
    """Feature numbers and the edge kind of each node."""
    n = len(nodes)
    all_, all_linked = [x.own for x in nodes], [x.linked for x in nodes]
    for i in range(n - 1, 0, -1):
        all_[nodes[i].parent] += all_[i]
        all_linked[nodes[i].parent] += all_linked[i]
    total = max(1, nodes[-1].order)
    inside, comment, bound = [False] * n, [False] * n, [False] * n
    features, edges = [], []
    for i, x in enumerate(nodes):
        is_bound = x.tag in _BOUND_TAGS or bool(_BOUND_KINDS.intersection(x.kinds))
        if i:
            inside[i] = inside[x.parent] or nodes[x.parent].tag in ("article", "main")
            comment[i] = comment[x.parent] or "comment" in nodes[x.parent].kinds
            above = nodes[x.parent]
            bound[i] = bound[x.parent] or above.tag in _BOUND_TAGS or bool(_BOUND_KINDS.intersection(above.kinds))
        own = [_AT.get(f"tag:{x.tag}", _AT["tag:other"]), _AT["bias"]]
        own += [_AT[f"name:{k}"] for k in x.kinds]
        own += [_AT[f"own:{LENGTHS[bucket(x.own, LENGTHS)]}"], _AT[f"all:{LENGTHS[bucket(all_[i], LENGTHS)]}"]]
        if x.own:
            own.append(_AT[f"linked:{SHARES[bucket(x.linked / x.own, SHARES)]}"])
            text = x.runs[-1][1]
            if text[-1] in ".!?…":
                own.append(_AT["sentence"])
            if "," in text:
                own.append(_AT["commas"])
            if "©" in text or "copyright" in text.lower():
                own.append(_AT["copyright"])
        if all_[i]:
            own.append(_AT[f"all_linked:{SHARES[bucket(all_linked[i] / all_[i], SHARES)]}"])
        if x.order < 0.08 * total:
            own.append(_AT["early"])
        if x.order > 0.95 * total:
            own.append(_AT["late"])
        own += [_AT[name] for name, holds in (("in_article", inside[i]), ("in_comment", comment[i]), ("in_bound", bound[i])) if holds]
        features.append(own)
        edges.append(2 if is_bound else 1 if x.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 3 if x.tag in ("article", "main") else 0)
    return features, edges


class Forest:
    """Trees of several pages as arrays; messages go level by level."""

    def __init__(self, pages: list[list[Node]]):
        self.first = np.cumsum([0, *map(len, pages)])
        self.parent = np.array([x.parent + at if x.parent >= 0 else -1 for nodes, at in zip(pages, self.first, strict=False) for x in nodes], np.int64)
        depth = np.array([x.depth for nodes in pages for x in nodes], np.int64)
        told = [described(nodes) for nodes in pages]
        rows = [f for fs, _ in told for f in fs]
        self.edge = np.array([e for _, es in told for e in es], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        self.col = np.array([i for x in rows for i in x], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node and P(parent, child) of each edge, by sum-product upward and downward.

        unary: log odds of content by weight of the features; pair[kind, parent, child]: log potentials.
        """
        n = len(self.parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(self.row, unary[self.col], n)
        gathered, up = local.copy(), np.zeros((n, 2))
        table = pair[self.edge]
        for level in self.levels[:0:-1]:  # children before parents
            up[level] = np.logaddexp(table[level, :, 0] + gathered[level, 0, None], table[level, :, 1] + gathered[level, 1, None])
            np.add.at(gathered, self.parent[level], up[level])
        belief = gathered.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:  # parents before children
            rest = belief[self.parent[level]] - up[level]
            both = rest[:, :, None] + table[level] + gathered[level][:, None, :]
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
            both -= both.max((1, 2), keepdims=True)
            e = np.exp(both)
            joint[level] = e / e.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


class Model:
    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page."""
        trees = [parse(x) for x in pages]
        forest = Forest(trees)
        content = forest.marginals(self.unary, self.pair)[0] > 0.5
        out = []
        for nodes, at in zip(trees, forest.first, strict=False):
            runs = sorted(run for i, x in enumerate(nodes) if x.runs and (content[at + i] or len(nodes) == 1) for run in x.runs)
            out.append(" ".join(text for _, text in runs))
        return out


def train(pages: list[tuple[str, set[str]]], steps: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Weights from labelled pages: (html, texts of the blocks that are content)."""
    trees = [parse(page) for page, _ in pages]
    forest = Forest(trees)
    n = len(forest.parent)
    label = np.zeros(n, np.int64)
    for nodes, at, (_, good) in zip(trees, forest.first, pages, strict=False):
        held = [int(any(text in good for _, text in x.runs)) for x in nodes]
        bad = [int(any(text not in good for _, text in x.runs)) for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):  # a node without own text is content if all text below it is
            held[nodes[i].parent] += held[i]
            bad[nodes[i].parent] += bad[i]
        label[at : at + len(nodes)] = [int(h > 0 and (not b or x.own > 0 and all(t in good for _, t in x.runs))) for h, b, x in zip(held, bad, nodes, strict=True)]
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(EDGE_KINDS), 2, 2))
    np.add.at(seen, (forest.edge[child], label[forest.parent[child]], label[child]), 1)
    wanted = np.bincount(forest.col, label[forest.row], len(NAMES))
    unary, pair = np.zeros(len(NAMES)), np.zeros((len(EDGE_KINDS), 2, 2))
    size, pair_size = np.full(len(NAMES), 1e-6), np.full(pair.shape, 1e-6)
    for _ in range(steps):
        p, joint = forest.marginals(unary, pair)
        slope = (wanted - np.bincount(forest.col, p[forest.row], len(NAMES))) / len(pages) - decay * unary
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.edge[child], joint[child])
        pair_slope = (seen - expected) / len(pages) - decay * pair
        size += slope**2
        pair_size += pair_slope**2
        unary += rate * slope / np.sqrt(size)
        pair += rate * pair_slope / np.sqrt(pair_size)
    return Model(unary, pair)


class Writer:
    """Invented words, blocks and boxes of a page; `good` gathers the texts of its content blocks."""

    SYLLABLES = ("ba co di fu ga he ki lo mu na pe ri so tu va we xi yo za the ion ing er ver au", "qu ra sel tir om und ens pla gro mi che ste val dor ny")

    def __init__(self, rng: random.Random):
        self.rng, self.good, self.own = rng, set(), rng.choice(self.SYLLABLES).split()

    def words(self, least: int, most: int) -> str:
        one = lambda: "".join(self.rng.choice(self.own) for _ in range(self.rng.randint(1, 4)))
        return " ".join(one() for _ in range(self.rng.randint(least, most)))

    def sentence(self, least: int = 5, most: int = 25) -> str:
        parts = [self.words(2, 9) for _ in range(self.rng.randint(1, 3))] if most > 8 else [self.words(least, most)]
        return ", ".join(parts).capitalize() + self.rng.choice("....!?")

    def prose(self, most: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def keep(self, text: str) -> str:
        self.good.add(text)
        return text

    def maybe(self, share: float, text: str) -> str:
        return text if self.rng.random() < share else ""

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'

    def menu(self) -> str:
        links = [self.link(self.words(1, 3)) for _ in range(self.rng.randint(3, 9))]
        shape = self.rng.random()
        if shape < 0.5:
            return "<ul>" + "".join(f"<li>{x}" + self.maybe(0.8, "</li>") for x in links) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(links) if shape < 0.85 else "".join(f"<div>{x}</div>" for x in links)

    def named(self, kind: str) -> str:
        """An attribute that says what a box is, sometimes in part of a longer name, sometimes only an invented one."""
        word, other = self.rng.choice(WORDS[kind].split()), self.words(1, 1).split()[0]
        return self.rng.choice([f' class="{word}"', f' id="{word}"', f' class="{other} {word}-{other}"', f' id="{other}_{word}"', f' class="{other}"'])

    def box(self, kind: str, inner: str, *tags: str) -> str:
        tag = self.rng.choice(tags or ("div",))
        return f"<{tag}{self.named(kind) if tag == 'div' or self.rng.random() < 0.5 else ''}>{inner}</{tag}>"

    def blocks(self, least: int, most: int, closed: float = 0.8, boxes: bool = True) -> str:
        """An article's blocks, with adverts and share bars between them."""
        out = []
        for _ in range(self.rng.randint(least, most)):
            roll = self.rng.random()
            if roll < 0.7:
                out.append(f"<p>{self.keep(self.prose() if self.rng.random() < 0.85 else self.sentence(1, 4))}" + self.maybe(closed, "</p>"))
            elif roll < 0.76:
                out.append(f"<h2>{self.keep(self.words(2, 6).capitalize())}</h2>")
            elif roll < 0.82:
                tag = self.rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.keep(self.sentence() if self.rng.random() < 0.6 else self.words(2, 6))}</li>" for _ in range(self.rng.randint(2, 5))) + f"</{tag}>")
            elif roll < 0.86:
                out.append(f"<blockquote><p>{self.keep(self.prose(2))}</p></blockquote>")
            elif roll < 0.9:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rng.randint(1, 3))) + "</table>")
            elif roll < 0.93:
                out.append(f"<figure><img src='x.png'><figcaption>{self.keep(self.sentence())}</figcaption></figure>")
            elif roll < 0.95:
                out.append(f"<pre>{self.keep(self.words(3, 12))}</pre>")
            elif boxes:
                out.append(self.box("advert", self.prose(2) if self.rng.random() < 0.7 else self.link(self.words(2, 5)), "div", "aside") if roll < 0.985 else self.box("share", self.menu(), "div"))
        return "".join(out)

    def title(self, tag: str = "h1") -> str:
        return self.maybe(0.9, f"<{tag}>{self.keep(self.words(3, 9).capitalize())}</{tag}>")

    def thread(self) -> str:
        shapes = [lambda: f"<div><p>{self.prose(3)}</p></div>", lambda: f"<li><b>{self.words(1, 2)}</b> <p>{self.prose(2)}</p></li>", lambda: f"<p>{self.prose(3)}</p>", lambda: f'<div class="comment"><span>{self.words(1, 2)}</span><p>{self.prose(2)}</p></div>', lambda: f"<article><p>{self.prose(2)}</p></article>"]
        return f"<h3>{self.words(1, 2)}</h3>" + "".join(self.rng.choice(shapes)() for _ in range(self.rng.randint(1, 5)))

    def comments(self, tag: str = "div") -> str:
        return f'<{tag} {self.rng.choice(["class", "id"])}="{self.rng.choice(WORDS["comment"].split())}">{self.thread()}</{tag}>'

    def notice(self) -> str:
        return self.box("notice", f"<p>{self.prose(2)}</p>" + self.maybe(0.6, f"<button>{self.words(1, 2)}</button>"), "div", "div")

    def form(self) -> str:
        return self.rng.choice([f"<form><label>{self.words(1, 3)}</label><input><button>{self.words(1, 1)}</button></form>", f"<form><p>{self.sentence()}</p><input></form>"])

    def foot(self, *tags: str) -> str:
        inner = self.rng.choice([f"&copy; {self.words(1, 2)} &middot; {self.prose(2)}", f"<p>Copyright {self.words(1, 3)}</p>{self.menu()}", f"<p>{self.prose(2)}</p>", self.menu()])
        return self.box("foot", inner, *(tags or ("footer", "footer", "div")))

    def side(self) -> str:
        return self.box("side", f"<h3>{self.words(1, 3)}</h3>" + (self.menu() if self.rng.random() < 0.6 else f"<p>{self.prose(3)}</p>"), "aside", "div")

    def noscript(self) -> str:
        return f"<noscript>{self.rng.choice(['<img src=x>', self.sentence(), f'<p>{self.sentence()}</p>'])}</noscript>"


def _semantic(w: Writer) -> str:
    """Header, menu, article, comments and footer by their own elements."""
    above = w.maybe(0.6, f"<header>{w.link(w.words(1, 3))}{w.maybe(0.4, f'<p>{w.words(2, 6)}</p>')}</header>") + w.maybe(0.9, f"<nav>{w.menu()}</nav>") + w.maybe(0.4, w.box("advert", w.prose(2), "div")) + w.maybe(0.3, w.notice()) + w.maybe(0.2, w.form())
    if w.rng.random() < 0.2:  # nothing but the article
        return f"<article>{w.title()}{w.blocks(1, 4)}" + w.maybe(0.5, "</article>")
    body = w.title() + w.blocks(1, 10)
    below = w.maybe(0.4, w.side()) + w.maybe(0.45, w.comments("section")) + w.maybe(0.2, w.notice()) + w.maybe(0.9, w.foot("footer"))
    return above + w.rng.choice([f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>"]) + below


def _divided(w: Writer) -> str:
    """The same by div elements with telling names."""
    above = w.maybe(0.7, w.box("head", f"<h2>{w.words(1, 3)}</h2><p>{w.words(2, 6)}</p>" if w.rng.random() < 0.5 else w.link(w.words(1, 3)))) + w.maybe(0.9, w.box("menu", w.menu())) + w.maybe(0.4, w.box("advert", w.prose(2))) + w.maybe(0.3, w.notice()) + w.maybe(0.3, w.box("form", w.form()))
    if w.rng.random() < 0.1:
        return f"<div class=content>{w.title()}{w.blocks(1, 4)}</div>"
    body = f'<div class="{w.rng.choice(["content", "post", "entry-content", "article-body", "story", "main-text", "text", "col-8"])}">{w.title()}{w.maybe(0.3, w.box("meta", w.words(2, 5), "div", "p"))}{w.blocks(1, 10)}</div>'
    rest = w.maybe(0.5, w.side()) + w.maybe(0.45, w.comments()) + w.maybe(0.3, w.notice()) + w.maybe(0.9, w.foot("div"))
    return above + (f'<div id="wrapper">{body}</div>' if w.rng.random() < 0.4 else body) + rest


def _tabled(w: Writer) -> str:
    """Columns of a layout table, without telling names."""
    left, right = f"<td>{w.menu()}</td>", w.maybe(0.6, f"<td>{w.menu()}<p>{w.maybe(0.4, w.prose(1))}</p></td>")
    middle = f"<td>{w.title('h2')}{w.blocks(2, 9, 0.3, False)}</td>"
    return f"<table><tr><td colspan=3>{w.link(w.words(1, 4))}</td></tr><tr>{left}{middle}{right}</tr><tr><td colspan=3>{w.rng.choice([w.menu(), f'&copy; {w.words(2, 5)}'])}</td></tr></table>"


def _manual(w: Writer) -> str:
    """A manual's page: long menu beside a main part with code."""
    code = lambda: f"<pre><code>{w.keep(w.words(4, 15))}</code></pre>"
    body = w.title() + "".join(w.blocks(1, 3, boxes=False) + w.maybe(0.5, code()) for _ in range(w.rng.randint(1, 4)))
    menu = w.box("menu", "".join(f"<h4>{w.words(1, 2)}</h4>{w.menu()}" for _ in range(w.rng.randint(1, 4))), "nav", "aside", "div")
    main = f'<div role="main">{body}</div>' if w.rng.random() < 0.5 else f"<main>{body}</main>"
    return f"<header>{w.form()}{w.link(w.words(1, 2))}</header><div>{menu}{main}</div>{w.foot()}"


def _bare(w: Writer) -> str:
    """Headings and paragraphs right in the body, with lines of links above and below."""
    return w.maybe(0.7, f"<p>{' | '.join(w.link(w.words(1, 2)) for _ in range(w.rng.randint(3, 7)))}</p><hr>") + w.title() + w.blocks(3, 12, 0.4, False) + w.maybe(0.7, f"<hr><p>{' | '.join(w.link(w.words(1, 2)) for _ in range(w.rng.randint(2, 6)))}</p>") + w.maybe(0.3, f"<address>{w.words(2, 6)}</address>")


def _nested(w: Writer) -> str:
    """Deep div elements with invented names only: texts and links tell."""
    name = lambda: f' class="{w.words(1, 1).split()[0]}-{w.rng.randint(1, 99)}"'

    def deep(inner: str) -> str:
        for _ in range(w.rng.randint(1, 4)):
            inner = f"<div{name()}>{inner}</div>"
        return inner

    paragraphs = "".join(f"<div{name()}>{w.keep(w.prose(4))}</div>" if w.rng.random() < 0.4 else f"<p>{w.keep(w.prose())}</p>" for _ in range(w.rng.randint(3, 9)))
    return deep(w.menu()) + deep(w.title() + paragraphs) + deep("".join(f"<div{name()}>{w.link(w.words(3, 9))}</div>" for _ in range(w.rng.randint(3, 8)))) + deep(f"&copy; {w.words(2, 8)}")


#: Unlike layouts of labelled pages; a test holds each out in turn.
FAMILIES = {"semantic": _semantic, "divided": _divided, "tabled": _tabled, "manual": _manual, "bare": _bare, "nested": _nested}


def labelled_pages(n: int = 360, seed: int = 7, families: tuple[str, ...] = tuple(FAMILIES)) -> list[tuple[str, set[str]]]:
    """n pages of invented words, dealt over the families of layouts, and the texts of their content blocks."""
    rng, out = random.Random(seed), []
    for k in range(n):
        w = Writer(rng)
        body = w.maybe(0.15, w.noscript()) + FAMILIES[families[k % len(families)]](w)
        head = f"<title>{w.words(2, 5)}</title>" + w.maybe(0.5, "<meta charset=utf-8>") + w.maybe(0.5, "<style>b{color:red}</style>") + w.maybe(0.4, "<script>if (a<b) c('<p>');</script>")
        page = rng.choice([f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>", f"<html><head>{head}<body>{body}", f"{head}{body}", f"<!doctype html><html lang=en><head>{head}</head>{body}"])
        out.append((page, w.good))
    return out


@functools.lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with text and n_chars of each whole page."""
    model = model or default_model()
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    if clash := sorted(set(keep) & {"text", "n_chars"}):
        raise ValueError(f"the input already has columns {clash}; leave them out of keep")
    plain = pages.select(*keep, F.col(html).alias("_html"))
    schema = plain.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_html"):
            found = model.texts(batch.column("_html").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*keep, "text", "n_chars"])

    return plain.mapInArrow(run, schema)


def extract_rows(pages: DataFrame) -> DataFrame:
    return extract(pages, keep=["page_id", "url"])
