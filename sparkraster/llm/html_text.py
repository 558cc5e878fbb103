"""Main text of web pages: a tree-structured graphical model over DOM nodes, solved by sum-product message passing.

Every block element and every run of text of a page is a node with two states, content or not. A node's own potential is
log-linear in ``FEATURES`` of its tag, its class and id words, its link share, length and place; each parent and child share a potential
for the four pairs of their states, by the kind of child. Messages go up from the leaves and down from the root, so every node gets its exact marginal; text
runs at ``KEEP`` or more are the main text, in page order.

The potentials are trained from labelled pages: pages of the sample whose article element says what is content, and variants of them in which
the article's tag is hidden and sidebars, notices, forms, comments and other parts taken from other pages are planted.

Defined cases: a null or blank html, or one without content, gives an empty text. Character references are decoded, white space inside a block
becomes one space, blocks are joined by line feeds; a br is white space. Script, style, head, template and the like are no text. Unclosed and
stray tags are tolerated. Copies of a page get the same text. An empty table gives an empty result. If no page can serve for training, built-in
ones do. Only page_id, url and html are read, so other columns can't clash.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from math import exp, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.common import table

SAMPLE, KEEP = 60, 0.5

HIDDEN = frozenset("head script style template noscript svg iframe object canvas audio video select textarea button datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: Elements that stand apart; any other tag, unknown ones too, is part of the line it stands in.
BLOCKS = ENDS_P | frozenset("tr td th thead tbody tfoot caption legend summary title frameset noframes".split())
#: A start tag ends an open element of these kinds, up to the nearest element of the second kinds.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",))}
#: Words of class, id and role attributes, by what they tell.
CLUES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toolbar pagination pager",
    "head": "header masthead banner topbar head logo",
    "foot": "footer foot bottom copyright colophon contentinfo legal",
    "side": "sidebar side aside rail complementary widget widgets related recommended recommendations more popular trending",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall dialog message",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion adslot adbox dfp banner-ad",
    "form": "form search searchbox login comment-form respond contact",
    "comment": "comment comments commentlist discussion disqus reply replies responses reader-comments feedback",
    "share": "share sharing social follow tags tag meta byline author",
    "body": "article content post entry story body main text articlebody post-content entry-content story-body page hentry",
}
CLUE_OF = {w: k for k, ws in CLUES.items() for w in ws.split()}
TAGS = "article main section div p h1 h2 h3 ul ol li table tr td blockquote pre nav header footer aside form figure dl body #text".split()
FEATURES = tuple(f"tag {t}" for t in TAGS) + tuple(f"clue {k}" for k in CLUES) + ("bias", "links", "all links", "length", "short", "stops", "text share")
AT = {f: i for i, f in enumerate(FEATURES)}


class Node:
    __slots__ = ("tag", "clues", "parent", "children", "parts", "linked", "stops", "size", "text")

    def __init__(self, tag: str, clues: frozenset, parent: Node | None):
        self.tag, self.clues, self.parent, self.children, self.parts = tag, clues, parent, [], []
        self.linked = self.stops = self.size = 0
        self.text = ""


class Dom(HTMLParser):
    """Block elements and runs of text; ``nodes`` has parents before children, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body", frozenset(), None)
        self.nodes, self.open, self.hidden, self.links, self.run = [self.root], [], 0, 0, None
        self.places: dict[str, list[int]] = {}  # where elements of each tag stand among the open ones, so no tag has to walk through them
        self.blocks = [-1]
        self.push("body", self.root)

    def push(self, tag, node):
        self.places.setdefault(tag, []).append(len(self.open))
        if node is not None:
            self.blocks.append(len(self.open))
        self.open.append((tag, node))

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
            self.push(tag, None)
            return
        if tag in VOID:
            if tag in ("br", "hr") and not self.hidden:
                self.handle_data(" ")
            return
        if tag in ("html", "body"):
            return
        if self.hidden and self.open[-1][0] == "head":  # a head that was never closed
            self.pop(len(self.open) - 1)
        if self.hidden:  # nothing inside a hidden element is part of the page
            self.push(tag, None)
            return
        if tag in ENDS_P:
            self.end_open(("p",), ("article", "table", "td", "button"))
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag not in BLOCKS:
            self.links += tag == "a"
            self.push(tag, None)
            return
        clues = frozenset(CLUE_OF[w] for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for x in v.lower().split() for w in {x, *re.split(r"[-_\d]+", x)} if w in CLUE_OF)
        node = Node(tag, clues, self.block())
        node.parent.children.append(node)
        self.nodes.append(node)
        self.push(tag, node)
        self.run = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def parse_marked_section(self, i, report=1):
        """A marked section is a comment up to its first >, whatever its keyword."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def block(self) -> Node:
        return self.open[self.blocks[-1]][1]

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end_open(self, kinds, within):
        i = self.last(kinds)
        if i > self.last(within):
            self.pop(i)

    def pop(self, i):
        for tag, node in reversed(self.open[i:]):
            self.places[tag].pop()
            self.hidden -= tag in HIDDEN
            if node is not None:
                self.run = None
                self.blocks.pop()
            else:
                self.links -= tag == "a" and not self.hidden
        del self.open[i:]

    def handle_endtag(self, tag):
        i = self.last((tag,))
        if i and (tag in BLOCKS or tag in HIDDEN or i > self.blocks[-1]):  # an inline end tag reaches no further than its block
            self.pop(i)

    def handle_data(self, data):
        if self.hidden:
            return
        if self.run is None:
            if not data.strip():
                return
            parent = self.block()
            self.run = Node("#text", frozenset(), parent)
            parent.children.append(self.run)
            self.nodes.append(self.run)
        self.run.parts.append(data)
        if self.links:
            self.run.linked += len(data.strip())


def parse(html: str) -> list[Node]:
    d = Dom()
    d.feed(html)
    HTMLParser.close(d)  # text that the parser still holds
    for n in d.nodes:
        if n.tag == "#text":
            n.text = " ".join("".join(n.parts).split())
            n.size, n.stops = len(n.text), sum(map(n.text.count, ".,;!?"))
            n.linked = min(n.linked, n.size)
    for n in reversed(d.nodes):
        if n.parent is not None:
            n.parent.size, n.parent.linked, n.parent.stops = n.parent.size + n.size, n.parent.linked + n.linked, n.parent.stops + n.stops
    return d.nodes


def features(nodes: list[Node], i: int) -> list[tuple[int, float]]:
    """(feature, value) of a node that aren't 0. A run of text has the clues of the block it stands in by messages, not by features."""
    n, whole = nodes[i], max(1, nodes[0].size)
    f = [(AT["bias"], 1.0), (AT["links"], n.linked / max(1, n.size)), (AT["length"], log1p(n.size) / 8), (AT["text share"], n.size / whole), (AT["stops"], min(1.0, 20 * n.stops / max(1, n.size)))]
    if f"tag {n.tag}" in AT:
        f.append((AT[f"tag {n.tag}"], 1.0))
    f += [(AT[f"clue {c}"], 1.0) for c in n.clues]
    if n.size and n.linked >= 0.9 * n.size:
        f.append((AT["all links"], 1.0))
    if n.size < 40:
        f.append((AT["short"], 1.0))
    return f


LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption address summary caption".split())


def kind(n: Node) -> int:
    """Pair potentials are learnt apart for children that are runs of text, blocks of text, and containers."""
    return 0 if n.tag == "#text" else 1 if n.tag in LEAVES else 2


def marginals(nodes: list[Node], own: list[float], pair: list[list[float]], pairs: list | None = None) -> list[float]:
    """Log odds of content of every node by one pass up and one down; pair: for each kind of child the log potentials of
    (parent, child) = 00, 01, 10, 11. ``pairs`` receives (kind, probabilities of the four) of every edge."""
    at = {id(n): i for i, n in enumerate(nodes)}
    parent = [at[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    ex = [[exp(x) for x in p] for p in pair]
    kinds = [kind(n) for n in nodes]
    up, below = [0.0] * len(nodes), list(own)

    def message(b: float, x00: float, x01: float, x10: float, x11: float) -> float:
        e = exp(max(-60.0, min(60.0, b)))
        return log((x10 + x11 * e) / (x00 + x01 * e))
    for i in range(len(nodes) - 1, 0, -1):
        up[i] = message(below[i], *ex[kinds[i]])
        below[parent[i]] += up[i]
    belief = list(below)
    for i in range(1, len(nodes)):
        e00, e01, e10, e11 = ex[kinds[i]]
        rest = belief[parent[i]] - up[i]
        belief[i] += message(rest, e00, e10, e01, e11)
        if pairs is not None:
            a, b = exp(max(-60.0, min(60.0, rest))), exp(max(-60.0, min(60.0, below[i])))
            q = (e00, e01 * b, e10 * a, e11 * a * b)
            t = sum(q)
            pairs.append((kinds[i], [x / t for x in q]))
    return belief


class Model:
    def __init__(self, weights: np.ndarray, pair: list[list[float]]):
        self.weights, self.pair = weights.tolist(), pair

    def odds(self, nodes: list[Node]) -> list[float]:
        w = self.weights
        return marginals(nodes, [sum(w[k] * v for k, v in features(nodes, i)) for i in range(len(nodes))], self.pair)

    def text(self, html: str | None) -> str:
        if not html or not html.strip():
            return ""
        nodes = parse(html)
        edge = log(KEEP / (1 - KEEP))
        return "\n".join(n.text for n, o in zip(nodes, self.odds(nodes)) if n.tag == "#text" and n.text and o >= edge)


BAD_TAGS = frozenset("nav header footer aside form".split())
BAD_CLUES = frozenset(CLUES) - {"body"}


def labels(nodes: list[Node], marked: str = "article") -> list[int] | None:
    """1 for what is inside the page's marked element and in no part of another kind; None if it has no such element."""
    if not any(n.tag == marked for n in nodes):
        return None
    at = {id(n): i for i, n in enumerate(nodes)}
    y, bad = [], []
    for n in nodes:
        p = at[id(n.parent)] if n.parent is not None else None
        bad.append(n.tag in BAD_TAGS or bool(n.clues & BAD_CLUES) or (p is not None and bad[p]))
        y.append(int(not bad[-1] and (n.tag == marked or (p is not None and y[p]))))
    return y


def variants(html: str, other: list[str], rng) -> Iterator[str]:
    """The page, and copies with parts of other kinds planted in and around the article."""
    yield html
    words = [w for x in other for w in x.split()] or ["and"]
    say = lambda n: escape(" ".join(words[i] for i in rng.integers(0, len(words), n)))
    links = lambda n: "".join(f'<li><a href="/{i}">{say(rng.integers(1, 4))}</a></li>' for i in range(n))
    for _ in range(4):
        around = [f'<aside class="{rng.choice(["sidebar", "widget", "related"])}"><h3>{say(2)}</h3><ul>{links(4)}</ul><p>{say(15)}</p></aside>',
                  f'<div class="{rng.choice(["sidebar", "side", "widget"])}"><h2>{say(2)}</h2><p>{say(rng.integers(5, 60))}</p></div>',
                  f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "newsletter", "consent"])}"><p>{say(rng.integers(6, 30))}</p><button>ok</button></div>',
                  f'<div class="{rng.choice(["ad", "advert", "sponsored", "promo"])}">{say(rng.integers(4, 40))}</div>',
                  f'<form class="search"><label>{say(2)}</label><input name="q"><p>{say(4)}</p></form>',
                  f'<section class="{rng.choice(["comments", "comment-list"])}" id="comments"><h2>{say(2)}</h2>' + "".join(f'<div class="comment"><p><b>{say(1)}</b> {say(rng.integers(5, 60))}</p></div>' for _ in range(4)) + "</section>",
                  f'<header class="site"><h1>{say(3)}</h1><p>{say(6)}</p></header>', f'<div class="menu"><ul>{links(6)}</ul></div>',
                  f'<div class="share"><a href="#">{say(1)}</a> <a href="#">{say(1)}</a></div>', f'<footer><p>{say(12)}</p></footer>', f"<nav>{say(3)} <a href='/'>{say(2)}</a></nav>"]
        rng.shuffle(around)
        n = int(rng.integers(1, 5))
        inside = "".join(x for x in around[:n] if rng.random() < 0.4)
        more = [f"<h2>{say(3)}</h2>", f"<ul><li>{say(5)}</li><li>{say(9)}</li></ul>", f"<blockquote><p>{say(20)}</p></blockquote>", f"<div><p>{say(25)}.</p><p>{say(3)}.</p></div>", f"<p>{say(30)}, {say(5)}.</p>"]
        rng.shuffle(more)
        inner = "".join(more[:int(rng.integers(0, 4))])
        depth = int(rng.integers(0, 3))
        before, after = "".join(f'<div class="{rng.choice(["layout", "wrapper", "container", "row", "x1"])}">' for _ in range(depth)), "</div>" * depth
        h = re.sub(r"(?i)<article[^>]*>", lambda m: "".join(around[n:2 * n]) + before + m[0], html, count=1)
        h = re.sub(r"(?i)</article>", lambda m: inside + inner + m[0] + "".join(around[2 * n:3 * n]) + after, h, count=1)
        yield h


BUILT_IN = ["<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>A plain heading.</h1><p>Some sentences of text stand here, and more of them follow.</p><p>Another block, "
            "which is long enough to be told from a menu.</p></article><footer>All rights reserved.</footer></body></html>"] * 20


def train(pages: list[str], seed: int = 5, rounds: int = 25) -> Model:
    """Maximum likelihood: what the labels count of features and pairs, less what the marginals expect of them, moves the potentials."""
    rng = np.random.default_rng(seed)
    pages = [h for h in pages if labels(parse(h)) is not None] or BUILT_IN
    texts = [n.text for h in pages for n in parse(h) if n.tag == "#text"]
    examples = []
    for h in pages:
        for k, v in enumerate(variants(h, texts, rng)):
            nodes = parse(v)
            lab = labels(nodes)
            if k >= 3:  # here the article is an element like others
                tag, clues = str(rng.choice(["div", "section", "main"])), frozenset({"body"} if rng.random() < 0.7 else ())
                for n in nodes:
                    if n.tag == "article":
                        n.tag, n.clues = tag, clues
            examples.append((nodes, [features(nodes, i) for i in range(len(nodes))], lab))
    w, pair = [0.0] * len(FEATURES), np.zeros((3, 4))
    gw, gp = np.full(len(FEATURES), 1e-6), np.full((3, 4), 1e-6)
    at_of = [{id(n): i for i, n in enumerate(nodes)} for nodes, _, _ in examples]
    order = np.arange(len(examples))
    for r in range(rounds):
        rng.shuffle(order)
        for part in np.array_split(order, max(1, len(order) // 16)):
            g, q = np.zeros(len(FEATURES)), np.zeros((3, 4))
            for x in part:
                nodes, feats, lab = examples[x]
                edges: list = []
                odds = marginals(nodes, [sum(w[k] * v for k, v in f) for f in feats], pair.tolist(), edges)
                for f, y, o in zip(feats, lab, odds):
                    miss = y - 1 / (1 + exp(-max(-60.0, min(60.0, o))))
                    if abs(miss) > 1e-4:
                        for k, v in f:
                            g[k] += miss * v
                for n, y, (kd, p) in zip(nodes[1:], lab[1:], edges):
                    q[kd, 2 * lab[at_of[x][id(n.parent)]] + y] += 1
                    q[kd] -= p
            g, q = g / len(part) - 1e-3 * np.array(w), q / len(part) - 1e-3 * pair
            gw, gp = gw + g * g, gp + q * q
            w = (np.array(w) + 0.3 * g / np.sqrt(gw)).tolist()
            pair = np.clip(pair + 0.3 * q / np.sqrt(gp), -12, 12)
    return Model(np.array(w), pair.tolist())


def training_pages(pages: DataFrame, most: int = SAMPLE) -> list[str]:
    """About ``most`` pages of moderate length by a hash of page_id, from all of the table."""
    short = pages.filter("html is not null and length(html) between 200 and 20000").select("page_id", "html")
    n = short.count()
    h = F.xxhash64("page_id")  # 62 bits of it, so that the share stays above 0 for any number of pages
    place = F.shiftleft(F.pmod(h, F.lit(1 << 20)), 42) + F.pmod(F.shiftrightunsigned(h, 20), F.lit(1 << 42))
    picked = short.filter(place < min(1 << 62, (most << 62) // max(1, n))).orderBy("page_id")
    out = [r["html"] for r in picked.collect()]
    if n and not out:
        raise ValueError(f"none of {n} pages was picked for training")
    return out


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Adds ``text`` to page_id and url."""
    def run(html: pd.Series) -> pd.Series:
        return html.map(model.text)

    run.__annotations__ = {"html": pd.Series, "return": pd.Series}
    return pages.select("page_id", "url", F.coalesce(F.pandas_udf(run, "string")(F.coalesce("html", F.lit(""))), F.lit("")).alias("text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(training_pages(pages))).withColumn("n_chars", F.length("text").cast("long"))
