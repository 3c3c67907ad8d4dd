"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is parsed into a tree of block elements; runs of text and inline elements between blocks become
blocks of their own, so that an element either holds blocks or is text. Every node gets features: density of
text and links in its subtree, tokens of its tag, class, id and role and of those above it, depth, and how it
stands among its siblings. The trees give the odds that a node is part of the article. Decoding picks, for the whole tree at
once, the most likely states out of ARTICLE, OTHER and BOTH: below OTHER all is OTHER, below ARTICLE nothing
is BOTH, so a node's choice can't contradict its ancestors'.

The model is trained here on pages made by a rule (training_pages), whose nodes are known.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, map_arrow, table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
HIDDEN = frozenset("script style textarea title iframe noembed noframes noscript template svg math head select button object audio video canvas datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input progress output picture".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of the given kinds, up to the nearest of the bounds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BOUNDS = frozenset("ul ol dl table div article section aside nav main header footer body td th select form blockquote".split())

# Words in tags, classes, ids and roles that speak for or against the article.
FOR = frozenset("article main content post entry story text body blog news paragraph prose markdown page".split())
AGAINST = (
    frozenset("nav navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination skip links".split()),
    frozenset("header footer banner masthead copyright legal contentinfo colophon topbar bottom logo".split()),
    frozenset("aside sidebar complementary related recommended recommendations widget popular trending more rail teaser".split()),
    frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion promoted dfp banner outbrain taboola".split()),
    frozenset("comment comments commentlist disqus reply replies respond discussion reader feedback".split()),
    frozenset("cookie cookies consent gdpr notice popup modal overlay alert alertdialog dialog newsletter subscribe signup login share social search form paywall".split()),
)
LISTS = frozenset("ul ol dl menu".split())

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_attr = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_token = re.compile(r"[a-z]+")
_ends = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "words", "parent", "kids", "text", "links", "hidden")

    def __init__(self, tag: str, words: frozenset, parent: Node | None, hidden: bool):
        self.tag, self.words, self.parent, self.hidden = tag, words, parent, hidden
        self.kids: list[Node] = []
        self.text, self.links = "", 0


@functools.lru_cache(maxsize=20_000)
def _words(tag: str, marks: str) -> frozenset:
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", marks).lower()
    return frozenset([tag, *_token.findall(split)])


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, marks): kind is text, open, close or raw."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        nxt = page[lt + 1 : lt + 2]
        if nxt in "!?/" and nxt:
            if lt > at:
                yield "text", page[at:lt], ""
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            end = page.find(">", lt)
            if nxt == "/" and (m := _name.match(page, lt + 2)):
                yield "close", m[0].lower(), ""
            at = size if end < 0 else end + 1
            continue
        m = _name.match(page, lt + 1)
        if not m:
            yield "text", page[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        tag, pos, marks = m[0].lower(), m.end(), ""
        if page.startswith(">", pos):
            at = pos + 1
        else:
            own = []
            while (a := _attr.match(page, pos)) and a.end() > pos:
                if a[1].lower() in ("class", "id", "role"):
                    own.append(a[2] or a[3] or a[4] or "")
                pos = a.end()
            marks = " ".join(own)
            end = page.find(">", pos)
            at = size if end < 0 else end + 1
        if tag in RAW:
            end = _ends[tag].search(page, at)
            close = size if end is None else page.find(">", end.end())
            at = size if close < 0 or end is None else close + 1
            yield "raw", tag, marks
        else:
            yield "open", tag, marks


def parse(page: str) -> Node:
    """The tree of block elements. Text stands in nodes named #text, white space collapsed and references decoded."""
    root = Node("#root", frozenset(), None, False)
    stack: list[tuple[str, Node]] = [("#root", root)]  # inline elements are on the stack, but make no node
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                node = stack[-1][1]
                run = Node("#text", node.words, node, node.hidden)
                run.text, run.links = text, min(linked, len(text))
                node.kids.append(run)
            parts.clear()
            linked = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        for tag, _ in stack[k:]:
            if tag == "a":
                in_link -= 1
            if tag not in INLINE:
                flush()
        del stack[k:]

    for kind, name, marks in _tags(page):
        if kind == "text":
            parts.append(name)
            if in_link:
                linked += len(name.strip())
        elif kind == "open":
            if name == "br":
                parts.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            block = name not in INLINE
            if block:
                flush()
                if name in CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            pop_to(k)
                            break
                        if stack[k][0] in BOUNDS or stack[k][0] == "li":
                            break
                if name in ENDS:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in ENDS[name]:
                            pop_to(k)
                            if name not in ("tr", "thead", "tbody", "tfoot"):
                                break
                        elif stack[k][0] in BOUNDS:
                            break
                if name in ("html", "body"):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "head":
                            pop_to(k)
                    if any(t == name for t, _ in stack):
                        continue
                above = stack[-1][1]
                node = Node(name, _words(name, marks), above, above.hidden or name in HIDDEN)
                above.kids.append(node)
                stack.append((name, node))
            else:
                if name == "a":
                    in_link += 1
                hidden = stack[-1][1]
                stack.append((name, hidden))
        elif kind == "close":
            if name == "p" and not any(t == "p" for t, _ in stack):
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
    flush()
    return root


FEATURES = 36


def flatten(root: Node) -> tuple[list[Node], list[int], np.ndarray]:
    """Nodes in page order (hidden ones left out), the index of each one's parent, and their features."""
    nodes: list[Node] = []
    parents: list[int] = []
    depth: list[int] = []
    place: list[tuple[int, int]] = []
    todo = [(root, -1, 0, 0, 1)]
    while todo:
        node, up, deep, k, n = todo.pop()
        at = len(nodes)
        nodes.append(node)
        parents.append(up)
        depth.append(deep)
        place.append((k, n))
        shown = [x for x in node.kids if not x.hidden]
        for i in range(len(shown) - 1, -1, -1):
            todo.append((shown[i], at, deep + 1, i, len(shown)))
    count = len(nodes)
    chars, links, blocks, paras, stops, items, tags = ([0] * count for _ in range(7))
    longest = [0] * count
    for i in range(count - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            chars[i], links[i], blocks[i] = len(node.text), node.links, 1
            stops[i] = node.text.count(". ") + node.text.count(", ") + node.text.endswith(".")
            longest[i] = chars[i]
        else:
            tags[i] += 1
            paras[i] += node.tag == "p"
            items[i] += node.tag == "li"
        if (up := parents[i]) >= 0:
            for a in (chars, links, blocks, paras, stops, items, tags):
                a[up] += a[i]
            longest[up] = max(longest[up], longest[i])
    total, seen = max(1, chars[0]), 0
    rows = np.zeros((count, FEATURES))
    above: list[tuple[float, ...]] = [()] * count
    side = {(up, k): i for i, (up, (k, _)) in enumerate(zip(parents, place))}
    before = [0] * count
    for i, node in enumerate(nodes):
        before[i] = seen
        if node.tag == "#text":
            seen += chars[i]
        own = (float(not FOR.isdisjoint(node.words)), *(float(not bad.isdisjoint(node.words)) for bad in AGAINST))
        up = parents[i]
        inherited = above[up] if up >= 0 else (0.0,) * 7
        above[i] = tuple(map(max, own, inherited))
        n, k = place[i]
        around = chars[up] if up >= 0 else chars[i]
        prior, following = side.get((up, k - 1), -1), side.get((up, k + 1), -1)
        rows[i] = (
            math.log1p(chars[i]), links[i] / max(1, chars[i]), chars[i] / (1 + tags[i]), math.log1p(chars[i] / max(1, blocks[i])),
            math.log1p(longest[i]), stops[i] / max(1, chars[i]) * 100, paras[i] / max(1, tags[i]), items[i] / max(1, tags[i]),
            depth[i], n, k, chars[i] / max(1, around), chars[i] / total, before[i] / total,
            links[up] / max(1, chars[up]) if up >= 0 else 0, math.log1p(chars[prior]) if prior >= 0 else -1, math.log1p(chars[following]) if following >= 0 else -1,
            (chars[up] - chars[i]) / max(1, n - 1) / 100 if up >= 0 else 0, paras[up] / max(1, tags[up]) if up >= 0 else 0, stops[i] / max(1, blocks[i]),
            *own, *above[i], node.tag == "#text", node.tag[:1] == "h" and node.tag[1:].isdigit(),
        )
    return nodes, parents, rows


class Boosted:
    """Gradient boosting with the logistic loss: trees of fixed depth over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
        p = min(1 - 1e-6, max(1e-6, y.mean()))
        self.start = math.log(p / (1 - p))
        margin = np.full(len(y), self.start)
        inner = (1 << self.depth) - 1
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-margin))
            grad, hess = y - q, q * (1 - q)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, wide = (1 << level) - 1, 1 << level
                here = at - first
                n, g, h = (np.bincount(here, v, wide) for v in (None, grad, hess))
                best = np.full(wide, 1e-6)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    # sums of all nodes of the level at once: a row a node, a column a bin
                    slot = here * (len(c) + 1) + code[f]
                    gs, hs = (np.bincount(slot, v, wide * (len(c) + 1)).reshape(wide, -1).cumsum(axis=1)[:, :-1] for v in (grad, hess))
                    gain = gs**2 / (hs + 1) + (g[:, None] - gs) ** 2 / (h[:, None] - hs + 1) - (g**2 / (h + 1))[:, None]
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(wide), k]
                    better = (n >= 20) & (top > best)
                    best[better], feature[first:][:wide][better], cut[first:][:wide][better] = top[better], f, c[k[better]]
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            leaf = at - inner
            g, h = np.bincount(leaf, grad, 1 << self.depth), np.bincount(leaf, hess, 1 << self.depth)
            value = self.rate * g / (h + 1)
            margin += value[leaf]
            self.made.append((feature, cut, value))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, value in self.made:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            out += value[at - ((1 << self.depth) - 1)]
        return out


#: Cost of an OTHER node directly below an ARTICLE node, and of BOTH: islands in the article need evidence.
ISLAND, MIXED = 3.0, 2.0


def decode(parents: list[int], odds: list[float], both: list[float]) -> list[bool]:
    """Whether each node is ARTICLE in the most likely consistent assignment.

    Nodes in page order; odds: log odds of ARTICLE against OTHER; both: log odds of holding both against either.
    """
    n = len(parents)
    inside, outside, mixed = [0.0] * n, [0.0] * n, [0.0] * n
    has_kids = [False] * n
    for i in range(n - 1, -1, -1):
        z = min(30.0, max(-30.0, odds[i]))
        b = min(30.0, max(-30.0, both[i])) if has_kids[i] else -30.0
        single = math.log1p(math.exp(b))
        inside[i] -= math.log1p(math.exp(-z)) + single
        outside[i] -= math.log1p(math.exp(z)) + single
        mixed[i] = mixed[i] - math.log1p(math.exp(-b)) - MIXED if has_kids[i] else -1e9
        if (up := parents[i]) >= 0:
            has_kids[up] = True
            inside[up] += max(inside[i], outside[i] - ISLAND)
            outside[up] += outside[i]
            mixed[up] += max(inside[i], outside[i], mixed[i])
    state = [0] * n  # 1 article, 0 other, 2 both
    for i in range(n):
        up = parents[i]
        if up < 0:
            state[i] = max((mixed[i], 2), (inside[i], 1), (outside[i], 0))[1]
        elif state[up] == 0:
            state[i] = 0
        elif state[up] == 1:
            state[i] = int(inside[i] >= outside[i] - ISLAND)
        else:
            state[i] = max((mixed[i], 2), (inside[i], 1), (outside[i], 0))[1]
    return [s == 1 for s in state]


# ---- training pages -------------------------------------------------------------------------------

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za".split()


def _sentence(rng: random.Random, words: int) -> str:
    made = [" ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) + ("," if rng.random() < 0.08 else "") for _ in range(words))]
    return made[0].rstrip(",").capitalize() + "."


def _prose(rng: random.Random, sentences: int) -> str:
    return " ".join(_sentence(rng, rng.randint(1, 24)) for _ in range(sentences))


def _marked(rng: random.Random, tags: list[str], names: list[str], body: str) -> str:
    tag = rng.choice(tags)
    marks = rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} x{rng.randint(1, 9)}"'])
    if tag in ("div", "section", "p", "ul") and not marks:
        marks = f' class="{rng.choice(names)}"'
    return f"<{tag}{marks}>{body}</{tag}>"


def _links(rng: random.Random, n: int) -> str:
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","])
    item = lambda: f'<a href="/{rng.choice(_SYLLABLES)}">{rng.choice([str.capitalize, str])(" ".join(word() for _ in range(rng.choice([1, 1, 1, 2, 4]))))}</a>'
    if rng.random() < 0.6:
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
    return rng.choice([" ", " | ", ""]).join(item() for _ in range(n))


def training_page(seed: int) -> str:
    """A page made by a rule. Article text is marked by the attribute id="keep…" in a wrapper that is removed before features are made."""
    rng = random.Random(seed)
    other = {
        "nav": lambda: _marked(rng, ["nav", "div", "ul"], ["nav", "menu", "main-menu", "breadcrumb", "navbar navigation"], _links(rng, rng.randint(2, 12))),
        "header": lambda: _marked(rng, ["header", "div"], ["header", "masthead", "site-header", "topbar"], rng.choice(["<h1>", "<h2>", "<p>", ""]) + _sentence(rng, rng.randint(1, 5))),
        "footer": lambda: _marked(rng, ["footer", "div"], ["footer", "site-footer", "copyright", "legal"], f"&copy; {_prose(rng, rng.randint(1, 3))}" + rng.choice(["", _links(rng, 4)])),
        "side": lambda: _marked(rng, ["aside", "div", "section"], ["sidebar", "related", "widget", "popular-posts", "teaser"], "".join(rng.choice([f"<h3>{_sentence(rng, 3)}</h3>", f"<p>{_prose(rng, 2)}</p>", _links(rng, 5)]) for _ in range(rng.randint(1, 4)))),
        "ad": lambda: _marked(rng, ["div", "section", "p", "aside"], ["ad", "ads", "advert", "sponsored", "promo-box", "banner-ad"], _prose(rng, rng.randint(1, 4))),
        "comments": lambda: _marked(rng, ["div", "section", "ul"], ["comments", "comment-list", "replies", "discussion"], "".join(f'<div class="comment"><b>{_sentence(rng, 1)}</b><p>{_prose(rng, rng.randint(1, 5))}</p></div>' for _ in range(rng.randint(1, 6)))),
        "notice": lambda: _marked(rng, ["div", "section", "p"], ["cookie-notice", "consent", "popup", "newsletter", "modal", "alert", "subscribe", "social-share"], f"<p>{_prose(rng, rng.randint(1, 3))}</p>" + rng.choice(["", "<button>Ok</button>"])),
        "form": lambda: _marked(rng, ["form"], ["search", "login", "signup", "respond"], f"<label>{_sentence(rng, 2)}</label><input name=q><p>{_sentence(rng, 4)}</p>"),
    }
    pick = lambda names, low, high: "".join(other[rng.choice(names)]() for _ in range(rng.randint(low, high)))
    blocks = [f"<h1>{_sentence(rng, rng.randint(2, 9))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        blocks.append(rng.choices([
            f"<p>{_prose(rng, rng.randint(1, 8))}</p>", f"<p><b>{_sentence(rng, 4)}<br><p>{_prose(rng, 3)}</p>", f"<h2>{_sentence(rng, 4)}</h2>",
            "<ul>" + "".join(f"<li>{_sentence(rng, rng.randint(1, 12))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>",
            f"<blockquote><p>{_prose(rng, 2)}</p></blockquote>", f"<p>{_prose(rng, 2)} <a href=x>{_sentence(rng, 2)}</a> {_prose(rng, 1)}</p>", _prose(rng, 3), f"<p>{_sentence(rng, 1)}</p>",
            f"<table><tr><td>{_sentence(rng, 2)}<td>{_sentence(rng, 3)}</table>",
        ], [10, 2, 2, 1, 1, 3, 1, 3, 0.5])[0])
    keep = lambda text: f'<div id="keep">{text}</div>'
    if rng.random() < 0.35:
        cut = rng.randint(0, len(blocks))
        body = keep("".join(blocks[:cut])) + pick(["ad", "notice", "side", "form"], 1, 2) + keep("".join(blocks[cut:]))
    else:
        body = keep("".join(blocks))
    tail = pick(["comments"], 1, 1) if rng.random() < 0.25 else ""
    article = _marked(rng, ["article", "article", "article", "main", "div", "section"], ["content", "post", "entry-content", "article-body", "story", "main-text"], body + (tail if rng.random() < 0.5 else ""))
    if rng.random() < 0.15:
        article = body
    if rng.random() < 0.4:
        article = f'<{(t := rng.choice(["main", "div"]))} {rng.choice(["", "class=wrapper", "id=page"])}>{pick(["nav", "side", "ad"], 0, 1)}{article}{pick(["side", "ad", "comments"], 0, 1)}</{t}>'
    top = pick(["nav", "header", "notice", "ad", "form"], 0, 4)
    return f"<!DOCTYPE html><html><head><title>{_sentence(rng, 4)}</title></head><body>{top}{article}{tail}{pick(['side', 'ad', 'comments', 'notice', 'nav'], 0, 3)}{other['footer']() if rng.random() < 0.85 else ''}</body></html>"


def _unwrap(node: Node, kept: bool, known: dict[int, bool]) -> None:
    """Takes the marking wrappers out of the tree and notes which text nodes are article."""
    kids = []
    for kid in node.kids:
        if "keep" in kid.words and kid.tag == "div":
            _unwrap(kid, True, known)
            for x in kid.kids:
                x.parent = node
                if x.tag == "#text":
                    x.words = node.words
            kids += kid.kids
        else:
            if kid.tag == "#text":
                known[id(kid)] = kept
            _unwrap(kid, kept, known)
            kids.append(kid)
    node.kids = kids


def training_rows(pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Features, and the share of article text, of every node with text on `pages` made pages."""
    xs, ys = [], []
    for seed in range(pages):
        root = parse(training_page(seed))
        known: dict[int, bool] = {}
        _unwrap(root, False, known)
        nodes, parents, rows = flatten(root)
        own, every = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == "#text":
                every[i] = len(nodes[i].text)
                own[i] = every[i] * known.get(id(nodes[i]), False)
            if parents[i] >= 0:
                own[parents[i]] += own[i]
                every[parents[i]] += every[i]
        share = np.array([a / max(1, b) for a, b in zip(own, every)])
        told = np.array(every) > 0
        xs.append(rows[told])
        ys.append(share[told])
    return np.concatenate(xs), np.concatenate(ys)


Model = tuple[Boosted, Boosted]


@functools.lru_cache(maxsize=1)
def model(pages: int = 800) -> Model:
    """Trees for ARTICLE against OTHER and for BOTH against either; `pages` bounds the training set, which doesn't grow with the corpus."""
    x, share = training_rows(pages)
    both = (share > 0) & (share < 1)
    return Boosted().fit(x[~both], share[~both]), Boosted(trees=40).fit(x, both.astype(float))


def main_text(page: str | None, trees: Model) -> str:
    """Blocks of the article in page order, joined by one space; empty if there are none."""
    nodes, parents, rows = flatten(parse(page or ""))
    kept = decode(parents, *(t.odds(rows).tolist() for t in trees))
    return " ".join(n.text for n, k in zip(nodes, kept) if k and n.tag == "#text")


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: Model | None = None) -> DataFrame:
    """The `keep` columns and text, per row of pages.

    Null html counts as empty and gives the empty text; repeated rows are read each; other columns are ignored; an
    empty table gives no rows.
    """
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)), "text string"])
    shipped = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # the trees read the nodes of many pages at once
                part = batch.slice(at, 64)
                flat = [flatten(parse(p.as_py() or "")) for p in part.column(part.num_columns - 1)]
                rows = np.concatenate([x for _, _, x in flat])
                odds, both = (t.odds(rows).tolist() for t in own)
                texts, k = [], 0
                for nodes, parents, _ in flat:
                    kept = decode(parents, odds[k : k + len(nodes)], both[k : k + len(nodes)])
                    k += len(nodes)
                    texts.append(" ".join(n.text for n, mine in zip(nodes, kept) if mine and n.tag == "#text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], schema=arrow_schema(schema))

    src = pages.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.col(html_col).cast("string").alias("h"))
    return map_arrow(src, run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "text")


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
