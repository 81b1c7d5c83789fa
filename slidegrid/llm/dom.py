"""A small block-level document tree for HTML pages, with features of its nodes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Fixed values of the HTML standard: elements without an end tag, elements whose text is never shown, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg math object canvas audio video select textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the first kind ends when one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
SCOPES = frozenset("html body article section div main aside nav header footer form table ul ol dl blockquote td th".split())
LISTS, ITEMS = frozenset("ul ol dl".split()), frozenset("li dt dd".split())
ENDED_BY = {tag: [held for held in (*ENDS, "p") if tag in (CLOSES_P if held == "p" else ENDS[held])] for tag in CLOSES_P.union(*ENDS.values())}

GROUPS = ("article main", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer", "aside", "form fieldset button", "section div", "ul ol dl", "li dt dd", "table tr td th tbody thead", "head title", "body html #root", "figure figcaption")
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags.split()}
_ASIDE = [_GROUP[tag] for tag in ("nav", "header", "footer", "aside", "form", "head")]
GOOD_TOKENS = frozenset("article content main post entry body text story prose page".split())
BAD_TOKENS = frozenset("nav menu header footer sidebar side ad ads advert advertisement banner promo sponsor sponsored cookie cookies notice consent gdpr popup modal alert comment comments reply replies discussion disqus respond share social related recommended breadcrumb breadcrumbs widget login signup subscribe newsletter form search pagination pager toolbar masthead copyright legal tracking".split())
_TOKEN = re.compile(r"[A-Za-z][a-z]*")
_NOT_SHOWN = re.compile(r"(?i)display\s*:\s*none")


def shown(attrs: list) -> bool:
    return not any(k == "hidden" or k == "style" and v and _NOT_SHOWN.search(v) for k, v in attrs)


def tokens_of(attrs: list) -> tuple[int, int, int]:
    """(good, bad, mentions): tokens of names that are good words; bad words in names that mostly consist of such; bad words in any name."""
    names = {n for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for n in v.split()}
    good, bad, mentions = set(), set(), set()
    for name in names:
        own = [t.lower() for t in _TOKEN.findall(name)]
        good.update(t for t in own if t in GOOD_TOKENS)
        found = [t for t in own if t in BAD_TOKENS]
        mentions.update(found)
        if 2 * len(found) >= len(own):
            bad.update(found)
    return len(good), len(bad), len(mentions)


class Node:
    __slots__ = ("tag", "parent", "depth", "good", "bad", "mentions", "children", "text", "linked", "marks", "words", "first", "last", "below", "hidden")

    def __init__(self, tag: str, parent: int, depth: int, good: int, bad: int, mentions: int, hidden: bool):
        self.tag, self.parent, self.depth, self.good, self.bad, self.mentions, self.hidden = tag, parent, depth, good, bad, mentions, hidden
        self.children: list[int] = []
        self.text = self.linked = self.marks = self.words = self.below = 0
        self.first = self.last = 0


class Page(HTMLParser):
    """nodes in page order, and segments (node, text): what stands in one block between the borders of blocks.

    The places of open elements are kept by name, so a tag costs the same however many elements are open.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, 0, 0, 0, 0, False)]
        self.segments: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = [("#root", 0)]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []  # places of open elements in SCOPES, and of those but lists
        self.boxes: list[int] = []
        self.muted: list[str] = []  # an inline element that is not shown, and open ones of its name in it
        self.buffer: list[str] = []
        self.links = self.linked = 0
        self.feed(html)
        self.close()
        self._flush()
        self._sums()

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            at = self.open[-1][1]
            self.segments.append((at, text))
            node = self.nodes[at]
            node.text += len(text)
            node.linked += min(self.linked, len(text))
            node.words += text.count(" ") + 1
            node.marks += sum(map(text.count, ".,;:!?"))
        self.buffer, self.linked = [], 0

    def _pop(self, to: int) -> None:
        self._flush()
        for tag, _ in self.open[to:]:
            self.places[tag].pop()
        del self.open[to:]
        for places in (self.scopes, self.boxes):
            while places and places[-1] >= to:
                places.pop()
        self.muted.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag in ("br", "wbr", "img"):
                self.buffer.append(" " if tag == "br" else "")
            return
        if tag in INLINE:
            self.links += tag == "a"
            if tag in self.muted or not self.muted and not shown(attrs):
                self.muted.append(tag)
            return
        self._flush()
        within = self.scopes if tag in ITEMS else self.boxes
        while ends := max((self.places[held][-1] for held in ENDED_BY.get(tag, ()) if self.places.get(held)), default=0):
            if within and ends < within[-1]:
                break
            self._pop(ends)
        parent = self.open[-1][1]
        up = self.nodes[parent]
        node = Node(tag, parent, up.depth + 1, *tokens_of(attrs), up.hidden or tag in HIDDEN or not shown(attrs))
        up.children.append(len(self.nodes))
        place = len(self.open)
        self.places.setdefault(tag, []).append(place)
        if tag in SCOPES:
            self.scopes.append(place)
            if tag not in LISTS:
                self.boxes.append(place)
        self.open.append((tag, len(self.nodes)))
        self.nodes.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and (tag in ("svg", "math") or self.places.get("svg") or self.places.get("math")):
            self.handle_endtag(tag)  # elsewhere the slash has no meaning

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.links -= tag == "a" and self.links > 0
            if tag in self.muted:
                self.muted.pop()
            return
        if self.places.get(tag):
            self._pop(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.muted and not self.nodes[self.open[-1][1]].hidden:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data)

    def _sums(self) -> None:
        before = 0
        sums = {}
        for at, text in self.segments:
            sums.setdefault(at, before)
            before += len(text)
        for k in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[k]
            node.below = 1 + sum(self.nodes[c].below for c in node.children)
            node.last = k + node.below  # nodes are in page order, so a subtree is a range

    def features(self) -> np.ndarray:
        nodes, n = self.nodes, len(self.nodes)
        own = np.array([(x.text, x.linked, x.words, x.marks, x.tag == "p", x.tag in ("li", "a"), x.tag == "form" or x.tag in ("button", "fieldset")) for x in nodes], float)
        ends = np.array([x.last for x in nodes])
        sums = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, 0)])
        tree = sums[ends] - sums[np.arange(n)]
        whole, before = max(1.0, tree[0, 0]), sums[:-1, 0]
        up = np.array([max(0, x.parent) for x in nodes])
        group = np.zeros((n, len(GROUPS) + 1))
        group[np.arange(n), [_GROUP.get(x.tag, len(GROUPS)) for x in nodes]] = 1
        above = np.zeros_like(group)
        marks = np.array([(x.good, x.bad, x.mentions) for x in nodes], float)
        good_bad = np.zeros((n, 3))
        place = np.zeros((n, 3))
        for k in range(1, n):
            p = nodes[k].parent
            above[k] = np.maximum(above[p], group[p])
            good_bad[k] = good_bad[p] + marks[p]
        for x in nodes:
            same = {}
            for i, c in enumerate(x.children):
                tag = nodes[c].tag
                same[tag] = same.get(tag, 0) + 1
                place[c, 0], place[c, 1] = i / len(x.children), len(x.children)
            for c in x.children:
                place[c, 2] = same[nodes[c].tag]
        safe = np.maximum(1.0, tree[:, 0])
        more = np.column_stack(
            [
                np.log1p(tree[:, 0]), np.log1p(own[:, 0]), tree[:, 1] / safe, tree[:, 3] / np.maximum(1.0, tree[:, 2]), tree[:, 0] / (ends - np.arange(n)), tree[:, 0] / whole, before / whole,
                [x.depth for x in nodes], np.log1p(ends - np.arange(n)), tree[:, 4], tree[:, 5], tree[:, 6], tree[:, 0] / np.maximum(1.0, tree[up, 0]), place,
            ]
        )
        apart = np.maximum(group, above)[:, _ASIDE].max(1)  # in or below an element whose name says that it isn't the article
        return np.column_stack([group, above, apart, marks, good_bad, more])

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The likeliest labels in which no node is main text below one that isn't."""
        p = np.clip(p, 1e-6, 1 - 1e-6)
        out = np.log1p(-p)
        sums = np.concatenate([[0.0], np.cumsum(out)])
        best, keep = np.zeros(len(p)), np.zeros(len(p), bool)
        for k in range(len(p) - 1, -1, -1):
            inside = np.log(p[k]) + sum(best[c] for c in self.nodes[k].children)
            outside = sums[self.nodes[k].last] - sums[k]
            keep[k], best[k] = inside > outside, max(inside, outside)
        for k in range(1, len(p)):
            keep[k] &= keep[self.nodes[k].parent]
        return keep

    def text(self, keep: np.ndarray) -> str:
        return "\n".join(t for at, t in self.segments if keep[at])
