"""Block trees of HTML pages, and features of their nodes.

A node is a block element, or a run of inline content between two block borders (a text leaf). Inline
elements only add to the counts of the leaf they stand in.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Element kinds.
RAW = frozenset(["script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes"])
SKIPPED = RAW | {"select", "button", "option", "object", "canvas", "audio", "video", "head"}
VOID = frozenset(["br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"])
BLOCK = frozenset(["html", "body", "article", "section", "main", "nav", "header", "footer", "aside", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "dialog", "center", "hgroup", "menu", "search"])
CLOSES_P = BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
#: Elements that a start tag closes, and those beyond which it does not look.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"})}
CLOSED_BY = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}
#: Attribute tokens are told apart by so many hash values.
BUCKETS = 4096
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
KINDS = ["article", "main", "section", "div", "p", "h", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "#text"]


class Node:
    """mates: for each rule of ``CLOSES`` the outermost element that its start tags would close; paragraph: the paragraph that a block would close."""

    __slots__ = ("tag", "parent", "children", "tokens", "depth", "text", "links", "inline", "inputs", "order", "mates", "paragraph")

    def __init__(self, tag: str, parent: Node | None, tokens: list[int]):
        self.tag, self.parent, self.tokens, self.children = tag, parent, tokens, []
        self.depth = parent.depth + 1 if parent else 0
        self.text, self.links, self.inline, self.inputs = "", 0, 0, 0
        self.mates, self.paragraph = _NO_MATES, None
        if parent:
            parent.children.append(self)
            if tag == "p":
                self.paragraph = self
            elif tag in HEADINGS:
                self.paragraph = parent.paragraph
            if tag in _RULED or parent.mates is not _NO_MATES:
                self.mates = tuple(None if tag in stop else parent.mates[k] or (self if tag in mates else None) for k, (mates, stop) in enumerate(CLOSES.values()))


_NO_MATES = (None,) * len(CLOSES)
_RULED = frozenset().union(*(mates for mates, _ in CLOSES.values()))
_hashes: dict[str, int] = {}


def bucket(token: str) -> int:
    if len(_hashes) > 100_000:
        _hashes.clear()
    if token not in _hashes:
        _hashes[token] = zlib.crc32(token.encode()) % BUCKETS
    return _hashes[token]


def parse(page: str) -> Node:
    """The block tree; unclosed, misnested and cut-off markup is tolerated, elements of no text are left out.

    Time is linear in the page: an element is left once, and what a tag closes is known at each element.
    """
    root = node = Node("#root", None, [])
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    links = inline = skipped = link_depth = 0
    skip_tag = ""
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal links, inline
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            leaf = Node("#text", node, [])
            leaf.text, leaf.links, leaf.inline = text, min(links, len(text)), inline
        pieces.clear()
        links = inline = 0

    def leave(until: Callable[[Node], bool]) -> None:
        """Close elements from the innermost out, up to the first one that ``until`` names."""
        nonlocal node
        flush()
        while node is not root:
            left, node = node, node.parent
            opened[left.tag] -= 1
            if until(left):
                break

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            if not skipped:
                pieces.append(page[at:])
            break
        if m.start() > at and not skipped:
            pieces.append(page[at : m.start()])
            if link_depth:
                links += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if skipped:
                if tag == skip_tag:
                    skipped -= 1
            elif tag == "a":
                link_depth = 0
            elif tag in BLOCK:
                if opened[tag]:
                    leave(lambda x: x.tag == tag)
                else:
                    flush()
                link_depth = 0
            continue
        if skipped:
            skipped += tag == skip_tag and tag not in VOID
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
            continue
        if tag in SKIPPED:
            skip_tag, skipped = tag, 1
            if tag == "head":  # an unclosed head ends where the body begins
                close = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                at, skipped = (close.start() if close else at), 0
            continue
        if tag == "br" or tag == "hr":
            pieces.append(" ")
            if tag == "hr":
                flush()
        elif tag == "input":
            node.inputs += 1
        elif tag == "a":
            link_depth = 1
            inline += 1
        elif tag in BLOCK:
            flush()
            link_depth = 0
            if tag in CLOSES_P and (target := node.paragraph):
                leave(lambda x: x is target)
            if tag in CLOSED_BY and (target := node.mates[CLOSED_BY[tag]]):
                leave(lambda x: x is target)
            tokens = [bucket(t.lower()) for a in _ATTR.finditer(m[3]) for t in _TOKEN.findall(a[2] or a[3] or a[4] or "")] if "=" in m[3] else []
            node = Node(tag, node, tokens)
            opened[tag] += 1
        else:
            inline += 1
    flush()
    return root


def walk(root: Node) -> list[Node]:
    """Nodes in page order, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.order = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def token_weights(pages: list[list[Node]], labels: list[np.ndarray], least: int = 4) -> np.ndarray:
    """Log-odds of each attribute token's hash that its element holds main text; 0 for hashes of fewer than ``least`` elements."""
    main, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for nodes, y in zip(pages, labels, strict=True):
        for x in nodes:
            for t in set(x.tokens):
                (main if y[x.order] else other)[t] += 1
    return np.where(main + other >= least, np.log((main + 0.5) / (other + 0.5)), 0.0)


def features(nodes: list[Node], weights: np.ndarray) -> np.ndarray:
    """A row for each node: own, inherited and inner attribute tokens, subtree counts and densities, depth, siblings."""
    n = len(nodes)
    chars, links, marks, tags, leaves, heads, items, paras, inputs = (np.zeros(n) for _ in range(9))
    best, worst, up_best, up_worst = (np.zeros(n) for _ in range(4))
    for i, x in enumerate(nodes):
        if x.tag == "#text":
            chars[i], links[i], leaves[i], tags[i] = len(x.text), x.links, 1, x.inline
            marks[i] = sum(map(x.text.count, ".,;!?"))
        else:
            tags[i], heads[i], items[i], paras[i], inputs[i] = 1, x.tag in HEADINGS, x.tag == "li", x.tag == "p", x.inputs
        if x.tokens:
            w = weights[x.tokens]
            best[i], worst[i] = max(w.max(), 0), min(w.min(), 0)
        if x.parent is not None:
            p = x.parent.order
            up_best[i], up_worst[i] = max(up_best[p], best[p]), min(up_worst[p], worst[p])
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.order
        for a in (chars, links, marks, tags, leaves, heads, items, paras, inputs):
            a[p] += a[i]
    total = max(chars[0], 1)
    index, mates, same, mean, before, in_best, in_worst = (np.zeros(n) for _ in range(7))
    for x in nodes:
        k = len(x.children)
        if k:
            sizes = sum(chars[c.order] for c in x.children)
            names = [c.tag for c in x.children]
            for j, c in enumerate(x.children):
                i = c.order
                index[i], mates[i], mean[i] = j / k, k, sizes / k
                before[i] = chars[x.children[j - 1].order] if j else -1
            counts = Counter(names)
            for c in x.children:
                same[c.order] = counts[c.tag] / k
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.order
        in_best[p], in_worst[p] = max(in_best[p], in_best[i], best[i]), min(in_worst[p], in_worst[i], worst[i])
    kind = np.zeros((n, len(KINDS)))
    place = {k: j for j, k in enumerate(KINDS)}
    for i, x in enumerate(nodes):
        t = "h" if x.tag in HEADINGS else "li" if x.tag in ("dt", "dd") else "table" if x.tag in ("td", "th", "tr") else x.tag
        if t in place:
            kind[i, place[t]] = 1
    parent = kind[[x.parent.order if x.parent else 0 for x in nodes]]
    in_kinds = np.zeros((n, len(KINDS)))
    for x in nodes[1:]:
        in_kinds[x.order] = in_kinds[x.parent.order] + kind[x.parent.order]
    depth = np.array([x.depth for x in nodes])
    at = np.concatenate(([0], np.cumsum([len(x.text) for x in nodes])))[:-1] / total
    per = np.maximum(chars, 1)
    return np.column_stack([chars, chars / total, links / per, marks / per * 100, chars / np.maximum(tags, 1), leaves, heads, items, paras, inputs, best, worst, up_best, up_worst, in_best, in_worst, depth, index, mates, same, mean, before, at, kind, parent, in_kinds])
