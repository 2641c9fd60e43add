"""A small DOM: block elements of a page, their texts, and features of each element."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

#: A tag ends before the next ``<`` outside quotes, or is none; so no part of a page is read more than a few times.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template iframe object svg math textarea select title head audio video canvas".split())
RAW = set("script style textarea title iframe noscript template".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var acronym wbr img".split()
)
#: Start tags that end an open element of the named kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An element of these kinds keeps ``ENDS`` from reaching further up.
SCOPES = {"ul", "ol", "dl", "table", "body", "html", "div", "article", "section", "main", "td"}
GROUPS = ("article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "p", "h", "list", "li", "table", "quote", "body", "button", "figure", "pre")
GROUP_OF = {f"h{i}": "h" for i in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "dd": "li", "dt": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "html": "body", "figcaption": "figure", "fieldset": "form"}
BUCKETS = 32
NUMERIC = ("depth", "place", "siblings", "same_tag_siblings", "text", "text_share", "sibling_text_share", "tags_per_text", "link_share", "stops_per_text", "words_per_block", "paragraphs", "own_text", "children", "page_place")
N_FEATURES = len(GROUPS) + BUCKETS + len(NUMERIC)


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "own", "link", "stops", "words", "blocks", "tags", "size", "paragraphs", "depth", "all_link", "all_stops", "all_words", "all_blocks", "begin")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None):
        self.tag, self.tokens, self.parent, self.children = tag, tokens, parent, []
        self.own = self.link = self.stops = self.words = self.blocks = self.tags = 0
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block elements in page order, the root first; blocks of text as (element's number, text)).

    Inline elements don't end a block of text; unseen elements, comments and markup have no text. The time grows in line with the page,
    however deep or broken its markup is: open elements are found by their kind, not by a search.
    """
    root = Node("html", [], None)
    root.begin = 0
    nodes, blocks = [root], []
    # open elements, inline ones with their block's number; an inline one that ended below others leaves a nameless place
    stack: list[tuple[str, int]] = [("html", 0)]
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by kind
    buffer: list[tuple[str, bool]] = []
    links = hidden = 0
    raw_end: re.Pattern | None = None

    def flush():
        if not buffer:
            return
        text = " ".join(html.unescape("".join(t for t, _ in buffer)).split())
        if text:
            at = stack[-1][1]
            node = nodes[at]
            blocks.append((at, text))
            node.own += len(text)
            node.link += min(len(text), sum(len(t) for t, inside in buffer if inside))
            node.stops += sum(map(text.count, ".,;:!?"))
            node.words += text.count(" ") + 1
            node.blocks += 1
        buffer.clear()

    def close(k: int):
        nonlocal links, hidden
        flush()
        for tag, _ in stack[k:]:
            if tag:
                places[tag].pop()
            links -= tag == "a"
            hidden -= tag in UNSEEN
        del stack[k:]

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at = 0
    size = len(page)
    while at < size:
        if raw_end is not None:
            m = raw_end.search(page, at)
            raw_end = None
            at = m.start() if m else size
            continue
        m = TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at and not hidden:
            buffer.append((page[at:stop], links > 0))
        if m is None:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            k = nearest((tag,))
            if k:
                if tag in INLINE:
                    links -= tag == "a"
                    places[tag].pop()
                    stack[k] = ("", stack[k][1])
                    while not stack[-1][0]:
                        stack.pop()
                else:
                    close(k)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                if not hidden:
                    buffer.append((" ", False))
            elif tag == "hr":
                flush()
            nodes[stack[-1][1]].tags += 1
            continue
        if tag == "html" or tag == "body" and places["body"]:
            continue
        if tag in INLINE:
            nodes[stack[-1][1]].tags += 1
            places[tag].append(len(stack))
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
            continue
        flush()
        if tag == "body":
            if places["head"]:
                close(places["head"][0])
        k = nearest(("p",))
        if k:
            close(k)
        if tag in ENDS:
            k = nearest(ENDS[tag])
            if k > nearest(SCOPES - ENDS[tag]):
                close(k)
        tokens = TOKEN.findall(" ".join(a or b or c for a, b, c in ATTRIBUTE.findall(m.group(3))).lower()) if m.group(3) else []
        parent = nodes[stack[-1][1]]
        node = Node(tag, tokens, parent)
        node.begin = len(blocks)
        parent.children.append(len(nodes))
        places[tag].append(len(stack))
        stack.append((tag, len(nodes)))
        nodes.append(node)
        if tag in UNSEEN:
            hidden += 1
            if tag in RAW:
                raw_end = re.compile(rf"</{re.escape(tag)}\b", re.I)
        if m.group(3).endswith("/") and tag in ("svg", "math"):
            close(len(stack) - 1)
    stack[-1:] = stack[-1:]
    flush()
    return nodes, blocks


def features(nodes: list[Node], n_blocks: int, plain: bool = False) -> np.ndarray:
    """A row per element. ``plain``: as if all tags but paragraphs and lists were divisions without attributes."""
    for node in reversed(nodes):
        node.size, node.paragraphs = node.own, int(node.tag == "p")
        node.all_link, node.all_stops, node.all_words, node.all_blocks = node.link, node.stops, node.words, node.blocks
        node.tags += len(node.children)
        for c in node.children:
            x = nodes[c]
            node.size += x.size
            node.tags += x.tags
            node.paragraphs += x.paragraphs
            node.all_link += x.all_link
            node.all_stops += x.all_stops
            node.all_words += x.all_words
            node.all_blocks += x.all_blocks
    total = max(1, nodes[0].size)
    out = np.zeros((len(nodes), N_FEATURES))
    base = len(GROUPS) + BUCKETS
    place, same = np.zeros(len(nodes)), np.ones(len(nodes), int)
    for node in nodes:
        tags = Counter(nodes[c].tag for c in node.children)
        for k, c in enumerate(node.children):
            place[c], same[c] = k / len(node.children), tags[nodes[c].tag]
    for i, node in enumerate(nodes):
        group = GROUP_OF.get(node.tag, node.tag)
        if plain and group not in ("p", "h", "list", "li", "body", "table"):
            group = "div"
        if group in GROUPS:
            out[i, GROUPS.index(group)] = 1
        if not plain:
            for t in node.tokens:
                out[i, len(GROUPS) + zlib.crc32(t.encode()) % BUCKETS] = 1
        p = node.parent
        out[i, base:] = (
            node.depth,
            place[i],
            len(p.children) if p else 1,
            same[i],
            np.log1p(node.size),
            node.size / total,
            node.size / max(1, p.size) if p else 1,
            node.tags / (1 + node.size),
            node.all_link / (1 + node.size),
            node.all_stops / (1 + node.size),
            node.all_words / max(1, node.all_blocks),
            node.paragraphs,
            np.log1p(node.own),
            len(node.children),
            node.begin / max(1, n_blocks),
        )
    return out


#: Elements and attribute tokens that mark what isn't the article, for the training labels.
BOILER_TAGS = set("nav header footer aside form button head script style".split())
BOILER_TOKENS = set("ad ads advert advertisement banner breadcrumb comment comments cookie consent disqus footer header menu nav navbar newsletter notice popup promo related share sidebar social sponsored subscribe widget".split())


def weak_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 inside an article or main element, 0 outside and in marked parts; None for a page without one."""
    if not any(n.tag in ("article", "main") for n in nodes):
        return None
    y = np.zeros(len(nodes), int)
    number = {id(n): i for i, n in enumerate(nodes)}
    for i, n in enumerate(nodes):
        up = number[id(n.parent)] if n.parent else None
        inside = n.tag in ("article", "main") or (up is not None and y[up] == 1)
        marked = (n.tag in BOILER_TAGS and not (n.tag == "header" and inside)) or bool(BOILER_TOKENS & set(n.tokens))
        y[i] = int(inside and not marked)
    return y


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Which elements are kept: the likeliest labelling in which every path from the root goes outside, article, rejected.

    An element may enter the article or stay outside; below the article, an element may be
    rejected, and nothing below that is kept. So no kept element lies in a rejected one,
    and the choice of an element and of those below it can't contradict.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.array([1.0 + np.log1p(n.own) for n in nodes])
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    best = np.zeros((len(nodes), 3))
    for i in range(len(nodes) - 1, -1, -1):
        best[i] = no[i], yes[i], no[i]
        for c in nodes[i].children:
            best[i, 0] += max(best[c, 0], best[c, 1])
            best[i, 1] += max(best[c, 1], best[c, 2])
            best[i, 2] += best[c, 2]
    state = np.zeros(len(nodes), int)
    state[0] = int(best[0, 1] > best[0, 0])
    for i, n in enumerate(nodes):
        for c in n.children:
            s = state[i]
            state[c] = s if s == 2 else s + int(best[c, s + 1] > best[c, s])
    return state == 1
