"""Main text of web pages by wrappers: union-free regular expressions over the elements of a host's pages.

Every page is read as a tree whose inner nodes are block elements and whose leaves are text slots. The children of a
node are a stream of tokens; a stream is a regular expression of items, each of them optional, repeated or both, and never
a choice. A page begins as its own wrapper: equal neighbours and equal runs fold into repeated groups. Two
wrappers of one host are aligned level by level: their longest common sequence of tokens is kept, a token or run that one
side lacks becomes optional, one that recurs becomes a repeated group, and two different texts in one place leave a
slot, while a text that is the same on all pages is known as part of the frame. A stream that grows too wide is
generalised to a repeated group of optional items, so wrappers stay small whatever the pages are.

Tasks align pages of equal structure as they read them, then a host's different structures are aligned in pieces of
bounded size, and the wrappers of the pieces among themselves until one is left. From it follows where the
article stands; only that, a few label paths, is joined back to the pages, which are read a second time.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import discard, spread_rows, written
from tracegrain.operators.tables import Table, lookup_join

# Items of a stream before it is generalised; longest run that is sought as a repeated group.
WIDTH = 48
PERIOD = 6
# Elements nested deeper are not told apart from what they stand in; their text stays.
DEPTH = 60
# Structures that one task aligns, wrappers that are aligned in a later level, structures a task holds.
PIECE = 2_048
FAN_IN = 128
HELD = 20_000
# Pages of a host from which a text that they all share counts as frame.
FRAME_PAGES = 3
# Share of a node's text that makes a child the next step towards the article.
DOMINANT = 0.7

# Element names of HTML by their role, and the words by which pages name their parts.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var".split()
)
VOID = set("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe noframes noembed object svg math canvas audio video xmp select".split())
NO_P_CLOSE = INLINE | VOID | RAW | {"html", "head", "body", "button"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
FRAME_TAGS = {"nav", "footer", "aside", "menu", "dialog", "button", "head"}
LOOSE_TAGS = {"form", "header", "fieldset"}
COMMENT_WORDS = set("comment comments commentlist disqus respond".split())
FRAME_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal overlay share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login search widget widgets toolbar pagination pager".split()
)
FRAME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ODD = re.compile(r"[^a-z0-9:_-]+")
_NUMBER = re.compile(r"\d\d+|[^A-Za-z0-9_-]+")  # numbers of rows and pages, and what labels cannot hold
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}

# Marks in labels: always frame, frame unless it holds the article.
STRONG, WEAK = "!", "-"
MARKS = STRONG + WEAK
SLOT = "#"
# Ends the label of elements of one name and any class.
ANY = ".~"


class Node:
    """An element or a text slot of a page or a wrapper.

    ``items`` is the stream of an element. A slot has the number of its characters outside links, those inside, and the
    name of its text (0: several texts).
    """

    __slots__ = ("chars", "items", "label", "links", "text")

    def __init__(self, label: str, items: list[Item] | None = None, chars: int = 0, links: int = 0, text: int | str = 0):
        self.label, self.items, self.chars, self.links, self.text = label, items if items is not None else [], chars, links, text


class Item:
    """One or several nodes of a stream; several ones are a repeated group in which each may be missing."""

    __slots__ = ("nodes", "optional", "repeated")

    def __init__(self, nodes: list[Node], optional: bool = False, repeated: bool = False):
        self.nodes, self.optional, self.repeated = nodes, optional, repeated

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(n.label for n in self.nodes)


# ---- pages


def _label(tag: str, attributes: str) -> str:
    """The token of an element: its name, its first class or id without numbers, and a mark if it looks like frame."""
    mark, own = (STRONG if tag in FRAME_TAGS else WEAK if tag in LOOSE_TAGS else ""), ""
    if attributes.strip():
        found = {}
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), "".join(values))
        named = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in _WORD.findall(named)}
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if hidden or words & COMMENT_WORDS and tag not in ("html", "body", "main"):
            mark = STRONG
        elif not mark and tag not in ("html", "body", "main", "article") and (words & FRAME_WORDS or found.get("role", "").lower() in FRAME_ROLES):
            mark = WEAK
        if found.get("role") == "main" and not mark:
            tag = "main"
        if "articleBody" in found.get("itemprop", "") and not mark:
            tag = "article"
        own = _NUMBER.sub("", named.split()[0]) if named.strip() else ""
    return mark + tag + ("." + own if own and tag not in ("html", "body", "main", "article") else "")


def _tag(label: str) -> str:
    return label.lstrip(MARKS).split(".")[0]


class _Builder:
    """Builds the tree of one page from its tags and texts."""

    def __init__(self):
        self.root = Node("page")
        self.nodes = [self.root]
        # Open elements: name, its node (None if it is not told apart), and for marked inline elements the text around them.
        self.stack: list[tuple[str, Node | None, tuple | None]] = []
        self.opened: Counter[str] = Counter()
        self.text: list[str] = []
        self.in_link = self.linked = 0

    def data(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.text.append(text)
        if self.in_link:
            self.linked += len(text.strip())

    def flush(self) -> None:
        """Ends a block: its text becomes a slot."""
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                links = min(self.linked, len(text))
                self.nodes[-1].items.append(Item([Node(SLOT, [], len(text) - links, links, text)]))
            self.text, self.linked = [], 0

    def push(self, tag: str, node: Node | None, around: tuple | None = None) -> None:
        self.stack.append((tag, node, around))
        self.opened[tag] += 1
        if node is not None:
            self.nodes.append(node)

    def pop(self, at: int) -> None:
        """Closes all open elements from place ``at`` on."""
        while len(self.stack) > at:
            tag, node, around = self.stack[-1]
            if tag not in INLINE:
                self.flush()
            elif around:  # what a marked inline element holds is frame
                self.text, self.linked = around
            self.stack.pop()
            self.opened[tag] -= 1
            if node is not None:
                self.nodes.pop()

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag in INLINE:
            self.in_link += tag == "a"
            label = _label(tag, attributes) if attributes and tag != "a" else tag
            if label[0] in MARKS and len(self.nodes) <= DEPTH:
                self.push(tag, Node(label), (self.text, self.linked))
                self.text, self.linked = [], 0
            elif self.opened[tag]:
                self.push(tag, None)  # keeps the ends of nested ones apart
        elif tag in VOID:
            if tag == "hr":
                self.flush()
        else:
            self.open_block(tag, attributes)

    def open_block(self, tag: str, attributes: str) -> None:
        if self.opened["head"]:
            self.close_to({"head"}, set())
        if tag not in NO_P_CLOSE:
            self.close_to({"p"}, {"button", "table", "td", "th"})
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        self.flush()
        self.in_link = 0
        if tag in ("html", "body") and self.opened[tag]:
            return
        label = _label(tag, attributes)
        if len(self.nodes) > DEPTH + (label[0] in MARKS):
            self.push(tag, None)
            return
        node = Node(label)
        self.nodes[-1].items.append(Item([node]))
        self.push(tag, node)

    def close_to(self, names: set[str], stop: set[str]) -> None:
        """Closes the open elements from the outermost of ``names`` on that lies inside the nearest of ``stop``."""
        if not any(self.opened[name] for name in names):
            return
        at = None
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                at = k
            elif name in stop:
                break
        if at is not None:
            self.pop(at)

    def close(self, tag: str) -> None:
        inline = tag in INLINE
        self.in_link = max(0, self.in_link - (tag == "a"))
        if self.opened[tag] and tag not in ("html", "body"):
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name == tag:
                    self.pop(k)
                    return
                if inline and name not in INLINE or name in ("td", "th") and tag not in CLOSES and tag != "table":
                    break
        if not inline:
            self.flush()


def page_tree(html: str | None) -> Node:
    """The tree of a page; never fails, whatever the markup."""
    page, start, html = _Builder(), 0, html or ""
    while match := _TOKEN.search(html, start):
        if match.start() > start:
            page.data(html[start : match.start()])
        start = match.end()
        ending, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if name is None:
            continue
        tag = _ODD.sub("", name.lower())
        if ending:
            page.close(tag)
        elif tag in RAW:
            if not (tag in ("svg", "math") and attributes.endswith("/")):
                end = _RAW_END[tag].search(html, start)
                start = end.end() if end else len(html)
        else:
            page.open(tag, attributes)
    page.data(html[start:])
    page.pop(0)
    page.flush()
    return page.root


# ---- wrappers


def _name(text: str) -> int:
    """A text in one number that is never 0."""
    return xxhash.xxh64_intdigest(text.encode()) >> 1 or 1


def fold(node: Node) -> Node:
    """A page's own wrapper: its repeated groups folded, its texts replaced by their names."""
    if node.label == SLOT:
        return Node(SLOT, [], node.chars, node.links, _name(node.text))
    return Node(node.label, _folded([Item([fold(n) for n in item.nodes]) for item in node.items]))


def _folded(items: list[Item]) -> list[Item]:
    """Equal neighbours become one repeated item, equal neighbouring runs one repeated group."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].key == item.key:
            out[-1] = Item(_merged_nodes(out[-1].nodes, item.nodes), out[-1].optional and item.optional, True)
        else:
            out.append(item)
    for period in range(2, PERIOD + 1):
        at = 0
        while at + 2 * period <= len(out):
            run = [x.key for x in out[at : at + period]]
            end = at + period
            while [x.key for x in out[end : end + period]] == run:
                end += period
            if end > at + period and all(len(k) == 1 for k in run) and len(set(run)) == period:
                nodes = [x.nodes[0] for x in out[at : at + period]]
                for k in range(at + period, end):
                    nodes[(k - at) % period] = merged(nodes[(k - at) % period], out[k].nodes[0])
                out[at:end] = [_group(nodes)]
            at += 1
    return _generalised(out) if len(out) > WIDTH else out


def _group(nodes: list[Node]) -> Item:
    """A repeated group; any of its elements may be missing, so their order does not matter."""
    return Item(sorted(nodes, key=lambda n: n.label), True, True)


def _generalised(items: list[Item]) -> list[Item]:
    """One repeated group of optional items; with too many labels, of elements without their classes."""
    nodes: dict[str, Node] = {}
    every = [n for item in items for n in item.nodes]
    bare = len({n.label for n in every}) > WIDTH
    for n in every:
        label = n.label.split(".")[0] + ANY if bare and n.label != SLOT else n.label
        n = Node(label, n.items, n.chars, n.links, n.text)
        nodes[label] = merged(nodes[label], n) if label in nodes else n
    return [_group(list(nodes.values()))]


def _merged_nodes(a: list[Node], b: list[Node]) -> list[Node]:
    return [merged(x, y) for x, y in zip(a, b)]


def merged(a: Node, b: Node) -> Node:
    """The wrapper of what either of two wrappers with one label stands for."""
    if a.label == SLOT:
        return Node(SLOT, [], a.chars + b.chars, a.links + b.links, a.text if a.text == b.text else 0)
    if [x.key for x in a.items] == [x.key for x in b.items]:
        items = [Item(_merged_nodes(x.nodes, y.nodes), x.optional or y.optional, x.repeated or y.repeated) for x, y in zip(a.items, b.items)]
        return Node(a.label, items)
    left, right = _rolled(a.items, b.items), _rolled(b.items, a.items)
    return Node(a.label, _folded(_aligned(left, right)))


def _rolled(items: list[Item], other: list[Item]) -> list[Item]:
    """Runs of items made of the elements of a repeated group of the other side become that group."""
    for group in (x for x in other if len(x.nodes) > 1):
        labels, out, k = set(group.key), [], 0
        while k < len(items):
            end = k
            while end < len(items) and labels.issuperset(items[end].key):
                end += 1
            if end - k > 1 or end > k and (len(items[k].nodes) > 1 or not any(x.key == items[k].key for x in other)):
                nodes: dict[str, Node] = {}
                for n in (n for x in items[k:end] for n in x.nodes):
                    nodes[n.label] = merged(nodes[n.label], n) if n.label in nodes else n
                out.append(_group([nodes.get(label) or Node(label) for label in group.key]))
                k = end
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def _aligned(a: list[Item], b: list[Item]) -> list[Item]:
    """The longest common sequence of both streams, and what only one of them has as optional items."""
    left, right = [x.key for x in a], [x.key for x in b]
    length = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32).tolist()
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if left[i] == right[j] else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and left[i] == right[j]:
            out.append(Item(_merged_nodes(a[i].nodes, b[j].nodes), a[i].optional or b[j].optional, a[i].repeated or b[j].repeated))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and length[i + 1][j] >= length[i][j + 1]:
            out.append(Item(a[i].nodes, True, a[i].repeated))
            i += 1
        else:
            out.append(Item(b[j].nodes, True, b[j].repeated))
            j += 1
    return out


def structure(node: Node, facts: list[int]) -> str:
    """The regular expression of a wrapper as text; the facts of its slots are appended in order."""
    if node.label == SLOT:
        facts += (node.chars, node.links, node.text)
        return SLOT
    parts = []
    for item in node.items:
        inner = " ".join([structure(n, facts) for n in item.nodes])
        parts.append(f"({inner})*" if len(item.nodes) > 1 else inner + ("", "?", "+", "*")[item.optional + 2 * item.repeated])
    return f"{node.label}[{' '.join(parts)}]" if parts else node.label


_PART = re.compile(r"[^\s\[\]()?+*]+|[\[\]()?+*]")


def parsed(text: str, facts: list[int]) -> Node:
    """The wrapper that ``structure`` has written."""
    root, values = Node("page"), iter(facts)
    stack: list[list[Item]] = [[]]
    groups: list[int] = []
    for part in _PART.findall(text):
        if part == "[":
            stack.append([])
        elif part == "]":
            inner = stack.pop()
            stack[-1][-1].nodes[-1].items = inner
        elif part == "(":
            groups.append(len(stack[-1]))
        elif part == ")":
            at = groups.pop()
            stack[-1][at:] = [Item([n for x in stack[-1][at:] for n in x.nodes], True, True)]
        elif part in "?+*":
            last = stack[-1][-1]
            last.optional, last.repeated = part in "?*", part in "+*"
        else:
            node = Node(SLOT, [], next(values), next(values), next(values)) if part == SLOT else Node(part)
            stack[-1].append(Item([node]))
    return stack[0][0].nodes[0] if stack[0] else root


# ---- the article


def _holds_article(node: Node) -> bool:
    if node.label[0] == STRONG or node.label == SLOT:
        return False
    if node.label in ("article", "main") or _tag(node.label) == "h1" and node.label[0] != WEAK:
        return True
    return any(_holds_article(n) for item in node.items for n in item.nodes)


def is_frame(node: Node) -> bool:
    return node.label[0] == STRONG or node.label[0] == WEAK and not _holds_article(node)


def _mass(node: Node, frame_texts: bool) -> int:
    """Characters of a wrapper that may belong to the article; text in links counts against it."""
    if node.label == SLOT:
        return 0 if frame_texts and node.text else node.chars - node.links
    return 0 if is_frame(node) else max(0, sum(_mass(n, frame_texts) for item in node.items for n in item.nodes))


def _named(node: Node, label: str, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Node]]:
    """Outermost elements of a label, outside the frame, with their paths."""
    path = (*path, node.label)
    if node.label == label:
        yield path, node
    elif not is_frame(node):
        for item in node.items:
            for n in item.nodes:
                yield from _named(n, label, path)


def guide(wrapper: Node, pages: int) -> dict[str, list]:
    """Where the article stands on the pages of a wrapper.

    ``at`` is the path of labels to it. An element named so in the markup wins: the ``article`` with most text if it
    holds half of what ``main`` does, else ``main``. Without either, the path goes down from the root as long as one child
    has most of the text outside the frame and leaves no headline behind; then ``frame`` names the texts that
    all pages share and ``menus`` the paths of lists that are mostly links.
    """
    whole = max((_mass(n, False) for _, n in _named(wrapper, "main")), default=0)
    for label, least in (("article", whole / 2), ("main", 0)):
        found = [(_mass(n, False), path) for path, n in _named(wrapper, label)]
        if found and (best := max(found, key=lambda x: x[0]))[0] >= least:
            return {"at": list(best[1]), "named": True, "frame": [], "menus": []}
    frame = pages >= FRAME_PAGES and _mass(wrapper, True) > 0
    node, path = wrapper, [wrapper.label]
    while True:
        inner = [n for item in node.items for n in item.nodes if n.label != SLOT and not is_frame(n)]
        mass = [_mass(n, frame) for n in inner]
        if not inner or max(mass) < DOMINANT * _mass(node, frame) or not max(mass):
            break
        best = mass.index(max(mass))
        rest = [n for k, n in enumerate(inner) if k != best]
        if _tag(inner[best].label) in ("p", "h1", "pre", "blockquote") or any(_holds_article(n) for n in rest):
            break
        node = inner[best]
        path.append(node.label)
    texts, menus = [], []

    def visit(n: Node, at: tuple[str, ...]) -> None:
        if n.label == SLOT:
            if frame and n.text:
                texts.append(n.text)
        elif not is_frame(n):
            slots = _slots(n)
            if _tag(n.label) in ("ul", "ol", "table", "div") and sum(s.links for s in slots) > sum(s.chars for s in slots):
                menus.append("/".join(at))
            for item in n.items:
                for c in item.nodes:
                    visit(c, (*at, c.label))

    visit(node, tuple(path))
    menus = [m for m in menus if m != "/".join(path)]
    return {"at": path, "named": False, "frame": sorted(set(texts)), "menus": menus}


def _slots(node: Node) -> list[Node]:
    return [node] if node.label == SLOT else [s for item in node.items for n in item.nodes for s in _slots(n)]


def _fits(label: str, wanted: str) -> bool:
    return label == wanted or wanted.endswith(ANY) and label.split(".")[0] == wanted[: -len(ANY)]


def blocks(page: Node, where: dict[str, list]) -> list[str] | None:
    """The texts of a page's article, block by block; None if the page has no such place."""
    found, out = False, []
    frame, menus = set(where["frame"]), [m.split("/") for m in where["menus"]]

    def descend(node: Node, depth: int) -> None:
        nonlocal found
        if depth == len(where["at"]):
            found = True
            collect(node, [node.label])
            return
        for item in node.items:
            for n in item.nodes:
                if n.label != SLOT and _fits(n.label, where["at"][depth]):
                    descend(n, depth + 1)

    def collect(node: Node, path: list[str]) -> None:
        if node.label == SLOT:
            if not frame or _name(node.text) not in frame:
                out.append(node.text)
            return
        # The header of an article belongs to it, that of a page does not.
        own_header = where["named"] and node.label[0] == WEAK and "header" in node.label.lower()
        if len(path) > 1 and is_frame(node) and not own_header:
            return
        if menus and any(len(m) == len(where["at"]) - 1 + len(path) and all(map(_fits, where["at"][:-1] + path, m)) for m in menus):
            return
        for item in node.items:
            for n in item.nodes:
                collect(n, [*path, n.label])

    if where["at"] and _fits(page.label, where["at"][0]):
        descend(page, 1)
    return out if found else None


def extracted(html: str | None, where: dict[str, list] | None) -> str:
    """The text of one page; where its host's place is missing, the page is its own wrapper."""
    page = page_tree(html)
    texts = blocks(page, where) if where else None
    return "\n".join(texts if texts is not None else blocks(page, guide(fold(page), 1)) or [])


# ---- tables


def _structures(slim: DataFrame) -> DataFrame:
    """host, structure, pages and the facts of the slots, added up for equal structures of a task."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        for batch in frames:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                facts: list[int] = []
                key = host, structure(fold(page_tree(html.as_py())), facts)
                known = held.get(key)
                if known is None:
                    held[key] = [1, facts]
                else:
                    known[0] += 1
                    _add(known[1], facts)
            if len(held) >= HELD:
                yield rows(held)
                held = {}
        yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        hosts, texts = ([k[i] for k in held] for i in (0, 1))
        return pa.RecordBatch.from_pydict(
            {
                "host": pa.array(hosts, pa.string()),
                "structure": pa.array(texts, pa.string()),
                "pages": pa.array([v[0] for v in held.values()], pa.int64()),
                "facts": pa.array([v[1] for v in held.values()], pa.list_(pa.int64())),
            }
        )

    return slim.mapInArrow(batches, _STRUCTURES)


_STRUCTURES = "host string, structure string, pages bigint, facts array<bigint>"


def _add(known: list[int], facts: list[int]) -> None:
    for k in range(0, len(facts), 3):
        known[k] += facts[k]
        known[k + 1] += facts[k + 1]
        if known[k + 2] != facts[k + 2]:
            known[k + 2] = 0


def _align_group(frame: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of a piece; in the order of the structures, so that the result does not depend on tasks."""
    frame = frame.sort_values("structure", kind="stable")
    root, pages = None, 0
    for text, n, facts in zip(frame["structure"], frame["pages"], frame["facts"]):
        node = parsed(text, [int(x) for x in facts])
        root, pages = node if root is None else merged(root, node), pages + int(n)
    facts: list[int] = []
    text = structure(root, facts)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "structure": [text], "pages": [pages], "facts": [facts]})


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", piece: int = PIECE, fan_in: int = FAN_IN) -> DataFrame:
    """One wrapper per host: host, structure (the regular expression), pages, facts of its slots."""
    host = F.coalesce(F.lower(F.regexp_extract(url_col, "^[^:/?#]*:?//([^/?#]*)", 1)), F.lit(""))
    rows = written(_structures(spread_rows(pages.select(host.alias("host"), F.col(html_col).alias("html")))), "structures")
    size = piece
    while True:
        counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("structure").alias("_n"))
        counts = written(counts, "structure-counts")
        if counts.filter("_rows > 1").isEmpty():
            discard(counts)
            return rows
        pieces = F.greatest(F.ceil(F.col("_n") / size), F.lit(1))
        known = Table(counts.select("host", pieces.alias("_pieces")))
        dealt = lookup_join(rows, known, ["host"], "inner").withColumn("_piece", F.pmod(F.xxhash64("structure"), "_pieces"))
        merged_rows = dealt.select("host", "structure", "pages", "facts", "_piece").groupBy("host", "_piece").applyInPandas(_align_group, _STRUCTURES)
        stored = written(merged_rows, "wrappers")
        discard(rows, counts)
        rows, size = stored, fan_in


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, through the wrapper of its host.

    Columns: the id and url columns, text (blocks joined by one line break, '' if none), n_chars (code points). White
    space, also of character references and line-break elements, is one blank inside a block. A null or empty page
    has no text; pages without a host (also of a null url) are aligned with each other; repeated rows and ids come
    through one by one; broken markup never fails; an empty table gives no rows; other columns are ignored.
    """
    wrappers = host_wrappers(pages, url_col, html_col)

    def guides(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [json.dumps(guide(parsed(t, [int(x) for x in f]), n)) for t, f, n in zip(frame["structure"], frame["facts"], frame["pages"])]
            yield pd.DataFrame({"host": frame["host"], "guide": found, "weight": frame["pages"]})

    known = written(wrappers.mapInPandas(guides, "host string, guide string, weight bigint"), "guides")
    discard(wrappers)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, dict | None] = {None: None}
        for batch in frames:
            texts = []
            for html, where in zip(batch.column("html"), batch.column("guide")):
                where = where.as_py()
                if where not in read:
                    if len(read) > HELD:
                        read = {None: None}
                    read[where] = json.loads(where)
                texts.append(extracted(html.as_py(), read[where]))
            size = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), size]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    host = F.coalesce(F.lower(F.regexp_extract(url_col, "^[^:/?#]*:?//([^/?#]*)", 1)), F.lit(""))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    salt = F.struct("page_id", "url", F.length("html"))
    joined = lookup_join(spread_rows(slim), Table(known), ["host"], "left", "weight", salt)
    kind = slim.schema["page_id"].dataType.simpleString()
    out = joined.select("page_id", "url", "html", "guide").mapInArrow(batches, f"page_id {kind}, url string, text string, n_chars bigint")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
