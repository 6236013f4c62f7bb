"""A small tree builder for pages as they are: unclosed and misnested tags, raw-text elements, comments, any attributes."""

from __future__ import annotations

import bisect
import html
import re

#: Kinds of elements of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes: elements of these names, up to an element of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "option", "optgroup", "legend", "dd", "dt", "li"} | {"li", "dd", "dt"}

#: A quote opens a value only behind an equals sign, however long the value is. One that never closes ends with its tag.
_TAG = re.compile(
    r"<!--(?:>|->)|<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
#: Behind the last ">" of a page only what needs none: the rest is a comment, a declaration or the end of an element that was not closed.
_UNENDED = re.compile(r"<[!?/].*", re.S)
_COMMENT_END = re.compile(r"--!?>\Z|\A<!--(?:>|->)\Z")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Node:
    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    def get(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attributes):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return out


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and, with references decoded, texts."""
    root = Node("#root", "", None)
    path = _Path(root)
    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < end:
        node = path.nodes[-1]
        m = (_TAG.search(page, at, last) if at < last else None) or _UNENDED.search(page, max(at, last))
        stop = m.start() if m else end
        if stop > at:
            node.children.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m.re is _UNENDED or (m[0].startswith("<!--") and not _COMMENT_END.search(m[0])):
            break  # goes on to the page's end
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            path.close(name)
            continue
        attributes = m[3] or m[6] or ""
        path.make_room(name)
        node = path.nodes[-1]
        new = Node(name, attributes, node)
        node.children.append(new)
        if name in VOID:
            continue
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            new.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        if attributes.endswith("/") and name not in BLOCK and name in ("svg", "path", "use"):
            continue
        path.push(new)
    return root


class _Path:
    """The open elements, with the places of each name and of blocks among them, so that no tag is answered by climbing."""

    def __init__(self, root: Node):
        self.nodes, self.blocks = [root], []
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        if node.name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def _cut(self, place: int) -> None:
        """The element at the place ends, with all in it."""
        while len(self.nodes) > place:
            name = self.nodes.pop().name
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def make_room(self, name: str) -> None:
        """What a start tag of this name closes ends."""
        if name in ENDS_PARAGRAPH and self.blocks and self.nodes[self.blocks[-1]].name == "p":
            self._cut(self.blocks[-1])
        if name in CLOSES:
            names, bounds = CLOSES[name]
            bound = max((self.places[b][-1] for b in bounds if self.places.get(b)), default=0)
            inside = [own[i] for n in names if (own := self.places.get(n)) and (i := bisect.bisect(own, bound)) < len(own)]
            if inside:
                self._cut(min(inside))

    def close(self, name: str) -> None:
        """An end tag: an inline one doesn't reach beyond its block, one without a start is ignored."""
        own = self.places.get(name)
        if own and (name in BLOCK or not self.blocks or self.blocks[-1] < own[-1]):
            self._cut(own[-1])
