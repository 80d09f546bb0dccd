"""A tolerant HTML tree for use inside batched functions.

The builder covers the everyday rules of HTML parsing: void and raw-text elements, implied end
tags, table scoping, character references. Nodes carry pre-order interval labels, so subtree and
ancestor tests are comparisons and document order is the ``pre`` label. Malformed formatting
elements are closed with their parent instead of being re-opened in the next one.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noembed", "xmp", "plaintext"))
#: Elements whose open tag ends an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
_TOKEN = re.compile(
    r"<!--(.*?)(?:-->|\Z)|<(!doctype[^>]*|\?[^>]*|![^>]*)>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*+(?:\"[^\"]*\"|'[^']*'))*+[^>\"']*+>|[^>]*>)", re.S | re.I
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
#: Depth of a tree. What is nested deeper hangs side by side below an element of this depth, as in browsers, so no walk runs out of stack.
MAX_DEPTH = 512
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    """An element, a text run (tag '#text') or a comment (tag '#comment')."""

    __slots__ = ("attrs", "children", "depth", "last", "parent", "pre", "tag", "value")

    def __init__(self, tag: str, parent: Node | None = None, attrs: dict | None = None, value: str = ""):
        self.tag, self.parent, self.attrs, self.value = tag, parent, attrs or {}, value
        self.children: list[Node] = []
        self.pre = self.last = 0
        self.depth = 0

    # ---- walking

    def walk(self):
        """This node and its descendants in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def elements(self, *tags: str):
        """Descendant elements in document order, of the given tags if any."""
        want = frozenset(tags)
        for n in self.walk():
            if n is not self and n.tag[0] != "#" and (not want or n.tag in want):
                yield n

    def first(self, *tags: str) -> Node | None:
        return next(self.elements(*tags), None)

    def kids(self, *tags: str) -> list[Node]:
        return [c for c in self.children if c.tag[0] != "#" and (not tags or c.tag in tags)]

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def closest(self, *tags: str) -> Node | None:
        return next((a for a in self.ancestors() if a.tag in tags), None)

    def within(self, other: Node) -> bool:
        return other.pre < self.pre <= other.last

    # ---- content

    def text(self, skip: frozenset = frozenset()) -> str:
        """Text content, without subtrees of the tags in ``skip``."""
        if not skip:
            return "".join(n.value for n in self.walk() if n.tag == "#text")
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag == "#text":
                out.append(n.value)
            elif n.tag not in skip:
                stack.extend(reversed(n.children))
        return "".join(out)

    def own_text(self) -> str:
        return "".join(c.value for c in self.children if c.tag == "#text")

    def clean(self, skip: frozenset = frozenset()) -> str:
        return normal(self.text(skip))

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def normal(text: str) -> str:
    """White space runs as one space, trimmed."""
    return _SPACE.sub(" ", text).strip()


def _attributes(raw: str) -> dict:
    out: dict = {}
    for name, value in _ATTR.findall(raw[:-2] if raw.endswith((" />", '"/>', "'/>")) else raw[:-1]):
        name = name.lower()
        if name not in out:
            if value[:1] in "\"'" and value[:1]:
                value = value[1:-1]
            out[name] = unescape(value) if "&" in value else value
    return out


def parse(html: str | None) -> Node:
    """Tree of a page; the root is a '#document' node. Null parses like an empty page; no tree is deeper than ``MAX_DEPTH`` + 1."""
    root = Node("#document")
    if not html:
        return label(root)
    stack = [root]
    at, raw_end = 0, None

    def add_text(s: str, decode: bool = True) -> None:
        if s:
            top = stack[-1]
            if decode and "&" in s:
                s = unescape(s)
            top.children.append(Node("#text", top, value=s))

    low = None
    pos = 0
    while True:
        m = _TOKEN.search(html, pos)
        if m is None:
            break
        add_text(html[at : m.start()])
        at = pos = m.end()
        if m[1] is not None:
            stack[-1].children.append(Node("#comment", stack[-1], value=m[1]))
            continue
        if m[2] is not None:
            continue
        tag = m[4].lower()
        if m[3]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag == "table" and tag not in ("body", "html", "div", "table"):
                    break
            continue
        if tag in ("html", "body", "head"):
            old = next((n for n in stack if n.tag == tag), None)
            if old is not None:
                for k, v in _attributes(m[5]).items():
                    old.attrs.setdefault(k, v)
                continue
            if tag == "body":
                while len(stack) > 1 and stack[-1].tag != "html":
                    stack.pop()
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "td", "th", "button", "caption"):
                    break
        rule = _CLOSES.get(tag)
        if rule:
            ends, fence = rule
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fence:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    if stack[-1].tag not in ends:
                        break
        if tag == "a":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "a":
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "td", "th"):
                    break
        top = stack[-1] if len(stack) <= MAX_DEPTH else stack[MAX_DEPTH]
        node = Node(tag, top, _attributes(m[5]) if len(m[5]) > 1 else {})
        top.children.append(node)
        if tag in VOID or m[5].endswith("/>") and tag in ("path", "circle", "rect", "use", "line"):
            continue
        stack.append(node)
        if tag in RAW:
            if low is None:
                low = html.lower()
            end = low.find("</" + tag, at)
            end = len(html) if end < 0 else end
            add_text(html[at:end], tag in ("textarea", "title"))
            stack.pop()
            close = html.find(">", end)
            at = pos = len(html) if close < 0 else close + 1
    add_text(html[at:])
    return label(root)


def label(root: Node) -> Node:
    """Set pre-order interval labels: a descendant's ``pre`` lies in (pre, last] of its ancestor."""
    n = 0
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            node.last = n - 1
            continue
        node.pre = n
        n += 1
        node.depth = 0 if node.parent is None else node.parent.depth + 1
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    return root


_ESC = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}


def escape(text: str, quote: bool = False) -> str:
    if quote:
        return text.replace("&", "&amp;").replace('"', "&quot;")
    return re.sub("[&<>]", lambda m: _ESC[m[0]], text)


def serialise(node: Node) -> str:
    """Markup of a node and its subtree."""
    if node.tag == "#text":
        return node.value if node.parent is not None and node.parent.tag in ("script", "style") else escape(node.value)
    if node.tag == "#comment":
        return f"<!--{node.value}-->"
    inner = "".join(map(serialise, node.children))
    if node.tag == "#document":
        return inner
    attrs = "".join(f' {k}="{escape(v, True)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + ("" if node.tag in VOID else f"{inner}</{node.tag}>")
