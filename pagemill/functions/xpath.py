"""A subset of XPath 1.0 over the page tree: steps, common axes, predicates, unions, attribute and text results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pagemill.functions.dom import Node, normal

_TOKEN = re.compile(r"\s*(?:(//|::|\.\.|!=|<=|>=|[/\[\]()@|=<>,.*])|'([^']*)'|\"([^\"]*)\"|(\d+(?:\.\d+)?)|([A-Za-z_][\w.-]*))")
#: Axes that can be named.
AXES = ("self", "child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling")


class XPathError(ValueError):
    """An expression outside the subset."""


def _axis(n: Node, axis: str):
    """Nodes of an axis, nearest first."""
    if axis == "self":
        return [n]
    if axis == "child":
        return n.children
    if axis in ("descendant", "descendant-or-self"):
        return [x for x in n.walk() if x is not n or axis.endswith("self")]
    if axis == "parent":
        return [n.parent] if n.parent is not None else []
    if axis in ("ancestor", "ancestor-or-self"):
        return ([n] if axis.endswith("self") else []) + list(n.ancestors())
    kids = n.parent.children if n.parent is not None else [n]
    at = next(i for i, x in enumerate(kids) if x is n)
    return kids[at + 1 :] if axis == "following-sibling" else kids[:at][::-1]


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if m is None:
                raise XPathError(f"can't read {text[at:]!r}")
            at = m.end()
            kind = next(i for i, g in enumerate(m.groups()) if g is not None)
            self.tokens.append((("sign", "text", "text", "number", "name")[kind], m[kind + 1]))
        self.at = 0

    def peek(self, value: str | None = None, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and (value is None or self.tokens[i] == ("sign", value))

    def take(self, value: str | None = None) -> tuple[str, str]:
        if not self.peek(value):
            raise XPathError(f"expected {value or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self, value: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == ("name", value):
            self.at += 1
            return True
        return False

    # ---- paths

    def union(self) -> Callable:
        paths = [self.path()]
        while self.peek("|"):
            self.take()
            paths.append(self.path())
        return paths[0] if len(paths) == 1 else lambda n: [x for p in paths for x in p(n)]

    def path(self) -> Callable:
        steps: list[Callable] = []
        absolute = self.peek("/") or self.peek("//")
        if self.peek("//"):
            self.take()
            steps.append(lambda n: _axis(n, "descendant-or-self"))
        elif self.peek("/"):
            self.take()
        more = self.at < len(self.tokens) and not any(map(self.peek, ("]", ")", ",", "|", "=")))
        if more:
            steps.append(self.step())
        elif not absolute or steps:
            raise XPathError("expected a step")
        while self.peek("/") or self.peek("//"):
            if self.take()[1] == "//":
                steps.append(lambda n: _axis(n, "descendant-or-self"))
            steps.append(self.step())

        def run(n: Node) -> list:
            now: list = [next((a for a in _axis(n, "ancestor-or-self") if a.parent is None), n)] if absolute else [n]
            for s in steps:
                seen: set = set()
                out = []
                for x in now:
                    for y in s(x) if isinstance(x, Node) else ():
                        key = id(y) if isinstance(y, Node) else (id(x), y)
                        if key not in seen:
                            seen.add(key)
                            out.append(y)
                now = out
            return now

        return run

    def step(self) -> Callable:
        if self.peek(".."):
            self.take()
            return lambda n: _axis(n, "parent")
        if self.peek("."):
            self.take()
            return lambda n: [n]
        if self.peek("@"):
            self.take()
            name = "*" if self.peek("*") else ""
            name = self.take()[1].lower()
            return lambda n: list(n.attrs.values()) if name == "*" else [n.attrs[name]] if name in n.attrs else []
        axis = "child"
        if self.peek("::", 1):
            axis = self.take()[1]
            self.take("::")
            if axis not in AXES:
                raise XPathError(f"no axis {axis}")
        kind, test = self.take()
        if kind == "name" and self.peek("("):
            self.take("(")
            self.take(")")
            if test not in ("text", "node"):
                raise XPathError(f"no node test {test}()")
            match = (lambda n: n.tag == "#text") if test == "text" else (lambda n: True)
        elif kind == "name" or (kind, test) == ("sign", "*"):
            tag = test.lower()
            match = (lambda n: n.tag[0] != "#") if test == "*" else (lambda n: n.tag == tag)
        else:
            raise XPathError(f"expected a step, not {test}")
        rules = []
        while self.peek("["):
            self.take()
            rules.append(self.either())
            self.take("]")

        def run(n: Node) -> list:
            now = [x for x in _axis(n, axis) if match(x)]
            for rule in rules:
                kept = []
                for i, x in enumerate(now):
                    v = rule(x, i + 1, len(now))
                    if v == i + 1 if isinstance(v, (int, float)) and not isinstance(v, bool) else bool(v):
                        kept.append(x)
                now = kept
            return now

        return run

    # ---- predicates: functions of (node, position, size)

    def either(self) -> Callable:
        parts = [self.both()]
        while self.name("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else lambda *a: any(bool(p(*a)) for p in parts)

    def both(self) -> Callable:
        parts = [self.compared()]
        while self.name("and"):
            parts.append(self.compared())
        return parts[0] if len(parts) == 1 else lambda *a: all(bool(p(*a)) for p in parts)

    def compared(self) -> Callable:
        left = self.value()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.peek(op):
                self.take()
                right = self.value()
                return lambda *a: _compare(op, left(*a), right(*a))
        return left

    def value(self) -> Callable:
        if self.at >= len(self.tokens):
            raise XPathError("expected a value")
        kind, v = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return lambda *a: v
        if kind == "number":
            self.at += 1
            return lambda *a: float(v)
        if kind == "sign" and v == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if kind == "name" and self.peek("(", 1) and v not in ("text", "node"):
            self.at += 2
            args = []
            while not self.peek(")"):
                args.append(self.either())
                if self.peek(","):
                    self.take()
            self.take(")")
            if v not in _CALLS:
                raise XPathError(f"no function {v}")
            return lambda *a: _CALLS[v](*a, *[f(*a) for f in args])
        path = self.union()
        return lambda n, i, k: path(n)


def _text(v) -> str:
    if isinstance(v, list):
        v = v[0] if v else ""
    return v.value if isinstance(v, Node) and v.tag == "#text" else v.text() if isinstance(v, Node) else f"{v:g}" if isinstance(v, float) else str(v)


def _number(v) -> float:
    try:
        return float(v) if not isinstance(v, (list, Node)) else float(_text(v))
    except ValueError:
        return float("nan")


def _compare(op: str, a, b) -> bool:
    """A set of nodes compares true if one of its members does."""
    left, right = (a if isinstance(a, list) else [a]), (b if isinstance(b, list) else [b])
    for x in left:
        for y in right:
            if op in ("=", "!="):
                same = _number(x) == _number(y) if isinstance(x, float) or isinstance(y, float) else _text(x) == _text(y)
                if same == (op == "="):
                    return True
            elif {"<": _number(x) < _number(y), ">": _number(x) > _number(y), "<=": _number(x) <= _number(y), ">=": _number(x) >= _number(y)}[op]:
                return True
    return False


_CALLS = {
    "position": lambda n, i, k: float(i), "last": lambda n, i, k: float(k), "not": lambda n, i, k, v: not v, "contains": lambda n, i, k, a, b: _text(b) in _text(a),
    "starts-with": lambda n, i, k, a, b: _text(a).startswith(_text(b)), "normalize-space": lambda n, i, k, v=None: normal(_text(n if v is None else v)), "count": lambda n, i, k, v: float(len(v)),
    "string": lambda n, i, k, v=None: _text(n if v is None else v), "string-length": lambda n, i, k, v=None: float(len(_text(n if v is None else v))), "name": lambda n, i, k: n.tag,
}


def compile_xpath(expression: str) -> Callable[[Node], list]:
    """A function from a node to the expression's results, in document order for nodes; XPathError if it can't be read."""
    p = _Parser(expression)
    run = p.union()
    if p.at < len(p.tokens):
        raise XPathError(f"unexpected {p.tokens[p.at][1]!r}")

    def ordered(n: Node) -> list:
        got = run(n)
        return sorted({id(x): x for x in got}.values(), key=lambda x: x.pre) if got and all(isinstance(x, Node) for x in got) else got

    return ordered
