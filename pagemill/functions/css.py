"""CSS selectors over ``dom`` trees, and a reader of style sheets.

Selectors: type, universal, id, class, attribute tests, the four combinators, lists, ``:not``,
``:is``, ``:has`` (descendant), ``:first-child``, ``:last-child``, ``:only-child``,
``:nth-child``, ``:nth-of-type``, ``:first-of-type``, ``:last-of-type``, ``:empty``, ``:root``,
``:checked``, ``:disabled`` and ``:contains``. Matching goes from the last compound leftwards.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pagemill.functions.dom import Node

_PART = re.compile(
    r"""\s*([>+~,])\s*|(\s+)|\#((?:\\.|[\w-])+)|\.((?:\\.|[\w-])+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[^\s\]]+)\s*([iIsS])?\s*)?\]|::?([\w-]+)(\()?|(\*|(?:\\.|[\w-])+)""",
)


class SelectorError(ValueError):
    """A selector that can't be read."""


def _argument(text: str, at: int) -> tuple[str, int]:
    depth, i, quote = 1, at, ""
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at:i], i + 1
        i += 1
    raise SelectorError(f"unclosed parenthesis in {text!r}")


@lru_cache(maxsize=512)
def compile_selector(text: str) -> tuple:
    """Alternatives, each a tuple of (combinator, tests) from left to right."""
    out, steps, tests, comb = [], [], [], ""
    text = text.strip()
    if not text:
        raise SelectorError("empty selector")
    at = 0

    def push(nxt: str) -> None:
        nonlocal tests, comb
        if not tests:
            raise SelectorError(f"misplaced combinator in {text!r}")
        steps.append((comb, tuple(tests)))
        tests, comb = [], nxt

    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise SelectorError(f"can't read {text[at:]!r}")
        at = m.end()
        if m[1] == ",":
            push("")
            out.append(tuple(steps))
            steps = []
            comb = ""
        elif m[1]:
            if tests:
                push(m[1])
            elif steps and comb == " ":
                comb = m[1]
            else:
                raise SelectorError(f"misplaced combinator in {text!r}")
        elif m[2]:
            if at < len(text) and text[at] not in ">+~,":
                push(" ")
        elif m[3]:
            tests.append(("id", m[3].replace("\\", "")))
        elif m[4]:
            tests.append(("class", m[4].replace("\\", "")))
        elif m[5]:
            v = m[7]
            v = v[1:-1] if v and v[0] in "\"'" else v
            tests.append(("attr", m[5].lower(), m[6] or "", v or "", (m[8] or "").lower() == "i"))
        elif m[9]:
            arg = ""
            if m[10]:
                arg, at = _argument(text, at)
            name = m[9].lower()
            if name in ("not", "is", "where", "has", "matches"):
                tests.append((name, compile_selector(arg)))
            elif name.startswith("nth-"):
                tests.append((name, _nth(arg)))
            else:
                tests.append((name, arg.strip().strip("\"'")))
        else:
            if m[11] != "*":
                tests.append(("tag", m[11].replace("\\", "").lower()))
            else:
                tests.append(("any",))
    push("")
    out.append(tuple(steps))
    return tuple(out)


def _nth(arg: str) -> tuple[int, int]:
    a = arg.replace(" ", "").lower()
    if a in ("odd", "even"):
        return (2, 1 if a == "odd" else 0)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", a)
    if not m or not a:
        raise SelectorError(f"can't read position {arg!r}")
    step = m[1]
    n = 0 if step is None else int(step + "1") if step in ("", "+", "-") else int(step)
    return n, int(m[2] or 0)


def _position(i: int, rule: tuple[int, int]) -> bool:
    a, b = rule
    return i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _siblings(n: Node) -> list[Node]:
    return n.parent.kids() if n.parent is not None else [n]


def _test(n: Node, t: tuple) -> bool:
    kind = t[0]
    if kind == "tag":
        return n.tag == t[1]
    if kind == "any":
        return True
    if kind == "id":
        return n.attrs.get("id") == t[1]
    if kind == "class":
        return t[1] in n.classes()
    if kind == "attr":
        _, name, op, want, fold = t
        have = n.attrs.get(name)
        if have is None:
            return False
        if not op:
            return True
        if fold:
            have, want = have.lower(), want.lower()
        if op == "=":
            return have == want
        if op == "~=":
            return want in have.split()
        if op == "|=":
            return have == want or have.startswith(want + "-")
        if not want:
            return False
        return have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have
    if kind == "not":
        return not any(_matches(n, alt) for alt in t[1])
    if kind in ("is", "where", "matches"):
        return any(_matches(n, alt) for alt in t[1])
    if kind == "has":
        return any(_matches(d, alt) for d in n.elements() for alt in t[1])
    if kind == "contains":
        return t[1] in n.text()
    if kind == "empty":
        return not any(c.tag != "#comment" for c in n.children)
    if kind == "root":
        return n.parent is not None and n.parent.tag == "#document"
    if kind in ("checked", "disabled"):
        return kind in n.attrs or (kind == "checked" and "selected" in n.attrs)
    sib = _siblings(n)
    if kind.endswith("of-type"):
        sib = [s for s in sib if s.tag == n.tag]
    i = next(k for k, s in enumerate(sib) if s is n)
    if kind in ("first-child", "first-of-type"):
        return i == 0
    if kind in ("last-child", "last-of-type"):
        return i == len(sib) - 1
    if kind in ("only-child", "only-of-type"):
        return len(sib) == 1
    if kind in ("nth-child", "nth-of-type"):
        return _position(i + 1, t[1])
    if kind in ("nth-last-child", "nth-last-of-type"):
        return _position(len(sib) - i, t[1])
    raise SelectorError(f"unknown pseudo-class :{kind}")


def _matches(n: Node, steps: tuple, k: int | None = None) -> bool:
    k = len(steps) - 1 if k is None else k
    comb, tests = steps[k]
    if n.tag[0] == "#" or not all(_test(n, t) for t in tests):
        return False
    if k == 0:
        return True
    if comb == ">":
        return n.parent is not None and _matches(n.parent, steps, k - 1)
    if comb in "+~":
        sib = _siblings(n)
        i = next(j for j, s in enumerate(sib) if s is n)
        before = sib[i - 1 : i] if comb == "+" else sib[:i]
        return any(_matches(s, steps, k - 1) for s in before)
    return any(_matches(a, steps, k - 1) for a in n.ancestors())


def matches(node: Node, selector: str) -> bool:
    return any(_matches(node, s) for s in compile_selector(selector))


def select(root: Node, selector: str) -> list[Node]:
    """Descendant elements of ``root`` that match, in document order."""
    alts = compile_selector(selector)
    return [n for n in root.elements() if any(_matches(n, s) for s in alts)]


def split_value_selector(selector: str) -> tuple[str, str, str]:
    """(element selector, 'element' | 'text' | 'attr', attribute) of a selector that may end in ``::text`` or ``::attr(x)``.

    A white-space or '>' combinator before the ending means the values of all descendants.
    """
    m = re.search(r"^(.*?)(\s*>\s*|\s+)?::(text|attr\(\s*([\w:-]+)\s*\))\s*$", selector, re.S)
    if not m:
        return selector.strip(), "element", ""
    if "," in re.sub(r"\[[^\]]*\]|\([^()]*\)|\"[^\"]*\"|'[^']*'", "", m[1]):
        raise SelectorError("a value selector can't follow a list")
    head = m[1].strip() or "*"
    return head + (" *" if m[2] and m[1].strip() else ""), "text" if m[3] == "text" else "attr", (m[4] or "").lower()


# ---- style sheets

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_URL = re.compile(r"""url\(\s*("[^"]*"|'[^']*'|[^)]*?)\s*\)|@import\s+("[^"]*"|'[^']*')""", re.I)


def rules(css: str) -> list[dict]:
    """Style rules in order: selector, declarations, enclosing at-rule ('' if none)."""
    out: list[dict] = []
    s = _COMMENT.sub(" ", css)

    def block(at: int, condition: str) -> int:
        start = at
        while at < len(s):
            c = s[at]
            if c in "\"'":
                end = s.find(c, at + 1)
                at = len(s) if end < 0 else end + 1
                continue
            if c == ";" and s[start:at].lstrip().startswith("@"):
                start = at = at + 1
                continue
            if c == "}":
                return at + 1
            if c == "{":
                head = " ".join(s[start:at].split())
                if head.startswith("@") and re.match(r"@(media|supports|layer|container|document)", head):
                    at = start = block(at + 1, head)
                    continue
                end = s.find("}", at)
                end = len(s) if end < 0 else end
                out.append({"selector": head, "declarations": declarations(s[at + 1 : end]), "condition": condition})
                at = start = end + 1
                continue
            at += 1
        return at

    block(0, "")
    return out


def declarations(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a declaration block."""
    out = []
    for part in re.split(r";(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)(?![^(]*\))", body):
        name, colon, value = part.partition(":")
        if colon and name.strip():
            v = value.strip()
            important = bool(re.search(r"!\s*important\s*$", v, re.I))
            out.append((name.strip(), re.sub(r"\s*!\s*important\s*$", "", v, flags=re.I), important))
    return out


def urls(css: str) -> list[str]:
    """url() and @import targets in order."""
    return [(m[1] or m[2] or "").strip("\"' ") for m in _URL.finditer(_COMMENT.sub(" ", css))]


def specificity(selector: str) -> tuple[int, int, int]:
    """(ids, classes, tags) of the most specific alternative."""

    def of(steps: tuple) -> tuple[int, int, int]:
        a = b = c = 0
        for _, tests in steps:
            for t in tests:
                if t[0] == "id":
                    a += 1
                elif t[0] == "tag":
                    c += 1
                elif t[0] in ("not", "is", "has", "matches"):
                    x, y, z = max(of(s) for s in t[1])
                    a, b, c = a + x, b + y, c + z
                elif t[0] not in ("any", "where"):
                    b += 1
        return a, b, c

    return max(of(s) for s in compile_selector(selector))
