"""Formatting, minifying, inlining and comparing markup and style sheets."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from html import escape as entitize
from html import unescape as deentitize

from pagemill.functions import css
from pagemill.functions.dom import VOID, Node, escape, label, parse, serialise
from pagemill.functions.text import BLOCKS
from pagemill.functions.urls import resolve

__all__ = ["compare", "deentitize", "entitize", "format_css", "format_html", "inline_css", "local_links", "minify_css", "minify_html", "without"]

_KEEP = frozenset(("pre", "textarea", "script", "style"))


def _open(n: Node) -> str:
    return f"<{n.tag}" + "".join(f' {k}="{escape(v, True)}"' for k, v in n.attrs.items()) + ">"


def format_html(html: str, indent: str = "  ") -> str:
    """One line per block element, nested by depth; text inside a line and preformatted text stay as they are."""
    out: list[str] = []

    def inline(n: Node) -> bool:
        return n.tag[0] == "#" or n.tag not in BLOCKS and n.tag not in ("head", "script", "style", "link", "meta")

    def walk(n: Node, depth: int) -> None:
        run = ""
        for c in n.children:
            if inline(c):
                run += serialise(c)
                continue
            if run.strip():
                out.append(indent * depth + re.sub(r"\s+", " ", run).strip())
            run = ""
            if c.tag in _KEEP or c.tag in VOID or all(inline(x) for x in c.children):
                body = serialise(c)
                out.append(indent * depth + (body if c.tag in _KEEP else re.sub(r"\s+", " ", body)))
            else:
                out.append(indent * depth + _open(c))
                walk(c, depth + 1)
                out.append(f"{indent * depth}</{c.tag}>")
        if run.strip():
            out.append(indent * depth + re.sub(r"\s+", " ", run).strip())

    walk(parse(html), 0)
    return "\n".join(out)


def minify_html(html: str) -> str:
    """Markup without comments and without white space that doesn't show; preformatted text stays."""
    root = parse(html)

    def trim(n: Node, pre: bool) -> None:
        kids = []
        for c in n.children:
            if c.tag == "#comment" and not c.value.startswith("[if"):
                continue
            if c.tag == "#text" and not pre:
                c.value = re.sub(r"\s+", " ", c.value)
                block = n.tag in BLOCKS or n.tag in ("#document", "head")
                if not c.value.strip() and (block and (not kids or kids[-1].tag in BLOCKS or c is n.children[-1])):
                    continue
            kids.append(c)
            trim(c, pre or c.tag in _KEEP)
        n.children = kids

    trim(root, False)
    return serialise(root).strip()


def format_css(sheet: str, indent: str = "  ") -> str:
    """One declaration per line, rules of a condition nested in it."""
    out, open_ = [], ""
    for r in css.rules(sheet):
        if r["condition"] != open_:
            if open_:
                out.append("}")
            if r["condition"]:
                out.append(r["condition"] + " {")
            open_ = r["condition"]
        pad = indent if open_ else ""
        out.append(f"{pad}{r['selector']} {{")
        out += [f"{pad}{indent}{p}: {v}{' !important' if i else ''};" for p, v, i in r["declarations"]]
        out.append(pad + "}")
    return "\n".join(out + (["}"] if open_ else []))


def minify_css(sheet: str) -> str:
    """Style sheet without comments and spare white space; strings and the inside of calc() stay as they are."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    s = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
    s = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|calc\((?:[^()]|\([^()]*\))*\)", hold, s)
    s = re.sub(r"\s+", " ", s)
    s = re.sub(r" ?([{};,>~]) ?", r"\1", s)
    s = re.sub(r": (?=[^{}]*[;}])", ":", s).replace(";}", "}").strip()
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], s)


def inline_css(html: str, sheet: str = "") -> str:
    """Rules of the page's style elements (and ``sheet``) moved into style attributes, by specificity and order.

    Important declarations win, then the element's own style; conditional rules stay in the page.
    """
    root = parse(html)
    own = list(root.elements("style"))
    text = "\n".join([sheet, *(s.text() for s in own)])
    found: dict[int, dict[str, tuple]] = {}
    kept = []
    for order, r in enumerate(css.rules(text)):
        if r["condition"] or r["selector"].startswith("@"):
            kept.append(r)
            continue
        for sel in css.compile_selector(r["selector"]) if _readable(r["selector"]) else ():
            spec = css.specificity(r["selector"])
            for n in root.elements():
                if css._matches(n, sel):
                    for p, v, imp in r["declarations"]:
                        rank = (imp, 0, spec, order)
                        slot = found.setdefault(n.pre, {})
                        if p not in slot or slot[p][0] <= rank:
                            slot[p] = (rank, v)
    for n in root.elements():
        slot = found.get(n.pre)
        if slot:
            for p, v, imp in css.declarations(n.get("style")):
                rank = (imp, 1, (0, 0, 0), 0)
                if p not in slot or slot[p][0] <= rank:
                    slot[p] = (rank, v)
            n.attrs["style"] = ";".join(f"{p}:{v}" for p, (_, v) in sorted(slot.items()))
    for s in own:
        s.parent.children.remove(s)
    if kept:
        head = root.first("head") or root.first("html") or root
        holder = Node("style", head)
        body = {}
        for r in kept:
            body.setdefault(r["condition"], []).append(f"{r['selector']}{{" + ";".join(f"{p}:{v}" + ("!important" if i else "") for p, v, i in r["declarations"]) + "}")
        holder.children = [Node("#text", holder, value="".join(f"{c}{{{''.join(x)}}}" if c else "".join(x) for c, x in body.items()))]
        head.children.append(holder)
    return serialise(root)


def _readable(selector: str) -> bool:
    try:
        css.compile_selector(selector)
        return True
    except css.SelectorError:
        return False


def without(html: str, selectors: list[str]) -> str:
    """Markup without the subtrees that match any of the selectors."""
    root = parse(html)
    for sel in selectors:
        for n in css.select(root, sel):
            if n.parent is not None and n in n.parent.children:
                n.parent.children.remove(n)
    return serialise(label(root))


def local_links(html: str, places: dict[str, str], base: str | None = None) -> str:
    """Addresses that have a local place, rewritten to it: href, src, poster, srcset and url() of styles."""
    root = parse(html)

    def place(value: str) -> str | None:
        u = resolve(value, base) or value
        head, _, frag = u.partition("#")
        got = places.get(u) or places.get(head)
        return got + ("#" + frag if frag and got else "") if got else None

    def in_css(text: str) -> str:
        return re.sub(r"url\(\s*([\"']?)([^)\"']+)\1\s*\)", lambda m: f"url({place(m[2]) or m[2]})", text)

    for n in root.elements():
        for a in ("href", "src", "poster", "data"):
            if n.get(a) and (p := place(n.get(a))):
                n.attrs[a] = p
        if n.get("srcset"):
            n.attrs["srcset"] = re.sub(r"(^|,\s*)([^\s,]+)", lambda m: m[1] + (place(m[2]) or m[2]), n.get("srcset"))
        if n.get("style"):
            n.attrs["style"] = in_css(n.get("style"))
        if n.tag == "style":
            for c in n.children:
                c.value = in_css(c.value)
    return serialise(root)


def compare(old: str, new: str) -> list[dict]:
    """Differences of two pages as rows: kind (added, removed, changed, attribute), path, old and new value."""
    out: list[dict] = []

    def key(n: Node) -> tuple:
        return (n.tag, n.get("id"), re.sub(r"\s+", " ", n.value).strip() if n.tag == "#text" else "")

    def diff(a: Node, b: Node, path: str) -> None:
        for k in sorted(set(a.attrs) | set(b.attrs)):
            if a.attrs.get(k) != b.attrs.get(k):
                out.append({"kind": "attribute", "path": f"{path}@{k}", "old": a.attrs.get(k), "new": b.attrs.get(k)})
        x = [c for c in a.children if c.tag != "#comment" and (c.tag != "#text" or c.value.strip())]
        y = [c for c in b.children if c.tag != "#comment" and (c.tag != "#text" or c.value.strip())]
        for op, i, j, k, m in SequenceMatcher(None, [key(c) for c in x], [key(c) for c in y], autojunk=False).get_opcodes():
            if op == "equal" or op == "replace" and j - i == m - k:
                for p, q in zip(x[i:j], y[k:m]):
                    at = f"{path}/{q.tag}[{y.index(q)}]"
                    if p.tag == q.tag == "#text":
                        if key(p) != key(q):
                            out.append({"kind": "changed", "path": at, "old": p.value.strip(), "new": q.value.strip()})
                    elif p.tag == q.tag:
                        diff(p, q, at)
                    else:
                        out.append({"kind": "changed", "path": at, "old": serialise(p), "new": serialise(q)})
                continue
            out.extend({"kind": "removed", "path": f"{path}/{c.tag}[{x.index(c)}]", "old": serialise(c), "new": None} for c in x[i:j])
            out.extend({"kind": "added", "path": f"{path}/{c.tag}[{y.index(c)}]", "old": None, "new": serialise(c)} for c in y[k:m])

    diff(parse(old), parse(new), "")
    return out
