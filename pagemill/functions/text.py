"""Text of a tree: flat, by lines, readable, and as Markdown."""

from __future__ import annotations

import re

from pagemill.functions.dom import HEADINGS, Node, normal

#: Elements without text of their own.
NO_TEXT = frozenset("script style template noscript iframe object embed svg math audio video canvas applet".split())
#: Elements that break a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br title".split()
)
_PRE = frozenset(("pre", "listing", "xmp", "plaintext", "textarea"))
_CONTENT = ("article", "main", "section", "div")
_WORD = re.compile(r"[^\W_][\w'’-]*")
_SIGNAL = re.compile(r"article|content|main|post|story|entry|body", re.I)
_BOILERPLATE = re.compile(r"nav|menu|sidebar|footer|header|comment|promo|related|share|social|cookie|consent|banner|breadcrumb|advert|newsletter", re.I)
_CONSENT = re.compile(r"cookie|consent|gdpr", re.I)
_NOISE = frozenset("script style noscript template svg nav header footer aside form iframe button select".split())


def words(text: str) -> int:
    """Letters or digits with inner apostrophes and dashes."""
    return len(_WORD.findall(text))


def fragment_text(node: Node) -> str:
    """Text with one space at each block boundary; neighbours inside a line stay joined."""
    out: list[str] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if c.tag == "#text":
                out.append(c.value)
            elif c.tag[0] != "#" and c.tag not in NO_TEXT:
                block = c.tag in BLOCKS
                if block:
                    out.append(" ")
                walk(c)
                if block:
                    out.append(" ")

    walk(node)
    return normal("".join(out))


def fragment_lines(node: Node) -> str:
    """Text with a line per block, at most one blank line between, indentation kept in preformatted text only."""
    out: list[str] = []

    def brk(n: int) -> None:
        have = 0
        for s in reversed(out):
            if s != "\n":
                break
            have += 1
        if out:
            out.extend("\n" for _ in range(max(0, min(2, n) - have)))

    def walk(n: Node, pre: bool) -> None:
        for c in n.children:
            if c.tag == "#text":
                if pre:
                    lines = c.value.split("\n")
                    for i, s in enumerate(lines):
                        if i:
                            out.append("\n")
                        if s:
                            out.append(s)
                else:
                    s = re.sub(r"\s+", " ", c.value)
                    if not out or out[-1] == "\n" or out[-1].endswith(" "):
                        s = s.lstrip()
                    if s:
                        out.append(s)
            elif c.tag == "br":
                if out and out[-1] != "\n":
                    out[-1] = out[-1].rstrip(" ")
                out.append("\n")
            elif c.tag[0] != "#" and c.tag not in NO_TEXT:
                if c.tag in BLOCKS and c.tag not in ("td", "th"):
                    brk(1)
                    walk(c, pre or c.tag in _PRE)
                    brk(1)
                else:
                    walk(c, pre or c.tag in _PRE)
                    if c.tag in ("td", "th"):
                        out.append(" ")

    walk(node, False)
    text = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n ")


def hidden(n: Node) -> bool:
    style = n.get("style").replace(" ", "").lower()
    return "hidden" in n.attrs or n.get("aria-hidden").lower() == "true" or n.tag == "input" and n.get("type").lower() == "hidden" or "display:none" in style or "visibility:hidden" in style


class Metrics:
    """Words, link words, paragraphs, headings and tables of every subtree, in one pass."""

    __slots__ = ("headings", "link_words", "links", "paragraphs", "tables", "words")

    def __init__(self):
        self.words = self.links = self.link_words = self.paragraphs = self.headings = self.tables = 0


def measure(root: Node) -> dict[int, Metrics]:
    """Metrics by ``pre``, without noise and hidden subtrees (which have none)."""
    out: dict[int, Metrics] = {}

    def visit(n: Node, in_link: bool) -> Metrics:
        m = Metrics()
        for c in n.children:
            if c.tag == "#text":
                k = words(c.value)
                m.words += k
                m.link_words += k if in_link else 0
                continue
            if c.tag[0] == "#" or c.tag in _NOISE or hidden(c):
                continue
            s = visit(c, in_link or c.tag == "a")
            m.words += s.words
            m.link_words += s.link_words
            m.links += s.links + (c.tag == "a")
            m.paragraphs += s.paragraphs + (c.tag == "p")
            m.headings += s.headings + (c.tag in HEADINGS)
            m.tables += s.tables + (c.tag == "table")
        out[n.pre] = m
        return m

    visit(root, False)
    return out


def readability(n: Node, m: Metrics) -> float:
    """Score of a candidate: words, structure and signals against link density and boilerplate."""
    names = f"{n.get('id')} {n.get('class')} {n.get('role')}"
    density = m.link_words / m.words if m.words else 0.0
    score = min(m.words, 900) + 18.0 * m.paragraphs + 30.0 * m.headings + 10.0 * m.tables
    score += 120 if n.tag == "article" else 90 if n.tag == "main" or n.get("role") == "main" else 0
    score += 60 if _SIGNAL.search(names) else 0
    score -= 12.0 * m.links + 220.0 * density + (35.0 if _BOILERPLATE.search(names) else 0.0)
    return score - (250 if _CONSENT.search(names) and (m.words <= 120 or m.links) else 0)


def readable(root: Node, preferred: str | None = None) -> dict:
    """``text, title, selector, score, candidates, words`` of the readable body.

    Candidates are content elements of at least twelve words; an article beats the rest, then
    the score, then the words. Without a candidate it is the whole page, and for a page of hardly
    any text its description.
    """
    from pagemill.functions.css import select

    metrics = measure(root)
    body = root.first("body") or root
    pool = select(root, preferred) if preferred else [n for n in root.elements() if n.tag in _CONTENT or n.get("role") == "main"]
    cand = [n for n in pool if n.pre in metrics and metrics[n.pre].words >= 12]
    best = max(cand, key=lambda n: (n.tag == "article", readability(n, metrics[n.pre]), metrics[n.pre].words, -n.pre), default=None)
    chosen = best if best is not None else body
    text = readable_text(chosen)
    head = next((h.clean() for h in chosen.elements("h1", "h2", "h3") if h.clean()), "")
    meta = {m.get("property").lower() or m.get("name").lower(): m.get("content").strip() for m in root.elements("meta")}
    title_node = root.first("title")
    title = head or meta.get("og:title") or meta.get("twitter:title") or (title_node.clean() if title_node else "")
    if best is None and (words(text) <= 6 or normal(text) == title):
        text = meta.get("og:description") or meta.get("description") or text or title
    return {
        "text": text, "title": title, "selector": selector_hint(chosen) if best is not None else "", "score": float(readability(chosen, metrics.get(chosen.pre, Metrics()))),
        "candidates": len(cand), "words": words(text),
    }


def readable_text(node: Node) -> str:
    """Lines of a subtree without navigation, hidden parts and consent notices."""
    keep = Node(node.tag, None, node.attrs)

    def copy(src: Node, dst: Node) -> None:
        for c in src.children:
            if c.tag == "#text":
                dst.children.append(c)
            elif c.tag[0] != "#" and c.tag not in _NOISE and not hidden(c):
                if _CONSENT.search(f"{c.get('id')} {c.get('class')}") and words(c.text()) <= 120:
                    continue
                d = Node(c.tag, dst, c.attrs)
                dst.children.append(d)
                copy(c, d)

    copy(node, keep)
    return fragment_lines(keep)


def selector_hint(n: Node) -> str:
    """tag#id, or tag with up to three classes."""
    return f"{n.tag}#{n.get('id')}" if n.get("id") else ".".join([n.tag, *n.classes()[:3]])


# ---- Markdown


def markdown(node: Node, base: str | None = None) -> str:
    """Portable Markdown of a subtree: headings, lists, quotes, code, tables, links and images."""
    from pagemill.functions.urls import resolve

    def inline(n: Node) -> str:
        out = []
        for c in n.children:
            if c.tag == "#text":
                out.append(re.sub(r"\s+", " ", c.value))
            elif c.tag == "br":
                out.append("  \n")
            elif c.tag in ("strong", "b") and c.clean():
                out.append(f"**{inline(c).strip()}**")
            elif c.tag in ("em", "i") and c.clean():
                out.append(f"*{inline(c).strip()}*")
            elif c.tag in ("code", "kbd", "samp", "tt") and c.text():
                tick = "``" if "`" in c.text() else "`"
                out.append(f"{tick}{c.clean()}{tick}")
            elif c.tag == "a" and c.get("href").strip() and c.clean():
                out.append(f"[{inline(c).strip()}]({resolve(c.get('href'), base) or c.get('href')})")
            elif c.tag == "img" and c.get("src"):
                out.append(f"![{normal(c.get('alt'))}]({resolve(c.get('src'), base) or c.get('src')})")
            elif c.tag[0] != "#" and c.tag not in NO_TEXT:
                out.append(inline(c))
        return "".join(out)

    def blocks(n: Node, depth: int = 0) -> list[str]:
        out: list[str] = []
        run: list[Node] = []

        def flush() -> None:
            if run:
                holder = Node("span")
                holder.children = list(run)
                t = inline(holder).strip()
                if t:
                    out.append(t)
                run.clear()

        for c in n.children:
            if c.tag[0] == "#" or c.tag not in BLOCKS or c.tag == "br":
                if c.tag != "#comment" and c.tag not in NO_TEXT:
                    run.append(c)
                continue
            flush()
            if c.tag in HEADINGS:
                t = inline(c).strip()
                if t:
                    out.append("#" * int(c.tag[1]) + " " + normal(t))
            elif c.tag in ("ul", "ol", "menu"):
                items = []
                for i, li in enumerate(c.kids("li")):
                    inner = blocks(li, depth + 1)
                    mark = f"{i + 1}. " if c.tag == "ol" else "- "
                    pad = " " * len(mark)
                    body = "\n".join(inner)
                    items.append(mark + body.replace("\n", "\n" + pad))
                if items:
                    out.append("\n".join(items))
            elif c.tag == "pre":
                code = c.first("code")
                lang = next((x.split("-", 1)[1] for x in (code or c).classes() if x.startswith(("language-", "lang-"))), "")
                out.append(f"```{lang}\n{c.text().strip(chr(10))}\n```")
            elif c.tag == "blockquote":
                out.append("\n".join("> " + x for x in "\n\n".join(blocks(c, depth)).split("\n")))
            elif c.tag == "hr":
                out.append("---")
            elif c.tag == "table":
                rows = [[normal(inline(d)).replace("|", "\\|") for d in tr.kids("td", "th")] for tr in c.elements("tr")]
                rows = [r for r in rows if r]
                if rows:
                    width = max(map(len, rows))
                    rows = [r + [""] * (width - len(r)) for r in rows]
                    lines = ["| " + " | ".join(r) + " |" for r in rows]
                    out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
            elif c.tag != "title":
                out += blocks(c, depth)
        flush()
        return out

    return "\n\n".join(x for x in blocks(node) if x.strip())
