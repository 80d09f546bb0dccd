"""What of a page is its content: selection by mode, clean-up, comparison of the modes, the page as one record, dataset chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import css
from pagemill.functions.batches import map_arrow
from pagemill.functions.dom import HEADINGS, Node, label, normal, parse
from pagemill.functions.redact import redact_links, redact_url
from pagemill.functions.text import fragment_text, markdown, readable
from pagemill.functions.urls import effective_base
from pagemill.operators.extract import forms, layout, links, tokens
from pagemill.operators.select import _rows
from pagemill.operators.tables import read_tables

MODES = ("Raw", "Focused", "Reader")
#: Selectors of content elements in order of preference, and the words that tell boilerplate.
PREFERRED = ("main", "[role='main']", "#main", "#main-content", ".main-content", ".site-main", "#content", ".content", ".entry-content", ".post-content", "article")
SIGNALS = (
    "site-header primary-navigation nav-menu menu-item-search footer-nav footer-site-info wpml-ls sharing-popup post-footer-sharing socials-sharing gem-pagination skip-link language-switcher "
    "locale-switcher related-post related-articles related-content breadcrumbs breadcrumb comment-respond comments-area newsletter subscribe promo cookie-banner table-of-contents toc sidebar "
    "share social pagination pager"
).split()
#: Words and score that a reader candidate needs.
LEAST_WORDS, LEAST_SCORE = 20, 25.0

#: Points of a reader candidate for its elements and its tag, and what link density, bare lists and boilerplate cost.
POINTS = {"p": 18, "h": 20, "code": 14, "table": 10}
TAG_POINTS = {"article": 35, "main": 20, "section": 10}
DENSE, DENSEST, DENSE_COST, DENSEST_COST = 0.55, 0.75, 40, 80
LIST_COST, SIGNAL_COST, LINK_BLOCK_COST = 45, 55, 80

_WORD = regex.compile(r"\b[\p{L}\p{N}][\p{L}\p{N}'_-]*\b")
_CANDIDATES = ("article", "main", "section", "div")
_LOW_VALUE = ("div", "section", "aside", "nav", "ul", "ol", "details", "form")


def count_words(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text))


class Measures:
    """Words and elements of every subtree of a tree, counted once: a subtree is an interval of positions."""

    def __init__(self, root: Node):
        self.at: dict[int, tuple[int, int]] = {}
        pieces: list[str] = []
        n = 0
        stack: list[tuple[Node, int]] = [(root, -1)]
        while stack:
            node, start = stack.pop()
            if start >= 0:
                self.at[node.pre] = (start, n)
            elif node.tag == "#text":
                pieces.append(node.value)
                n += len(node.value)
            else:
                stack.append((node, n))
                stack += [(c, -1) for c in reversed(node.children)]
        self.text = "".join(pieces)
        self.starts = [m.start() for m in _WORD.finditer(self.text)]
        self.places: dict[str, list[int]] = {}
        links: list[tuple[int, int]] = []
        for e in root.elements():
            kinds = ["p"] if e.tag == "p" else ["h"] if e.tag in ("h1", "h2", "h3") else ["li"] if e.tag == "li" else ["code"] if e.tag in ("pre", "code") else ["table"] if e.tag == "table" else ["img"] if e.tag == "img" else []
            if e.tag == "a" and "href" in e.attrs:
                kinds = ["a"]
                links.append((e.pre, count_words(e.text())))
            for k in kinds:
                self.places.setdefault(k, []).append(e.pre)
        self.link_words = [0]
        for _, w in links:
            self.link_words.append(self.link_words[-1] + w)

    def words(self, node: Node) -> int:
        a, b = self.at[node.pre]
        i = bisect_left(self.starts, a)
        n = bisect_left(self.starts, b) - i
        # A word that begins before the subtree and goes on in it counts for what is inside.
        inside = a < b and 0 < a < len(self.text) and self.text[a].isalnum() and self.text[a - 1].isalnum() and not (i < len(self.starts) and self.starts[i] == a)
        return n + int(inside)

    def count(self, node: Node, kind: str) -> int:
        p = self.places.get(kind, [])
        return bisect_right(p, node.last) - bisect_right(p, node.pre)

    def linked(self, node: Node) -> int:
        p = self.places.get("a", [])
        return self.link_words[bisect_right(p, node.last)] - self.link_words[bisect_right(p, node.pre)]


def signalled(n: Node) -> bool:
    """Whether an element's names hold a word that tells boilerplate."""
    names = " ".join(n.get(a) for a in ("id", "class", "aria-label", "role", "data-testid")).lower()
    return bool(names.strip()) and any(s in names for s in SIGNALS)


def link_dense(n: Node, m: Measures) -> bool:
    """A block that is little but links, or nothing at all."""
    if m.count(n, "code") or m.count(n, "table") or m.count(n, "img"):
        return False
    words = m.words(n)
    if not words:
        return True
    if m.count(n, "a") < 3:
        return False
    density = m.linked(n) / words
    return density >= DENSEST and words <= 90 or m.count(n, "li") >= 4 and density >= DENSE and words <= 140


def low_value(n: Node, m: Measures) -> bool:
    """A short block, or one whose words are mostly links."""
    if m.count(n, "code") or m.count(n, "table"):
        return False
    words, paragraphs, anchors = m.words(n), m.count(n, "p"), m.count(n, "a")
    if m.count(n, "h") and words >= 60 or paragraphs >= 2 and words >= 50 and anchors <= 6:
        return False
    return words <= 12 or anchors >= 3 and m.linked(n) >= max(8, words // 2)


def reader_score(n: Node, m: Measures, least_words: int = LEAST_WORDS) -> float | None:
    """Score of a reader candidate; None for what can't be one."""
    words = m.words(n)
    if n.tag not in _CANDIDATES or words < least_words:
        return None
    score = float(words + sum(w * m.count(n, k) for k, w in POINTS.items()) + TAG_POINTS.get(n.tag, 0))
    density = m.linked(n) / max(1, words)
    costs = (
        (DENSEST_COST if density >= DENSEST else DENSE_COST, density >= DENSE), (LIST_COST, m.count(n, "li") >= 5 and not m.count(n, "p")), (SIGNAL_COST, signalled(n)), (LINK_BLOCK_COST, link_dense(n, m)),
    )
    return score - sum(c for c, on in costs if on)


def hint(n: Node | None) -> str | None:
    """tag, #id and up to three classes."""
    if n is None:
        return None
    # A page without a body element is all body.
    return ("body" if n.tag == "#document" else n.tag) + (f"#{n.get('id')}" if n.get("id").strip() else "") + "".join(f".{c}" for c in n.classes()[:3])


def _preferred(root: Node) -> Node | None:
    return next((hit[0] for s in PREFERRED if (hit := css.select(root, s))), None)


def _plain_number(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.2f}".rstrip("0").rstrip(".")


def select_content(root: Node, mode: str = "Focused", selector: str | None = None, least_words: int = LEAST_WORDS, least_score: float = LEAST_SCORE) -> dict:
    """The element a mode keeps (None for the whole document) with the reason; ``kept`` is False where nothing is stored."""
    r = {"mode": mode, "reason_code": "", "reason": "", "element": None, "kept": True, "score": None, "candidates": 0, "root_hint": None}
    first = lambda: (css.select(root, selector) or [None])[0] if selector else None
    semantic = selector is not None and selector.strip().lower().replace('"', "'") in PREFERRED
    if mode == "Raw":
        if not selector:
            return r | {"reason_code": "RawDocument", "reason": "Raw mode kept the full fetched document because no selector was configured."}
        e = first()
        if e is None:
            return r | {"reason_code": "RawSelectorMiss", "kept": False, "reason": f"Raw mode produced no stored content because selector '{selector}' was not found."}
        return r | {"reason_code": "RawSelector", "element": e, "reason": f"Raw mode selected the exact configured selector '{selector}'."}
    if mode == "Focused":
        e = first()
        if e is not None:
            return r | {"reason_code": "FocusedSelector", "element": e, "reason": f"Focused mode selected the configured selector '{selector}'."}
        e = _preferred(root) if not selector or semantic else None
        if e is not None:
            return r | {"reason_code": "FocusedSemanticFallback", "element": e, "reason": f"Focused mode fell back to semantic content element <{hint(e)}>."}
        why = f"selector '{selector}' did not match and no semantic fallback was found" if selector else "no preferred content element was found"
        return r | {"reason_code": "FocusedFullDocumentFallback", "reason": f"Focused mode kept the full document because {why}."}
    top, told = first(), f"configured selector '{selector}'"
    if top is None and semantic and (top := _preferred(root)) is not None:
        told = f"semantic fallback <{hint(top)}>"
    if top is None:
        top, told = root.first("body") or root, "document body"
    m = Measures(root)
    pool = [top, *top.elements(*_CANDIDATES)]
    scores = [reader_score(n, m, least_words) for n in pool]
    best = max((s for s in scores if s is not None), default=None)
    r |= {"candidates": len(pool), "root_hint": hint(top)}
    if best is None or best < least_score:
        why = f"Reader mode started from {told} and kept <{hint(top)}> because no stronger article-like candidate met the minimum score of {_plain_number(least_score)}."
        return r | {"reason_code": "ReaderRootFallback", "reason": why, "element": top, "score": scores[0]}
    e = pool[scores.index(best)]
    return r | {"reason_code": "ReaderBestCandidate", "element": e, "score": best, "reason": f"Reader mode started from {told} and selected the best-scoring content block <{hint(e)}> with score {_plain_number(best)}."}


def concealed(n: Node) -> bool:
    """Whether an element is marked as hidden."""
    style = re.sub(r"\s+", "", n.get("style")).lower()
    return "hidden" in n.attrs or n.get("aria-hidden").lower() == "true" or n.tag == "input" and n.get("type").lower() == "hidden" or any(x in style for x in ("display:none", "visibility:hidden"))


def clean_up(top: Node, smart: bool = True, hidden: bool = True, exclude: tuple[str, ...] = ()) -> Node:
    """The subtree without hidden elements, boilerplate blocks and what the given selectors match; the tree itself is changed."""

    def drop(gone) -> None:
        gone = {id(n) for n in gone}
        for n in list(top.walk()):
            if n.children and any(id(c) in gone for c in n.children):
                n.children = [c for c in n.children if id(c) not in gone]

    if hidden:
        drop(n for n in top.elements() if concealed(n))
    if smart:
        label(top)
        m = Measures(top)
        drop([n for n in top.elements(*_LOW_VALUE) if signalled(n) and low_value(n, m) or link_dense(n, m)])
    for s in exclude:
        drop(css.select(top, s))
    return top


def _copy(n: Node) -> Node:
    """A subtree of its own, below a new document."""
    doc = Node("#document")
    stack = [(x, doc) for x in reversed(n.children)] if n.tag == "#document" else [(n, doc)]
    while stack:
        src, dst = stack.pop()
        c = Node(src.tag, dst, dict(src.attrs), src.value)
        dst.children.append(c)
        stack += [(x, c) for x in reversed(src.children)]  # children are taken in their order
    return label(doc)


def _summary(text: str, limit: int = 180) -> str:
    t = normal(text)
    if len(t) <= limit:
        return t
    cut = t.rfind(" ", 0, limit + 1)
    return t[: cut if cut >= limit // 2 else limit].rstrip() + "..."


def compare_modes(html: str, selector: str | None = None, smart: bool = True) -> list[dict]:
    """Words, characters and summary of what each mode keeps after clean-up."""
    out = []
    for mode in MODES:
        root = parse(html)
        got = select_content(root, mode, selector)
        e = got["element"]
        text = fragment_text(_text_root(clean_up(root if e is None else _copy(e), smart))) if got["kept"] else ""
        out.append({**{k: got[k] for k in ("mode", "reason_code", "score", "candidates")}, "selector_hint": hint(e), "words": count_words(text), "characters": len(text), "summary": _summary(text)})
    return out


def _text_root(root: Node) -> Node:
    return root.first("body") or root


def best_mode(rows: list[dict]) -> tuple[dict, dict | None, str]:
    """The preferred mode among those within ten words of the most, the runner-up, and the differences as text."""
    rank = {"Reader": 0, "Focused": 1, "Raw": 2}
    most = max(r["words"] for r in rows)
    best = min((r for r in rows if r["words"] >= most - 10), key=lambda r: (rank[r["mode"]], -r["words"], -r["characters"]))
    rest = sorted((r for r in rows if r is not best), key=lambda r: (-r["words"], -r["characters"], rank[r["mode"]]))
    order = sorted(rows, key=lambda r: (r is not best, rank[r["mode"]], -r["words"], -r["characters"]))
    return best, rest[0] if rest else None, " | ".join(f"{r['mode']} {'+' if r['words'] > best['words'] else ''}{r['words'] - best['words']}" for r in order)


SELECTION = "mode string, reason_code string, reason string, tag string, id string, classes array<string>, selector_hint string, score double, candidates int, root_hint string, words int"


def content_selection(pages: DataFrame, mode: str = "Focused", selector: str | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """What a mode keeps of each page and why; null and blank pages have the reason 'None'. A selector that can't be read fails before any task runs."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if selector:
        css.compile_selector(selector)

    def fn(root, _):
        got = select_content(root, mode, selector)
        e = got["element"]
        text = fragment_text(_text_root(clean_up(root if e is None else _copy(e)))) if got["kept"] else ""
        return [{
            **{k: got[k] for k in ("mode", "reason_code", "reason", "score", "candidates", "root_hint")}, "tag": (e.tag if e.tag[0] != "#" else "body") if e is not None else None, "id": e.get("id") if e is not None else None,
            "classes": e.classes() if e is not None else [], "selector_hint": hint(e), "words": count_words(text),
        }]

    got = _rows(pages.where(F.trim(html) != ""), fn, SELECTION, key, html, None)
    empty = pages.where(F.col(html).isNull() | (F.trim(html) == "")).select(key, F.lit(mode).alias("mode"), F.lit("None").alias("reason_code"), F.lit("No HTML was available for content selection.").alias("reason"), F.lit(0).alias("candidates"), F.lit(0).alias("words"))
    return got.unionByName(empty, allowMissingColumns=True)


COMPARISON = "mode string, reason_code string, score double, candidates int, selector_hint string, words int, characters int, summary string"


def content_comparison(pages: DataFrame, key: str = "page_id", html: str = "html", selector: str | None = None) -> DataFrame:
    """One row per page and mode; null and empty pages have none."""
    return _html_rows(pages, lambda h: compare_modes(h, selector), COMPARISON, key, html)


def content_winners(pages: DataFrame, key: str = "page_id", html: str = "html", selector: str | None = None) -> DataFrame:
    """Per page the best mode, its runner-up, the words between them and the differences of all modes."""

    def fn(h):
        best, other, text = best_mode(compare_modes(h, selector))
        return [{"best": best["mode"], "reason_code": best["reason_code"], "words": best["words"], "runner_up": other["mode"] if other else None, "delta": best["words"] - other["words"] if other else None, "deltas": text}]

    return _html_rows(pages, fn, "best string, reason_code string, words int, runner_up string, delta int, deltas string", key, html)


def _html_rows(pages: DataFrame, fn, fields: str, key: str, html: str) -> DataFrame:
    """Rows of ``fn(markup)`` per page that isn't blank."""
    kind = pages.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(b, _):
        out: dict = {"key": [], **{n: [] for n in names}}
        for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for r in fn(h) if h and h.strip() else ():
                out["key"].append(k)
                for n in names:
                    out[n].append(r[n])
        return out

    return map_arrow(pages.select(F.col(key).alias("key"), F.col(html).alias("html")), run, f"key {kind}, {fields}").withColumnRenamed("key", key)


# ---- the page as one record

READER = (
    "title string, headings array<string>, paragraphs array<string>, lists int, tables array<string>, links array<struct<text:string,url:string>>, forms int, regions array<string>, "
    "text string, markdown string, words int"
)


def read_page(root: Node, url: str | None) -> dict:
    """Headings, paragraphs, tables, links, forms and regions of a page with its readable text and Markdown."""
    body = root.first("body") or root
    best = readable(root)
    title = root.first("title")
    return {
        "title": (title.clean() if title is not None else "") or best["title"], "headings": [t for h in root.elements(*HEADINGS) if (t := h.clean())],
        "paragraphs": [t for p in root.elements("p") if (t := p.clean())], "lists": sum(1 for _ in root.elements("ul", "ol")),
        "tables": ["|".join(t["headers"]) for t in read_tables(root)], "links": [{"text": r["text"], "url": r["url"]} for r in links(root, url)],
        "forms": sum(1 for _ in forms(root, url)), "regions": [r["kind"] for r in layout(root, url)], "text": best["text"], "markdown": markdown(body, effective_base(root, url)), "words": best["words"],
    }


def page_reader(pages: DataFrame, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """One record per page; null and empty pages have none. Without a ``url`` column references stay as they are written."""
    return _rows(pages, lambda root, u: [read_page(root, u)], READER, key, html, url)


# ---- dataset chunks

CHUNK = (
    "chunk_id string, chunk_index int, source_url string, title string, text string, markdown string, summary string, words int, characters int, headings array<string>, forms int, "
    "redaction_hints array<string>, provenance string"
)
#: Least words of a chunk and headings it lists.
LEAST_CHUNK, MOST_HEADINGS = 50, 12


def _cut(text: str, size: int) -> list[str]:
    words = re.split(r"[ \t\r\n]+", text.strip(" \t\r\n")) if text.strip(" \t\r\n") else []
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def page_chunks(root: Node, url: str | None, size: int) -> list[dict]:
    best = readable(root)
    source = markdown(root.first("body") or root, effective_base(root, url))
    text = best["text"] if best["text"].strip() else " ".join(re.sub("[#*`]", " ", source).split())
    slices = _cut(source if source.strip() else text, size)
    seen: dict[str, str] = {}
    for h in root.elements("h1", "h2", "h3"):
        if h.clean():
            seen.setdefault(h.clean().lower(), h.clean())
    fs = list(forms(root, url))
    hints = [
        n for n, on in (
            ("hidden-form-fields", any(c["type"] == "hidden" for f in fs for c in f["fields"])), ("token-surfaces", any(True for _ in tokens(root, url))),
            ("login-form", any(f["login"] for f in fs)), ("browserless-auth-relay", any(f["relay"] for f in fs)),
        ) if on
    ]
    title = root.first("title")
    out = []
    for i, t in enumerate(_cut(text, size) or [""]):
        s = normal(t)
        out.append({
            "chunk_id": f"page-chunk-{i + 1:04d}", "chunk_index": i, "source_url": redact_url(url), "title": title.clean() if title is not None else best["title"], "text": t,
            "markdown": redact_links(slices[i] if i < len(slices) else t), "summary": s if len(s) <= 240 else s[:240].rstrip() + "...", "words": len(t.split()), "characters": len(t),
            "headings": list(seen.values())[:MOST_HEADINGS], "forms": len(fs), "redaction_hints": hints, "provenance": best["selector"],
        })
    return out


def dataset_chunks(pages: DataFrame, size: int = 350, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """Chunks of ``size`` words of each page's readable text, with where they come from and what in the page is sensitive.

    A page without text gives one empty chunk; null and empty pages give none. Addresses come out redacted.
    """
    if size < LEAST_CHUNK:
        raise ValueError(f"a chunk has {LEAST_CHUNK} words at least")
    return _rows(pages, lambda root, u: page_chunks(root, u, size), CHUNK, key, html, url)


def selection_counts(selected: DataFrame, by: list[str]) -> DataFrame:
    """Pages, words and mean score per group of a content selection."""
    return selected.groupBy(*by).agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.round(F.avg("score"), 4).alias("mean_score"))
