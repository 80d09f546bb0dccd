"""Markup residue in text and titles; clean text with its structure; site templates (problem 2).

Element subtrees are hashed and counted per host in Spark; subtrees that recur across many of
a host's pages are site template and are deleted before the page becomes text. What remains is
converted with headings, lists, tables, code and formulas kept. Residue of HTML, Markdown, wiki
and LaTeX source is found by one grammar per kind.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html import unescape
from html.entities import html5

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.functions.blocks import _ATTRS, _CODE as CODE, body_markup, split_at, split_blocks
from pagemill.llm.memo import Memo
from pagemill.llm.site_lines import hot_hosts, page_hosts
from pagemill.operators.hot import for_each_part, split_rows
from pagemill.session import materialise

MIN_PAGES = 4
MIN_SHARE = 0.2
#: Subtrees kept around a block, outermost first. A block that only a deeper subtree makes part of a template is judged on its page, to the same verdict.
CHAIN = 64

#: Element names of HTML and MathML that count as markup when they show as text.
TAGS = (
    "a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup dd del details dfn dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins kbd label legend li link main map mark math meta nav nobr noscript object ol optgroup "
    "option p param picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg "
    "table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()

_TAG = re.compile(r"</?(?:" + "|".join(TAGS) + r")(?:\s[^<>]*|\s*/)?>|<!--|-->", re.I)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_MARKDOWN = re.compile(
    r"(?:(?<=\s)|^)#{1,6} \S"  # heading
    r"|\*\*[^\s*][^*]*\*\*|(?<![\w_])__(?!NO|TOC|FORCE|NEW)[^\s_][^_]*[^\s_]__(?!\w)|(?<![\w_])__[^\s_]__(?!\w)"  # strong
    r"|~~[^\s~][^~]*~~"
    r"|!?\[[^\[\]]*\]\((?:[^()\s]|\([^()\s]*\))+(?: [^()]*)?\)"  # link, image
    r"|```|(?<!`)`[^`\s](?:[^`]*[^`\s])?`(?!`)"  # code
    r"|(?:(?<=\s)|^)[-*+] \[[ xX]\] "  # task
    r"|(?:(?<=\s)|^)\|(?: ?:?-{3,}:? ?\|)+"  # table rule
    r"|^> \S|(?:(?<=\s)|^)\[\^?[\w.-]+\]: ?\S|\S\[\^[\w.-]+\]"  # quote, reference, footnote
)
_MD_LIST = re.compile(r"^[*+] \S.* [*+] \S")
_MD_EMPHASIS = re.compile(r"(?<![\w*\\])\*(?![\s*])[^*\n]*?[^\s*\\]\*(?![\w*])")
_WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|'{3}[^'\s][^']*'{3}|(?<!')''[^'\s][^']*''(?!')"
    r"|(?:(?<=\s)|^)(={2,6}) [^=]+ \1(?=\s|$)|(?:(?<=\s)|^)={2,6}[^=\s][^=]*={2,6}(?=\s|$)"
    r"|\{\{[^{}|]+\|[^{}]*\}\}|__(?:NO|FORCE|NEW)?(?:TOC|EDITSECTION|GALLERY|SECTIONLINK|INDEX|NOINDEX)__"
    r"|\{\|(?: |$)|\|-(?= |$).*\|\}|(?<!\[)\[https?://\S+ [^\[\]]+\]|\{\{(?:[Rr]eflist|[Cc]lear|[Ss]tub|TOC\w*|[Mm]ain|[Dd]isambig\w*)\}\}"
)
_LATEX = re.compile(
    r"\\(?:begin|end|emph|textbf|textit|texttt|textsc|underline|section|subsection|subsubsection|chapter|paragraph|title|author|date|cite[tp]?|ref|eqref|label|url|href|"
    r"footnote|caption|includegraphics|frac|sqrt|sum|int|mathbf|mathrm|mathcal|text|usepackage|documentclass|newcommand|left|right|item|"
    r"alpha|beta|gamma|delta|lambda|sigma|leq|geq|times|cdot|infty|maketitle|tableofcontents|hline|ldots|dots|noindent|par|bibliography)(?![a-z])\*?(?:\s*[\[{]|(?=[\s\\$^_),.;:&]|$))|\{\\(?:it|bf|em|tt|sc|rm|sf|sl)\s"
    r"|\\\[ .*?\\\]|\\\(.*?\\\)"
    r"|(?<![\\$\w])\$(?![\s$\d{])[^$]*?[\^_\\=+<>][^$]*?(?<![\s\\])\$(?![\w{])"
    r"|(?<![\\$\w])\$\d[^$\s]*[\^_\\][^$]*?\$(?!\w)|\$\$[^$]+\$\$"
)
_HINT = re.compile(r"[<&*_`#\[{$\\|~]|==|''|-->|^> ")


def residue_kinds(text: str) -> tuple[str, ...]:
    """Kinds of source markup that show in a piece of visible text, in a fixed order."""
    if not _HINT.search(text):
        return ()
    out = []
    if _TAG.search(text) or any(m[0][1] == "#" or m[0][1:] in html5 for m in _ENTITY.finditer(text)):
        out.append("html")
    if _MARKDOWN.search(text) or _MD_LIST.search(text) or _MD_EMPHASIS.search(text):
        out.append("markdown")
    if _WIKI.search(text):
        out.append("wiki")
    if _LATEX.search(text):
        out.append("latex")
    return tuple(out)


# ---- element subtrees

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ELEMENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(?:" + _ATTRS + ")")
#: An opening tag that ends an open element of the same group.
_IMPLIED = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Elements that are never a template by themselves: the page's trunk and runs inside a line.
_NO_TREE = frozenset("html body main b i em strong span code a u s sub sup small mark abbr cite q font math mi mn mo".split())
_DIGITS = re.compile("[0-9]+")


def _normal(text: str) -> str:
    """White space squeezed and digit runs as one class, so counters and dates don't hide a template."""
    return _DIGITS.sub("#", " ".join(text.split()))


def subtrees(markup: str) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the element subtrees of cleaned markup, inner ones first.

    Unclosed elements end with their parent. A subtree's hash is of its opening tag, its text and
    the hashes of its children, so each character is hashed once, however deep the page.
    """
    out: list[tuple[int, int, int]] = []
    names: list[str] = []
    starts: list[int] = []
    parts: list[list[str]] = [[]]
    open_: Counter = Counter()
    at = 0

    def close(end: int) -> None:
        name, start, mine = names.pop(), starts.pop(), parts.pop()
        open_[name] -= 1
        h = xxhash.xxh3_64_intdigest("\x1f".join(mine).encode("utf-8", "surrogatepass"))
        if name not in _NO_TREE:
            out.append((start, end, h - (1 << 64) if h >= 1 << 63 else h))
        parts[-1].append(str(h))

    for m in _ELEMENT.finditer(markup):
        s, e = m.span()
        if s > at and (text := markup[at:s]) and not text.isspace():
            parts[-1].append(_normal(text))
        at = e
        name = m[2].lower()
        if m[1]:
            if open_[name]:
                while names[-1] != name:
                    close(s)
                close(e)
        elif name in _VOID:
            parts[-1].append(_normal(m[0]))
        else:
            while names and names[-1] in _IMPLIED.get(name, ()):
                close(s)
            names.append(name)
            starts.append(s)
            open_[name] += 1
            parts.append([_normal(m[0])])
    if at < len(markup) and not markup[at:].isspace():
        parts[-1].append(_normal(markup[at:]))
    while names:
        close(len(markup))
    return out


def _enclosing(trees: list[tuple[int, int, int]]):
    """A function from a position to the hashes of the subtrees around it, outermost first."""
    order = sorted(trees, key=lambda t: (t[0], -t[1]))
    starts = [t[0] for t in order]
    parent: list[int] = []
    stack: list[int] = []
    for i, (a, _, _) in enumerate(order):
        while stack and order[stack[-1]][1] <= a:
            stack.pop()
        parent.append(stack[-1] if stack else -1)
        stack.append(i)

    def around(pos: int) -> list[int]:
        i = bisect_right(starts, pos) - 1
        while i >= 0 and order[i][1] <= pos:
            i = parent[i]
        chain = []
        while i >= 0:
            chain.append(order[i][2])
            i = parent[i]
        return chain[::-1]

    return around


def _without_code(markup: str) -> str:
    """Markup of equal length with code blanked out; preformatted code ends a block."""
    return CODE.sub(lambda m: "<hr" + " " * (len(m[0]) - 4) + ">" if m[1].lower() == "pre" else " " * len(m[0]), markup)


def page_trees(cache: DataFrame) -> DataFrame:
    """``page_id, trees, suspects``: subtree hashes, and the blocks that hold a character of some markup.

    A suspect is a block's text outside code, not yet judged, with the subtrees around it, outermost
    first. Null and empty html give empty arrays.
    """

    def one(html: str) -> tuple[list, list]:
        markup = body_markup(html)
        trees = subtrees(markup)
        plain = _without_code(markup)
        suspects, around, seen = [], None, set()
        for text, at in split_at(plain):
            if _HINT.search(text):
                around = around or _enclosing(trees)
                chain = around(at)[:CHAIN]
                if (text, tuple(chain)) not in seen:
                    seen.add((text, tuple(chain)))
                    suspects.append({"text": text, "around": chain})
        return list(dict.fromkeys(h for _, _, h in trees)), suspects

    def fn(b, _):
        got = [one(h) if h else ([], []) for h in b.column(1).to_pylist()]
        return {"page_id": b.column(0).to_pylist(), "trees": [g[0] for g in got], "suspects": [g[1] for g in got]}

    return map_arrow(cache.select("page_id", "html"), fn, "page_id bigint, trees array<bigint>, suspects array<struct<text:string,around:array<bigint>>>")


def site_templates(trees: DataFrame, hosts: DataFrame, min_urls: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, tree``: subtrees on at least ``min_urls`` addresses and ``min_share`` of the host's addresses.

    Addresses count, not records: a page fetched again and again is one address, so its own text
    is no template.
    """
    t = trees.join(hosts.select("page_id", "host", F.xxhash64("url").alias("u")), "page_id").select("host", "u", "trees")
    need = t.select("host", "u").distinct().groupBy("host").agg(F.greatest(F.lit(min_urls), F.ceil(F.count("*") * min_share - 1e-9)).alias("need"))
    # Pages bound addresses: what stands on too few pages is dropped before addresses are told apart.
    hot = hot_hosts(t)
    n = t.select("host", F.explode("trees").alias("tree")).groupBy("host", "tree").agg(F.count("*").alias("n"))
    some = for_each_part(n.join(need, "host").where("n >= need").select("host", "tree", "need"), hot, "host")
    per = split_rows(t.select("host", "u", F.explode("trees").alias("tree")), hot, "host", "u").join(some, ["host", "tree", "_salt"]).select("host", "tree", "need", "u").distinct()
    return per.groupBy("host", "tree", "need").agg(F.count("*").alias("urls")).where("urls >= need").select("host", "tree")


def known_trees(templates: DataFrame) -> DataFrame:
    """``host, known``: a host's template subtrees as one array.

    A subtree stands on a fifth of the host's addresses at least, so there are at most five times as
    many as a page has subtrees on average: the array is bounded.
    """
    return templates.groupBy("host").agg(F.collect_set("tree").alias("known"))


def found(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, field, kind``: pages and titles that show source markup.

    Template subtrees are taken out of the pages: what they hold is judged once per host, subtree
    and text, and the verdict goes to each page that holds them. What is left of a page is judged
    on its own. Pages of unknown host have no templates. Null and empty html show nothing.
    """
    hosts = materialise(page_hosts(pages))
    hot = hot_hosts(hosts)
    trees = materialise(page_trees(cache))
    per_host = for_each_part(known_trees(site_templates(trees, hosts)), hot, "host")
    some = trees.where(F.size("suspects") > 0).select("page_id", F.explode("suspects").alias("s")).select("page_id", "s.text", "s.around")
    some = split_rows(some.join(hosts.select("page_id", "host"), "page_id", "left"), hot, "host", "page_id").join(per_host, ["host", "_salt"], "left")
    tree = F.try_element_at(F.filter("around", lambda t: F.array_contains("known", t)), F.lit(1))
    some = materialise(some.select("page_id", "host", "_salt", "text", tree.alias("tree")))
    # One row per host, subtree and text stands for all pages that hold them.
    inside = some.where("tree is not null").withColumn("t", F.xxhash64("text"))
    once = inside.groupBy("host", "tree", "t").agg(F.min("text").alias("text"))
    shown = _judge(once.select(F.struct("host", "tree", "t").alias("k"), "text"), "k struct<host:string,tree:bigint,t:bigint>")
    shown = for_each_part(shown.select("k.host", "k.tree", "k.t", "kind"), hot, "host")
    judged = inside.select("page_id", "host", "tree", "t", "_salt").join(shown, ["host", "tree", "t", "_salt"]).select("page_id", "kind")
    left = _judge(some.where("tree is null").select("page_id", "text"), "page_id bigint")
    body = judged.unionByName(left).select("page_id", F.lit("html").alias("field"), "kind")
    return body.unionByName(dirty_titles(pages)).distinct()


def _judge(texts: DataFrame, key: str) -> DataFrame:
    """The key with each kind of markup its text shows."""
    name = key.split(" ")[0]

    def fn(b, memo):
        out: dict = {name: [], "kind": []}
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for kind in memo[t]:
                out[name].append(k)
                out["kind"].append(kind)
        return out

    return map_arrow(texts, fn, f"{key}, kind string", lambda: Memo(residue_kinds))


def dirty_titles(pages: DataFrame) -> DataFrame:
    """``page_id, field, kind`` for titles that show markup as stored; null titles give nothing."""

    def fn(b, memo):
        out: dict = {"page_id": [], "field": [], "kind": []}
        for pid, title in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k in memo[title]:
                out["page_id"].append(pid)
                out["field"].append("title")
                out["kind"].append(k)
        return out

    some = pages.where(F.col("title").rlike(r"[<&*_`#\[{$\\|~=']|-->|^> ")).select("page_id", "title")
    return map_arrow(some, fn, "page_id bigint, field string, kind string", lambda: Memo(residue_kinds))


# ---- clean text

_LINE_RULES = [
    (re.compile(r"<!--.*?(?:-->|$)", re.S), ""),
    (re.compile(r"\{\{[^{}|]*\|[^{}]*\}\}"), ""),
    (re.compile(r"__(?:NO|FORCE|NEW)?(?:TOC|EDITSECTION|GALLERY|SECTIONLINK|INDEX|NOINDEX)__"), ""),
    (re.compile(r"\[\[(?:Category|File|Image):[^\]]*\]\]"), ""),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"'{2,5}([^']+)'{2,5}"), r"\1"),
    (re.compile(r"(?<!\S)(={2,6}) ?([^=]+?) ?\1(?!\S)"), lambda m: "\n" + "#" * (len(m[1]) - 1) + " " + m[2] + "\n"),
    (re.compile(r"!\[([^\[\]]*)\]\([^()]*\)"), r"\1"),
    (re.compile(r"\[([^\[\]]*)\]\([^()]*\)"), r"\1"),
    (re.compile(r"\*\*([^*]+)\*\*|~~([^~]+)~~|(?<!\w)__([^_]+)__(?!\w)"), lambda m: m[1] or m[2] or m[3]),
    (re.compile(r"\\begin\{tabular\}\{[^}]*\}|\\(?:begin|end)\{\w+\*?\}|\\(?:hline|maketitle|noindent)\b"), ""),
    (re.compile(r"\\item\b ?"), "\n- "),
    (re.compile(r"\\(?:sub){0,2}(?:section|title|chapter)\*?\{([^{}]*)\}"), r"\n# \1\n"),
    (re.compile(r"\\(?:cite[tp]?|ref|eqref|label|footnote)\{[^{}]*\}~?"), ""),
    (re.compile(r"\\(?:emph|textbf|textit|texttt|textsc|underline|url|title)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\{\\(?:it|bf|em|tt|sc|rm)\s+([^{}]*)\}"), r"\1"),
]


def clean_line(text: str) -> str:
    """A line of text with residue turned into plain text; formulas and code stay as they are."""
    if not _HINT.search(text):
        return text
    kinds = residue_kinds(text)
    if not kinds:
        return text
    if "html" in kinds:
        text = re.sub(r"<br\s*/?>", "\n", text, flags=re.I)
        text = unescape(_TAG.sub("", text))
    keep: list[str] = []

    def hold(m: re.Match) -> str:
        keep.append(m[0])
        return f"\x00{len(keep) - 1}\x00"

    text = re.sub(r"```.*?```|`[^`]+`|\$\$[^$]+\$\$|\$[^$]+\$|\\\[.*?\\\]", hold, text, flags=re.S)
    for rule, new in _LINE_RULES:
        text = rule.sub(new, text)
    text = re.sub("\x00(\\d+)\x00", lambda m: keep[int(m[1])], text)
    return "\n".join(x.strip() for x in text.split("\n") if x.strip())


_PRE = re.compile(r"<pre(?=[\s>/])(?:" + _ATTRS + r")(.*?)(?:</pre\s*>|\Z)", re.S | re.I)
_FORMULA = re.compile(r"<math(?=[\s>/])(?:" + _ATTRS + r")(.*?)(?:</math\s*>|\Z)", re.S | re.I)
_CELL = re.compile(r"<(?:td|th)(?=[\s>/])(?:" + _ATTRS + ")", re.I)
_ROW = re.compile(r"<tr(?=[\s>/])(?:" + _ATTRS + ")", re.I)
_H = re.compile(r"<h([1-6])(?=[\s>/])(?:" + _ATTRS + ")", re.I)
_LI = re.compile(r"<li(?=[\s>/])(?:" + _ATTRS + ")", re.I)
_INNER_TAG = re.compile(r"</?[a-zA-Z](?:" + _ATTRS + ")")


_MARK = re.compile("[\x03\x04](\\d+);")


def _marked(markup: str, trees: list[tuple[int, int, int]]) -> str:
    """Markup with a mark where the text of each subtree begins (\\x03) and after it ends (\\x04); none begins inside code or formulas."""
    whole = [m.span() for m in (*_PRE.finditer(markup), *_FORMULA.finditer(markup))]
    starts = sorted(whole)
    at: list[tuple[int, int, str]] = []
    for i, (a, b, _) in enumerate(trees):
        k = bisect_right(starts, (a, len(markup) + 1)) - 1
        if k < 0 or not starts[k][0] < a < starts[k][1]:
            at += (_ELEMENT.match(markup, a).end(), 1, f"\x03{i};"), (b, 0, f"\x04{i};")
    out, last = [], 0
    for pos, _, mark in sorted(at):
        out += markup[last:pos], mark
        last = pos
    return "".join(out) + markup[last:]


def to_lines(markup: str, trees: list[tuple[int, int, int]] | None = None) -> list[tuple[str, int]]:
    """Clean lines of markup, each with the place in ``trees`` of the innermost subtree around it, -1 for none.

    '# ' headings, '- ' items, '| ' cells, fenced code, '$' formulas, one block per line. A row
    of cells is around by its row, not by its cells.
    """
    code: list[str] = []

    def marks(text: str, kind: str) -> str:
        return "".join(x[0] for x in _MARK.finditer(text) if x[0][0] == kind)

    def fence(m: re.Match) -> str:
        body = unescape(_INNER_TAG.sub("", _MARK.sub("", m[1]))).strip("\n")
        code.append("```\n" + body + "\n```")
        return "<hr>" + marks(m[1], "\x03") + f"\x01{len(code) - 1}\x01" + marks(m[1], "\x04") + "<hr>"

    def formula(m: re.Match) -> str:
        code.append("$" + " ".join(unescape(_INNER_TAG.sub("", _MARK.sub("", m[1]))).split()) + "$")
        return marks(m[1], "\x03") + f"\x01{len(code) - 1}\x01" + marks(m[1], "\x04")

    s = _PRE.sub(fence, _marked(markup, trees) if trees else markup)
    s = _FORMULA.sub(formula, s)
    s = _H.sub(lambda m: "<hr>" + "#" * int(m[1]) + " \x02", s)
    s = _LI.sub("<hr>- \x02", s)
    s = _ROW.sub("<hr>", s)
    s = re.sub(r"</t[dh]\s*>", "", s, flags=re.I)
    s = _CELL.sub(" | ", s)
    out: list[tuple[str, int]] = []
    open_: dict[int, None] = {}
    for b in split_blocks(s):
        text = _MARK.sub("", b)
        line = clean_line(text.replace("\x02", "").replace("  ", " ").strip(" "))
        lead = b.rfind("\x02") + 1
        around = None
        at = 0
        for m in _MARK.finditer(b):
            if around is None and m.start() > lead and b[max(at, lead) : m.start()].strip():
                around = next(reversed(open_), -1)
            at = m.end()
            if m[0][0] == "\x03":
                open_[int(m[1])] = None
            else:
                open_.pop(int(m[1]), None)
        around = next(reversed(open_), -1) if around is None else around
        if line and line.strip("#-| "):
            out.append((re.sub("\x01(\\d+)\x01", lambda m: code[int(m[1])], line), around))
    return out


def in_order(trees: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Places of the subtrees in document order, and per place the last place inside it and the hash."""
    order = sorted(range(len(trees)), key=lambda i: (trees[i][0], -trees[i][1], -i))
    place = [0] * len(trees)
    last = [len(trees) - 1] * len(trees)
    stack: list[int] = []
    for k, i in enumerate(order):
        place[i] = k
        while stack and trees[order[stack[-1]]][1] <= trees[i][0]:
            last[stack.pop()] = k - 1
        stack.append(k)
    return place, last, [trees[i][2] for i in order]


def to_text(markup: str) -> str:
    """Clean text of markup, a line per block; see ``to_lines``."""
    return "\n".join(x for x, _ in to_lines(_unmarked(markup)))


def _unmarked(markup: str) -> str:
    """Markup without the signs that are used as marks."""
    return markup.translate(_MARKS) if any(c in markup for c in "\x01\x02\x03\x04") else markup


_MARKS = dict.fromkeys((1, 2, 3, 4))


def clean_pages(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, text, removed``: each body as clean text without the lines of its host's template subtrees; ``removed`` counts them.

    Pages are parsed once: their lines are written with the subtrees around them, and only these
    meet the page's templates. A line goes when a template subtree is around it. Pages of unknown
    host keep all lines. Null or empty html gives an empty text.
    """

    def fn(b, _):
        out: dict = {"page_id": b.column(0).to_pylist(), "trees": [], "last": [], "text": [], "inner": []}
        for html in b.column(1).to_pylist():
            markup = _unmarked(body_markup(html)) if html else ""
            trees = subtrees(markup)
            place, last, hashes = in_order(trees)
            lines = to_lines(markup, trees)
            out["trees"].append(hashes)
            out["last"].append(last)
            out["text"].append([t for t, _ in lines])
            out["inner"].append([place[i] if i >= 0 else -1 for _, i in lines])
        return out

    schema = "page_id bigint, trees array<bigint>, last array<int>, text array<string>, inner array<int>"
    parsed = materialise(map_arrow(cache.select("page_id", "html"), fn, schema).withColumn("row", F.monotonically_increasing_id()))
    hosts = materialise(page_hosts(pages))
    hot = hot_hosts(hosts)
    per_host = for_each_part(known_trees(site_templates(parsed.select("page_id", F.array_distinct("trees").alias("trees")), hosts)), hot, "host")
    mine = split_rows(parsed.select("page_id", "row", "trees", "last").join(hosts.select("page_id", "host"), "page_id"), hot, "host", "page_id").join(per_host, ["host", "_salt"])
    spans = F.zip_with(F.transform("trees", lambda h, i: F.when(F.array_contains("known", h), i)), "last", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gone = mine.select("row", F.filter(spans, lambda x: x["a"].isNotNull()).alias("gone")).where(F.size("gone") > 0)
    j = parsed.select("page_id", "row", "text", "inner").join(gone, "row", "left")
    inside = lambda at: F.exists("gone", lambda g: (at >= g["a"]) & (at <= g["b"]))
    keep = F.zip_with("text", "inner", lambda t, at: F.when(F.col("gone").isNull() | ~inside(at), t))
    return j.withColumn("kept", F.array_compact(keep)).select("page_id", F.array_join("kept", "\n").alias("text"), (F.size("text") - F.size("kept")).alias("removed"))


def clean_titles(pages: DataFrame) -> DataFrame:
    """``page_id, title, clean``: titles with their markup removed; null stays null."""

    def fn(b, memo):
        t = b.column(1).to_pylist()
        return {"page_id": b.column(0).to_pylist(), "title": t, "clean": [None if x is None else " ".join(memo[x].split()).lstrip("# ") for x in t]}

    return map_arrow(pages.select("page_id", "title"), fn, "page_id bigint, title string, clean string", lambda: Memo(clean_line))
