"""Facts of pages as tables: one parse per page, any number of extractors in the same pass.

Each extractor is a function of (tree, page address) that yields rows as dicts; ``EXTRACTORS``
names it with its row schema. ``extract_many`` runs the named extractors over one parse and
returns their rows as arrays; ``extract`` explodes one of them. Null and empty pages give no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

from pagemill.functions.batches import pieces, spread
from pagemill.functions.dom import HEADINGS, Node, normal, parse
from pagemill.functions.redact import has_sensitive_query
from pagemill.functions.scripts import members as script_members
from pagemill.functions.text import fragment_lines, fragment_text, markdown, readable, words
from pagemill.functions.urls import RAW, crawl_key, effective_base, is_external, normalise, resolve
from pagemill.operators import tables as T

_QUIET = frozenset(("script", "style", "noscript", "template", "svg"))
_JS_TYPES = frozenset("text/javascript application/javascript text/ecmascript application/ecmascript application/x-javascript module text/jscript".split())


def is_javascript(kind: str) -> bool:
    """Whether a script type is executable: absent, or one of the JavaScript media types."""
    k = kind.split(";")[0].strip().lower()
    return not k or k in _JS_TYPES


# ---- structure


def outline(root: Node, url):
    stack: list[tuple[int, int]] = []
    for i, h in enumerate(root.elements(*HEADINGS)):
        level = int(h.tag[1])
        while stack and stack[-1][0] >= level:
            stack.pop()
        yield {"ord": i, "level": level, "title": h.clean(), "id": h.get("id"), "parent_ord": stack[-1][1] if stack else None}
        stack.append((level, i))


def _segments(li: Node) -> list[str]:
    return [s for n in li.walk() if n.tag == "#text" and (s := normal(n.value))]


def lists(root: Node, url, direct: bool = False):
    """Items of every list; all descendant items, or with ``direct`` the direct ones only."""
    for i, lst in enumerate(root.elements("ul", "ol")):
        items = lst.kids("li") if direct else list(lst.elements("li"))
        k = 0
        for li in items:
            seg = _segments(li)
            if seg:
                yield {"list_ix": i, "ordered": lst.tag == "ol", "item_ix": k, "segments": seg}
                k += 1


def direct_lists(root: Node, url):
    return lists(root, url, True)


def table_rows(root: Node, url):
    for t in T.read_tables(root):
        for k, r in enumerate(t["rows"]):
            yield {"table_ix": t["table_ix"], "caption": t["caption"], "row_ix": k, "cells": list(r.items()), "error": None}
        if t["error"]:
            yield {"table_ix": t["table_ix"], "caption": t["caption"], "row_ix": None, "cells": [], "error": t["error"]}


def table_heads(root: Node, url):
    for t in T.read_tables(root):
        kinds = [T.infer_type([r.get(h) for r in t["rows"]]) for h in t["headers"]]
        yield {"table_ix": t["table_ix"], "caption": t["caption"], "id": t["id"], "classes": t["classes"], "headers": t["headers"], "types": kinds, "row_count": len(t["rows"]), "error": t["error"]}


def reversed_tables(root: Node, url):
    for t in T.read_tables(root, reverse=True):
        for r in t["rows"]:
            yield {"table_ix": t["table_ix"], "cells": list(r.items())}


# ---- forms


def _controls(root: Node) -> dict[int, list[Node]]:
    """Controls by the form that owns them: the nearest ancestor, or the one named by ``form=``."""
    forms = list(root.elements("form"))
    by_id = {f.get("id"): f for f in reversed(forms) if f.get("id")}
    out = defaultdict(list)
    for c in root.elements("input", "select", "textarea", "button"):
        f = by_id.get(c.get("form")) if "form" in c.attrs else c.closest("form")
        if f is not None:
            out[f.pre].append(c)
    return out


def _disabled(c: Node) -> bool:
    if "disabled" in c.attrs:
        return True
    for a in c.ancestors():
        if a.tag == "fieldset" and "disabled" in a.attrs:
            first = next(iter(a.kids("legend")), None)
            if first is None or not c.within(first):
                return True
    return False


def _value(c: Node) -> str:
    if c.tag == "textarea":
        return c.text()
    if c.tag == "select":
        opts = list(c.elements("option"))
        pick = next((o for o in opts if "selected" in o.attrs), opts[0] if opts else None)
        return "" if pick is None else pick.get("value", pick.clean())
    return c.get("value", "on" if c.get("type").lower() in ("checkbox", "radio") else "")


def _kind(c: Node) -> str:
    return c.tag if c.tag != "input" and not (c.tag == "button") else (c.get("type") or ("submit" if c.tag == "button" else "text")).lower()


def successful(c: Node) -> list[tuple[str, str]]:
    """Name and value pairs a control submits."""
    kind = _kind(c)
    name = c.get("name")
    if not name or _disabled(c) or kind in ("submit", "button", "reset", "image", "file") or (kind in ("checkbox", "radio") and "checked" not in c.attrs):
        return []
    if c.tag == "select" and "multiple" in c.attrs:
        return [(name, o.get("value", o.clean())) for o in c.elements("option") if "selected" in o.attrs and "disabled" not in o.attrs]
    if c.tag == "select" and c.first("option") is None:
        return []
    return [(name, _value(c))]


def forms(root: Node, url):
    base = effective_base(root, url)
    by = _controls(root)
    for i, f in enumerate(root.elements("form")):
        cs = by.get(f.pre, [])
        yield {
            "form_ix": i, "id": f.get("id"), "name": f.get("name"), "action": _action(f.get("action"), base, url),
            "method": (f.get("method") or "get").upper(), "fields": [{"name": c.get("name"), "type": _kind(c), "value": _value(c)} for c in cs],
            "successful": [{"key": k, "value": v} for c in cs for k, v in successful(c)],
            "login": any(_kind(c) == "password" for c in cs),
            "relay": _relay(f, cs, root),
        }


def _action(raw: str, base, url) -> str:
    """Where a form is sent: its action, else the page; '' where that is no web address."""
    if base is RAW:
        return raw
    a = resolve(raw, base) or (url or "")
    return a if a.lower().startswith(("http:", "https:")) or not base else ""


def _relay(f: Node, cs: list[Node], root: Node) -> str | None:
    """Protocol of a form that submits itself with hidden fields only."""
    shown = [c for c in cs if _kind(c) not in ("hidden", "submit")]
    scripted = any(".submit(" in s.text() for s in root.elements("script")) or "submit" in (root.first("body") or root).get("onload")
    if shown or not cs or not scripted:
        return None
    names = {c.get("name").lower() for c in cs}
    return "saml" if names & {"samlresponse", "samlrequest"} else "wsfed" if "wresult" in names else "generic"


# ---- head, metadata


def meta_tags(root: Node, url):
    for m in root.elements("meta"):
        src = next((a for a in ("name", "property", "itemprop", "http-equiv") if m.get(a).strip()), None)
        name = m.get(src).strip() if src else ""
        if name or m.get("content").strip():
            yield {"name": name, "source_attribute": src or "", "content": m.get("content")}


def open_graph(root: Node, url):
    got: dict[str, list[str]] = {}
    for m in root.elements("meta"):
        p = m.get("property")
        if p.startswith("og:"):
            v = got.setdefault(p[3:], [])
            if m.get("content").strip():
                v.append(m.get("content").strip())
    return [{"name": k, "values": v} for k, v in got.items()]


def _item_value(n: Node) -> str:
    return next((n.get(a).strip() for a in ("content", "href", "src", "data", "value") if n.get(a).strip()), n.clean())


def microdata(root: Node, url):
    for i, item in enumerate(x for x in root.elements() if "itemscope" in x.attrs and "itemprop" not in x.attrs):
        props: dict[str, list[str]] = {}
        for n in item.elements():
            if "itemprop" in n.attrs and next((a for a in n.ancestors() if "itemscope" in a.attrs), None) is item:
                v = _item_value(n)
                if v:
                    for name in n.get("itemprop").split():
                        props.setdefault(name, []).append(v)
        yield {"item_ix": i, "type": item.get("itemtype"), "id": item.get("itemid"), "props": list(props.items())}


#: Properties known of the checked item types.
_KNOWN_PROPS = {
    "Person": "name jobTitle email telephone url image address affiliation alumniOf birthDate familyName givenName worksFor".split(),
    "Product": "name description image brand sku gtin mpn offers aggregateRating review category url price priceCurrency".split(),
}


def microdata_unknown(root: Node, url):
    for r in microdata(root, url):
        kind = r["type"].rstrip("/").rsplit("/", 1)[-1]
        if kind in _KNOWN_PROPS:
            bad = [k for k, _ in r["props"] if k not in _KNOWN_PROPS[kind]]
            if bad:
                yield {"item_ix": r["item_ix"], "type": r["type"], "unknown": bad}


def json_ld(root: Node, url):
    i = 0
    for s in root.elements("script"):
        if s.get("type").split(";")[0].strip().lower() != "application/ld+json":
            continue
        raw = s.text().strip()
        try:
            items = [(it, json.dumps(it, ensure_ascii=False)) for it in _ld_items(json.loads(raw))]
        except (ValueError, RecursionError) as e:
            yield {"item_ix": i, "type": "", "name": "", "raw": raw, "error": str(e)}
            i += 1
            continue
        for it, text in items:
            t = it.get("@type", "") if isinstance(it, dict) else ""
            yield {"item_ix": i, "type": ",".join(map(str, t)) if isinstance(t, list) else str(t or ""), "name": str(it.get("name") or "") if isinstance(it, dict) else "", "raw": text, "error": None}
            i += 1


def _ld_items(v) -> list:
    if isinstance(v, list):
        return [x for y in v for x in _ld_items(y)]
    if isinstance(v, dict) and isinstance(v.get("@graph"), list):
        return [x for y in v["@graph"] for x in _ld_items(y)]
    return [v]


#: Names of metadata whose content is an address; so is that of names ending in ':url' or ':secure_url'.
_META_URLS = frozenset("contenturl embedurl msapplication-starturl msapplication-tileimage msapplication-config og:url og:image og:audio og:video twitter:url twitter:image twitter:player".split())


def _holds_url(r: dict) -> bool:
    name = r["name"].strip().lower()
    return r["tag"] == "link" or name in _META_URLS or name.endswith((":url", ":secure_url"))


def head_links(root: Node, url):
    base = effective_base(root, url)
    head = root.first("head") or root
    for n in head.elements("link", "meta"):
        target = n.get("href") if n.tag == "link" else n.get("content")
        if target.strip():
            r = {"tag": n.tag, "name": n.get("rel") if n.tag == "link" else next((n.get(a) for a in ("name", "property", "http-equiv") if n.get(a)), ""), "value": target, "url": "", "media_type": n.get("type")}
            yield {**r, "url": resolve(target, base) if _holds_url(r) else ""}


def canonical(root: Node, url):
    rows = [{"url": n.get("href")} for n in root.elements("link") if "canonical" in n.get("rel").lower().split()]
    return rows if url is RAW else _first_canonical(rows, effective_base(root, url), url)


def _first_canonical(rows, base, url):
    for r in rows:
        u = resolve(r["url"], base)
        if u.lower().startswith(("http:", "https:")):
            return [{"url": normalise(u)}]
    return []


# ---- links and resources


def links(root: Node, url, max_context: int = 300):
    base = effective_base(root, url)
    for a in root.elements("a", "area"):
        u = resolve(a.get("href"), base)
        if u:
            yield {
                "url": u, "href": a.get("href"), "text": a.clean(_QUIET), "title": normal(a.get("title")), "context": a.parent.clean(_QUIET)[:max_context] if a.parent else "",
                "external": is_external(u, base),
            }


def crawl_links(root: Node, url):
    rows = [{"url": h} for a in root.elements("a", "area") if (h := a.get("href").strip()) and not h.lower().startswith(("javascript:", "mailto:", "tel:"))]
    rows = list({r["url"]: r for r in rows}.values())
    return rows if url is RAW else _distinct_links(rows, effective_base(root, url), url)


def _distinct_links(rows, base, url):
    seen: dict[str, None] = {}
    for r in rows:
        u = resolve(r["url"], base)
        if u.lower().startswith(("http:", "https:")):
            seen.setdefault(crawl_key(u))
    return [{"url": u} for u in seen]


def srcset(value: str) -> list[tuple[str, str]]:
    """(address, descriptor) candidates of a srcset."""
    out = []
    for m in re.finditer(r"\s*,?\s*((?:data:[^\s]+|[^\s,][^\s]*?))(?:\s+([\d.]+[wxh]))?\s*(?:,(?=\s|$)|$)", value or ""):
        out.append((m[1].rstrip(","), m[2] or ""))
    return out


def best_source(value: str) -> str | None:
    """Candidate of greatest density or width; the last of equals."""
    best, top = None, -1.0
    for u, d in srcset(value):
        n = float(d[:-1]) * (10_000 if d.endswith("x") else 1) if d else 10_000.0
        if n >= top:
            best, top = u, n
    return best


def images(root: Node, url):
    base = effective_base(root, url)
    for n in root.elements("img", "source", "link"):
        if n.tag == "link" and not ("preload" in n.get("rel").lower() and n.get("as").lower() == "image"):
            continue
        cand = [(n.get("src") or (n.get("href") if n.tag == "link" else ""), "")] if n.tag != "source" else []
        cand += srcset(n.get("srcset") or n.get("imagesrcset"))
        for u, d in cand:
            if u:
                yield {"tag": n.tag, "url": resolve(u, base), "descriptor": d, "alt": n.get("alt"), "best": u == best_source(n.get("srcset") or n.get("imagesrcset"))}


_ASSET_ATTRS = {"img": ("src",), "script": ("src",), "link": ("href",), "source": ("src",), "video": ("src", "poster"), "audio": ("src",), "iframe": ("src",), "embed": ("src",), "object": ("data",), "track": ("src",), "input": ("src",)}
_ASSET_RELS = frozenset("stylesheet icon shortcut apple-touch-icon manifest preload prefetch modulepreload mask-icon".split())


def crawl_assets(root: Node, url):
    from pagemill.functions.css import urls as css_urls

    rows: dict[tuple, dict] = {}

    def take(value: str, kind: str) -> None:
        if value.strip():
            rows.setdefault((value, kind), {"url": value, "kind": kind})

    for n in root.elements():
        if n.tag == "link" and not _ASSET_RELS & set(n.get("rel").lower().split()):
            continue
        for a in _ASSET_ATTRS.get(n.tag, ()):
            take(n.get(a), n.tag)
        for u, _ in srcset(n.get("srcset")):
            take(u, "srcset")
        for u in css_urls(n.text() if n.tag == "style" else n.get("style")):
            take(u, "css")
        if n.tag == "noscript":
            for m in parse(n.text()).elements("img"):
                take(m.get("src"), "noscript")
    return list(rows.values()) if url is RAW else _distinct_assets(rows.values(), effective_base(root, url), url)


def _distinct_assets(rows, base, url):
    seen: dict[str, str] = {}
    for r in rows:
        u = resolve(r["url"], base)
        if u.lower().startswith(("http:", "https:")):
            seen.setdefault(u.split("#")[0], r["kind"])
    return [{"url": u, "kind": k} for u, k in seen.items()]


def resources(root: Node, url):
    """Scripts and style sheets with the comment that stands before them."""
    i = 0
    comment = ""
    for n in root.walk():
        if n.tag == "#comment":
            comment = normal(n.value)
        elif n.tag in ("script", "style") or n.tag == "link" and "stylesheet" in n.get("rel").lower():
            src = n.get("src") if n.tag == "script" else n.get("href")
            yield {"ord": i, "type": "script" if n.tag == "script" else "style", "source": resolve(src, effective_base(root, url)) if src else "", "inline": "" if src else n.text(), "comment": comment, "name": src.rstrip("/").rsplit("/", 1)[-1].split("?")[0] if src else ""}
            i += 1
            comment = ""
        elif n.tag not in ("#text", "#document"):
            comment = ""


def scripts(root: Node, url):
    base = effective_base(root, url)
    for i, s in enumerate(root.elements("script")):
        t = s.get("type")
        yield {"script_ix": i, "src": resolve(s.get("src"), base) if s.get("src") else "", "type": t, "javascript": is_javascript(t), "module": t.lower() == "module", "inline_length": 0 if s.get("src") else len(s.text())}


# ---- scripts, state, tokens, endpoints

_STATE_NAMES = ("__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__", "__APOLLO_STATE__", "__PRELOADED_STATE__", "__REDUX_STATE__", "__remixContext", "__APP_STATE__", "__SVELTEKIT_DATA__")
_CONFIG_NAMES = (*_STATE_NAMES, "config", "settings", "dataLayer", "appConfig", "ENV", "env")


def balanced(text: str, at: int) -> str | None:
    """The bracketed literal that begins at ``at``, strings respected."""
    if at >= len(text) or text[at] not in "{[":
        return None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            i += 1
            while i < len(text) and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif c in "{[(":
            depth += 1
        elif c in "}])":
            depth -= 1
            if not depth:
                return text[at : i + 1]
        i += 1
    return None


_JS_STRING = re.compile(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|`((?:[^`\\$]|\\.)*)`")


def js_literal(text: str):
    """Value of a JavaScript literal (JSON with bare keys, single quotes, trailing commas, undefined); ValueError for code."""
    out, at = [], 0
    for m in _JS_STRING.finditer(text):
        out.append(_js_plain(text[at : m.start()]))
        body = next(g for g in m.groups() if g is not None)
        body = re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", body)
        body = re.sub(r"\\(['`$])", r"\1", body).replace("\\v", "\\u000b").replace("\\0", "\\u0000")
        out.append('"' + re.sub(r'(?<!\\)"', '\\"', body).replace("\n", "\\n") + '"' if m[2] is None else '"' + body + '"')
        at = m.end()
    out.append(_js_plain(text[at:]))
    return json.loads("".join(out))


def _js_plain(s: str) -> str:
    s = re.sub(r"/\*.*?\*/|//[^\n]*", " ", s, flags=re.S)
    s = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)", r'\1"\2"\3', s)
    s = re.sub(r",(\s*[}\]])", r"\1", s)
    return re.sub(r"\bundefined\b|\bNaN\b", "null", re.sub(r"!0\b", "true", re.sub(r"!1\b", "false", s)))


_ASSIGN = re.compile(r"(?:\b(?:var|let|const)\s+|(?<![\w$.\]])|\bwindow\.|\bself\.|\bglobalThis\.)([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*|\[\s*[\"'][^\"']+[\"']\s*\])*)\s*=(?![=>])\s*")
_SCALAR = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\$]|\\.)*`|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|undefined\b|![01]\b")


def member_path(text: str) -> str:
    """``a["b"].c`` as ``a.b.c``."""
    return re.sub(r"^(?:window|self|globalThis)\.", "", re.sub(r"\[\s*[\"']([^\"']+)[\"']\s*\]", r".\1", text))


def js_variables(script: str) -> list[tuple[str, str]]:
    """(path, JSON) of declarations and assignments whose value is a literal."""
    out = []
    for m in _ASSIGN.finditer(script):
        lit = balanced(script, m.end())
        if lit is None:
            s = _SCALAR.match(script, m.end())
            lit = s[0] if s else None
        if lit is None:
            p = re.compile(r"JSON\.parse\(\s*").match(script, m.end())
            s = _SCALAR.match(script, p.end()) if p else None
            if s:
                try:
                    out.append((member_path(m[1]), json.dumps(json.loads(js_literal(s[0])), ensure_ascii=False)))
                except (ValueError, TypeError, RecursionError):
                    pass
            continue
        try:
            out.append((member_path(m[1]), json.dumps(js_literal(lit), ensure_ascii=False)))
        except (ValueError, RecursionError):
            continue
    return out


def _page_scripts(root: Node):
    for i, s in enumerate(root.elements("script")):
        if not s.get("src") and is_javascript(s.get("type")):
            yield i, s


def javascript(root: Node, url):
    for i, s in _page_scripts(root):
        for name, value in js_variables(s.text()):
            yield {"script_ix": i, "name": name, "value": value}


def app_state(root: Node, url):
    for i, s in enumerate(root.elements("script")):
        if s.get("id") in _STATE_NAMES:
            try:
                state = json.dumps(json.loads(s.text()), ensure_ascii=False)
            except (ValueError, RecursionError):
                continue
            yield {"name": s.get("id"), "source": "id", "json": state}
        elif not s.get("src") and is_javascript(s.get("type")):
            for name, value in js_variables(s.text()):
                if name in _STATE_NAMES:
                    yield {"name": name, "source": "assignment", "json": value}


def js_config(root: Node, url):
    seen = set()
    for r in javascript(root, url):
        if r["name"].split(".")[0] in _CONFIG_NAMES and (r["name"], r["value"]) not in seen:
            seen.add((r["name"], r["value"]))
            yield r


def script_data(root: Node, url):
    for i, s in enumerate(root.elements("script")):
        t = s.get("type").split(";")[0].strip().lower()
        if t in ("importmap", "speculationrules", "application/json") or t.endswith("+json"):
            raw = s.text().strip()
            try:
                json.loads(raw)
                ok = True
            except (ValueError, RecursionError):
                ok = False
            yield {"script_ix": i, "type": t, "id": s.get("id"), "json": raw, "valid": ok}


#: Words that tell the name of a token.
_TOKEN_WORDS = "csrf|xsrf|token|nonce|authenticity|verification"
_TOKEN_NAME = re.compile(_TOKEN_WORDS, re.I)
_TOKEN_JS = re.compile(rf"([\"'])([A-Za-z0-9_-]*(?:{_TOKEN_WORDS})[A-Za-z0-9_-]*)\1\s*[:=]\s*[\"']([^\"']+)[\"']|([A-Za-z0-9_-]*(?:{_TOKEN_WORDS})[A-Za-z0-9_-]*)\s*[:=]\s*[\"']([^\"']+)[\"']", re.I)


def tokens(root: Node, url):
    """Token-like values of inputs, metadata, data-token and nonce attributes, then of scripts, in document order."""
    for n in root.elements():
        if "data-token" in n.attrs or "nonce" in n.attrs or n.tag == "input" and "name" in n.attrs or n.tag == "meta" and ("name" in n.attrs or "property" in n.attrs):
            name = next((n.get(a) for a in ("name", "property") if a in n.attrs), "data-token" if "data-token" in n.attrs else "nonce")
            value = next((n.get(a) for a in ("value", "content", "data-token", "nonce") if a in n.attrs), "")
            if value.strip() and _TOKEN_NAME.search(name):
                yield {"name": name, "value": value, "source": n.tag}
    for s in root.elements("script"):
        for m in _TOKEN_JS.finditer(s.text()):
            if (m[3] or m[5]).strip():
                yield {"name": m[2] or m[4], "value": m[3] or m[5], "source": "script"}


_CALL = re.compile(
    r"(?P<client>fetch|axios(?:\.(?P<m1>get|post|put|patch|delete|head|request))?|\$\.(?P<m2>get|post|ajax|getJSON)|\w+\.open)\(\s*(?:[\"'](?P<m3>GET|POST|PUT|PATCH|DELETE|HEAD)[\"']\s*,\s*)?[\"'`](?P<url>[^\"'`\s]+)[\"'`](?P<tail>[^;]{0,200})", re.I
)
_URLISH = re.compile(r"[\"'`]((?:https?:)?//[^\"'`\s]+|/[^\"'`\s/][^\"'`\s]*)[\"'`]")
_ENDPOINT = re.compile(r"/api(?:/|$|\?)|/v\d+(?:/|$)|graphql|\.json(?:$|\?)|/rest/|/ajax/|/rpc(?:/|$)|/oauth|/services?/", re.I)


def looks_like_endpoint(value: str) -> bool:
    return bool(_ENDPOINT.search(value))


def endpoints_of(script: str) -> list[dict]:
    """Distinct calls and endpoint-like addresses of a script, first occurrence first."""
    out: dict = {}
    for m in _CALL.finditer(script):
        client = m["client"].lower()
        kind = (m["m3"] or m["m1"] or m["m2"] or "").upper()
        told = re.search(r"method\s*:\s*[\"'](\w+)", m["tail"], re.I)
        method = told[1].upper() if told else {"GETJSON": "GET", "AJAX": "", "REQUEST": ""}.get(kind, kind)
        op = re.search(r"(?:query|mutation)\s+(\w+)", m["tail"])
        r = {"method": method or ("GET" if client == "fetch" else ""), "url": m["url"], "client": "xhr" if client.endswith(".open") else client.split(".")[0], "operation": op[1] if op else ""}
        out.setdefault((r["method"].lower(), r["url"].lower(), r["client"], r["operation"].lower()), r)
    known = {k[1] for k in out}
    for m in _URLISH.finditer(script):
        if looks_like_endpoint(m[1]) and m[1].lower() not in known:
            known.add(m[1].lower())
            out[("", m[1].lower(), "", "")] = {"method": "", "url": m[1], "client": "literal", "operation": ""}
    return list(out.values())


def endpoints(root: Node, url):
    for i, s in _page_scripts(root):
        for r in endpoints_of(s.text()):
            yield {"script_ix": i, **r}


_STATE_CHANGING = ("POST", "PUT", "PATCH", "DELETE")
def api_inventory(root: Node, url):
    """Endpoints, forms and linked endpoints with a risk and its reasons."""
    base = effective_base(root, url)
    rows = [{"kind": "javascript", "method": r["method"], "resolved_url": r["url"], "name": r["operation"], "risk": "", "reasons": []} for r in endpoints(root, url)]
    rows += [{"kind": "form", "method": f["method"], "resolved_url": f["action"], "name": f["name"] or f["id"], "risk": "", "reasons": []} for f in forms(root, RAW)]
    return rows if url is RAW else _assessed(rows, base, url)


def _assessed(rows, base, url):
    out: dict = {}
    for r in rows:
        method, raw = r["method"], r["resolved_url"]
        raw = _action(raw, base, url) if r["kind"] == "form" else raw
        full = resolve(raw, base) or raw
        reasons = [
            x for x, on in (
                ("state-changing", method in _STATE_CHANGING), ("sensitive-query", has_sensitive_query(full)), ("external", is_external(full, base)),
                ("auth", bool(re.search(r"auth|login|token|session", full, re.I))), ("unknown-method", not method),
            ) if on
        ]
        risk = "High" if {"state-changing", "sensitive-query"} & set(reasons) else "Medium" if reasons else "Low"
        out.setdefault((r["kind"], method, full.lower(), r["name"].lower()), {**r, "resolved_url": full, "risk": risk, "reasons": reasons})
    rank = {"High": 0, "Medium": 1, "Low": 2}
    return sorted(out.values(), key=lambda r: (rank[r["risk"]], r["kind"], r["resolved_url"]))


_FLIGHT = re.compile(r"self\.__next_f\.push\(\s*")


def flight_rows(root: Node, url):
    """Rows of a streamed component payload: hex id, optional tag, length-prefixed or line-terminated data."""
    import base64

    parts: list[tuple[int, str]] = []
    k = 0
    for _, s in _page_scripts(root):
        text = s.text()
        for m in _FLIGHT.finditer(text):
            lit = balanced(text, m.end())
            try:
                v = js_literal(lit) if lit else None
                if isinstance(v, list) and len(v) > 1 and isinstance(v[1], str):
                    parts.append((k, base64.b64decode(v[1]).decode("utf-8", "replace") if v[0] == 3 else v[1]))
                    k += 1
            except (ValueError, RecursionError):
                continue
    data = "".join(p for _, p in parts).encode()
    ends, n = [], 0
    for k, p in parts:
        n += len(p.encode())
        ends.append((n, k))
    at = i = 0
    while at < len(data):
        m = re.compile(rb"([0-9a-fA-F]*):([A-Z]?)").match(data, at)
        if not m:
            break
        start = m.end()
        sized = re.compile(rb"([0-9a-fA-F]+),").match(data, start) if m[2] in (b"T", b"A", b"O", b"V") else None
        if sized:
            stop = sized.end() + int(sized[1], 16)
            body, nxt = data[sized.end() : stop], stop
        else:
            stop = data.find(b"\n", start)
            stop = len(data) if stop < 0 else stop
            body, nxt = data[start:stop], stop + 1
        text = body.decode("utf-8", "replace")
        try:
            json.loads(text)
            js = text
        except (ValueError, RecursionError):
            js = None
        # Numbers past 64 bits can't be told apart as numbers; they share the id -1.
        yield {"row_ix": i, "id": int(m[1] or b"0", 16) if len(m[1]) <= 15 else -1, "tag": m[2].decode(), "data": text, "json": js, "complete": stop <= len(data), "payload_ix": next((k for e, k in ends if at < e), -1)}
        i += 1
        at = nxt


# ---- documentation blocks


def code_blocks(root: Node, url):
    for i, p in enumerate(root.elements("pre")):
        code = p.first("code")
        names = (code or p).classes() + p.classes()
        lang = next((x.split("-", 1)[1] for x in names if x.startswith(("language-", "lang-", "highlight-"))), (code or p).get("data-lang"))
        text = p.text().strip("\n")
        yield {"block_ix": i, "language": lang, "code": text, "lines": text.count("\n") + 1 if text else 0, "kind": _sample_kind(text)}


def _sample_kind(text: str) -> str:
    t = text.lstrip()
    if re.match(r"(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) \S+", t) or t.startswith("HTTP/"):
        return "http"
    if re.match(r"(?:\$ )?curl\b", t):
        return "curl"
    if t[:1] in "{[":
        try:
            json.loads(t)
            return "json"
        except (ValueError, RecursionError):
            return "code"
    return "markup" if t.startswith("<") else "shell" if re.match(r"(?:\$|>|PS>) ", t) else "code"


def breadcrumbs(root: Node, url):
    base = effective_base(root, url)
    k = 0
    for n in root.elements():
        names = f"{n.get('class')} {n.get('id')} {n.get('aria-label')} {n.get('itemtype')}".lower()
        if "breadcrumb" in names and not any("breadcrumb" in f"{a.get('class')} {a.get('id')} {a.get('aria-label')} {a.get('itemtype')}".lower() for a in n.ancestors()):
            parts = [x for x in n.elements("a", "li", "span") if not any(True for _ in x.elements("a", "li", "span")) and x.clean()]
            for j, x in enumerate(parts):
                yield {"trail_ix": k, "item_ix": j, "label": x.clean(), "url": resolve(x.get("href"), base)}
            k += 1


def faq(root: Node, url):
    for d in root.elements("details"):
        s = next(iter(d.kids("summary")), None)
        if s is not None:
            q = s.clean()
            a = normal(" ".join(c.text() if c.tag != "#text" else c.value for c in d.children if c is not s))
            if q and a:
                yield {"question": q, "answer": a, "source": "details"}
    for item in root.elements():
        if item.get("itemtype").rstrip("/").endswith("/Question"):
            q = next((n.clean() for n in item.elements() if n.get("itemprop") == "name"), "")
            a = next((n.clean() for n in item.elements() if n.get("itemprop") == "text"), "")
            if q and a:
                yield {"question": q, "answer": a, "source": "microdata"}


def spec_tables(root: Node, url):
    """Tables of two columns read as key and value."""
    for i, t in enumerate(root.elements("table")):
        rows = [r.kids("td", "th") for r, _, _ in T.owned_rows(t)]
        rows = [r for r in rows if r]
        if rows and all(len(r) == 2 for r in rows):
            for k, (a, b) in enumerate(rows):
                if a.clean() and b.clean():
                    yield {"table_ix": i, "row_ix": k, "name": a.clean(), "value": b.clean()}


_CALLOUT = re.compile(r"(?:^|[\s_-])(note|warning|tip|caution|danger|important|info|alert|admonition|callout)(?:$|[\s_-])", re.I)


def callouts(root: Node, url):
    for n in root.elements("div", "aside", "blockquote", "section", "p"):
        m = _CALLOUT.search(f"{n.get('class')} {n.get('role')}")
        if m and n.clean() and not any(_CALLOUT.search(f"{a.get('class')} {a.get('role')}") for a in n.ancestors()):
            title = next((h.clean() for h in n.elements(*HEADINGS, "strong") if h.clean()), "")
            yield {"kind": m[1].lower(), "title": title, "text": n.clean()}


#: Layout kinds and the elements and roles that show them, in order of precedence.
_REGIONS = (("header", ("header",), "banner"), ("navigation", ("nav",), "navigation"), ("main", ("main",), "main"), ("article", ("article",), "article"), ("aside", ("aside",), "complementary"), ("footer", ("footer",), "contentinfo"))


def layout(root: Node, url):
    got = defaultdict(list)
    for n in root.elements():
        for kind, tags, role in _REGIONS:
            if n.tag in tags or n.get("role").lower() == role:
                if not (kind == "navigation" and "breadcrumb" in f"{n.get('class')} {n.get('aria-label')}".lower()):
                    got[kind].append(n)
                break
    for kind, _, _ in _REGIONS:
        for n in sorted(got[kind], key=lambda x: (-words(x.text()), x.pre))[:4]:
            yield {"kind": kind, "tag": n.tag, "id": n.get("id"), "words": words(n.text(_QUIET)), "links": sum(1 for _ in n.elements("a")), "total": len(got[kind])}


_INTENT = (("buy", r"buy|cart|order|checkout"), ("signup", r"sign ?up|register|join|start"), ("login", r"log ?in|sign ?in"), ("download", r"download|install"), ("contact", r"contact|demo|talk"), ("learn", r"learn|read|docs|guide"))


#: Fixed value: primary actions of a page.
MOST_ACTIONS = 8


def actions(root: Node, url):
    base = effective_base(root, url)
    out = []
    for n in root.elements("a", "button", "input"):
        label = n.clean() or n.get("value") or n.get("aria-label")
        if not label or n.tag == "input" and n.get("type").lower() not in ("submit", "button"):
            continue
        intent = next((k for k, rx in _INTENT if re.search(rx, label, re.I)), "")
        score = (30 if n.tag != "a" else 0) + (25 if intent else 0) + (20 if re.search(r"btn|button|cta|primary", n.get("class"), re.I) else 0) - (25 if n.closest("nav", "footer") else 0) - (10 if len(label) > 40 else 0)
        if score >= 20:
            out.append({"label": label, "url": resolve(n.get("href"), base), "intent": intent, "score": score, "pre": n.pre})
    return [{k: v for k, v in r.items() if k != "pre"} for r in sorted(out, key=lambda r: (-r["score"], r["pre"]))[:MOST_ACTIONS]]


_METHOD_LINE = re.compile(r"^\s*(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S*|https?://\S+)", re.M)


def doc_endpoints(root: Node, url):
    """Endpoints a documentation page describes: method and path of headings and code."""
    seen = set()
    for n in root.elements(*HEADINGS, "code", "pre"):
        for m in _METHOD_LINE.finditer(n.text()):
            if (m[1], m[2]) not in seen:
                seen.add((m[1], m[2]))
                section = n
                text = ""
                if n.tag in HEADINGS and n.parent is not None:
                    after = n.parent.children[n.parent.children.index(n) + 1 :]
                    text = next((x.clean() for x in after if x.tag == "p" and x.clean()), "")
                path = re.sub(r"^https?://[^/]+", "", m[2]).split("?")[0]
                params = re.findall(r"\{(\w+)\}|:(\w+)", path)
                summary = n.clean() if n.tag in HEADINGS else ""
                score = 25 + (15 if path.startswith("/") else 0) + (20 if text else 0) + (10 if params else 0) + (10 if section.tag in HEADINGS else 0)
                yield {"method": m[1], "path": path, "summary": text or summary, "parameters": [a or b for a, b in params], "score": score, "promoted": score >= 45}


# ---- whole-page values


def statistics(root: Node, url):
    body = root.first("body") or root
    yield {
        "words": words(body.text(_QUIET)), "links": sum(1 for _ in root.elements("a")), "images": sum(1 for _ in root.elements("img")), "elements": sum(1 for _ in root.elements()),
        "headings": sum(1 for _ in root.elements(*HEADINGS)), "paragraphs": sum(1 for _ in root.elements("p")), "tables": sum(1 for _ in root.elements("table")),
        "lists": sum(1 for _ in root.elements("ul", "ol")), "forms": sum(1 for _ in root.elements("form")), "scripts": sum(1 for _ in root.elements("script")),
        "depth": max((n.depth for n in root.walk()), default=0),
    }


def page_text(root: Node, url):
    t = root.first("title")
    html = root.first("html")
    body = root.first("body") or root
    yield {"title": t.clean() if t else "", "lang": html.get("lang") if html else "", "text": fragment_text(body), "lines": fragment_lines(body), "markdown": markdown(body, effective_base(root, url))}


def readable_rows(root: Node, url):
    yield readable(root)


def publication_dates(root: Node, url):
    """Publication and change dates of the page's metadata, else of the one article bound to it; several values give none."""
    metas = defaultdict(list)
    for m in root.elements("meta"):
        for a in ("property", "name", "itemprop"):
            if m.get(a):
                metas[m.get(a).lower()].append(m.get("content").strip())
    pub = _only(v for k in ("article:published_time", "published_time", "pubdate", "datepublished") for v in metas[k])
    mod = _only(v for k in ("article:modified_time", "last-modified", "modified_time", "datemodified") for v in metas[k])
    rows = [{"published": pub, "modified": mod, "bound": None}]
    for r in json_ld(root, url):
        if r["error"] is None and re.search(r"Article|Posting", r["type"]):
            v = json.loads(r["raw"])
            to = v.get("mainEntityOfPage") or v.get("url") or ""
            to = to.get("@id", "") if isinstance(to, dict) else to
            rows.append({"published": str(v.get("datePublished") or ""), "modified": str(v.get("dateModified") or ""), "bound": to if isinstance(to, str) else ""})
    return rows if url is RAW else _bound_dates(rows, effective_base(root, url), url)


def _only(values) -> str | None:
    v = {x for x in values if x}
    return v.pop() if len(v) == 1 else None


def _bound_dates(rows, base, url):
    head, *articles = rows
    own = [a for a in articles if a["bound"] and normalise(a["bound"]) == normalise(url or "")] or (articles if len(articles) == 1 else [])
    pub = head["published"] or _only(a["published"] for a in own)
    mod = head["modified"] or _only(a["modified"] for a in own)
    return [{"published": pub, "modified": mod, "bound": None}] if pub or mod else []


_DATA = ("meta", "open_graph", "json_ld", "app_state", "head_links", "tokens", "endpoints", "script_data", "images", "links", "forms")


def facts(root: Node, url):
    """Entity, attribute and value rows of eleven kinds, in fixed order."""
    i = 0
    for kind in _DATA:
        for j, r in enumerate(EXTRACTORS[kind][0](root, url)):
            name = str(r.get("name") or r.get("text") or r.get("tag") or r.get("url") or "")
            value = r.get("content") or r.get("url") or r.get("value") or r.get("json") or r.get("raw") or r.get("action") or json.dumps(r.get("values", ""), ensure_ascii=False)
            yield {"ord": i, "kind": kind, "source_ix": j, "name": name, "value": str(value)}
            i += 1


_SHELL = re.compile(r"loading|enable javascript|please wait", re.I)


def plan(root: Node, url):
    """How a page is best read: relay, login, script shell, crawl or static, with a confidence."""
    fs = list(forms(root, url))
    n_words = words((root.first("body") or root).text(_QUIET))
    n_links = sum(1 for _ in root.elements("a"))
    n_scripts = sum(1 for _ in root.elements("script"))
    shell = n_words < 40 and (n_scripts >= 3 or bool(list(app_state(root, url))) or bool(_SHELL.search(root.text(frozenset(("script", "style"))))) or any(n.get("id") in ("root", "app", "__next") for n in root.elements("div")))
    mode, sure = next(
        (m for m, on in ((("Relay", "High"), any(f["relay"] for f in fs)), (("AuthRequired", "High"), any(f["login"] for f in fs)), (("RenderedSnapshot", "Medium"), shell), (("Crawl", "Medium"), n_links >= 20 and n_words >= 80)) if on),
        ("Static", "High" if n_words >= 80 else "Low"),
    )
    yield {"mode": mode, "confidence": sure, "words": n_words, "links": n_links, "forms": len(fs), "scripts": n_scripts}


def surface(root: Node, url):
    """What a visitor or a script can act on: forms and their hidden fields, tokens, endpoints, in that order."""
    i = 0
    found = [("Form", f["id"] or f"form[{f['form_ix']}]", f["method"], f["action"], "") for f in forms(root, url)]
    fields = [("Field", c["name"], "", "", c["value"]) for f in forms(root, url) for c in f["fields"] if c["type"] == "hidden"]
    tokens_ = [("Token", t["name"], "", "", t["value"]) for t in tokens(root, url)]
    calls = [("Endpoint", r["operation"] or r["client"] or r["url"], r["method"], r["url"], "") for r in endpoints(root, url)]
    for kind, name, method, target, value in [*found, *fields, *tokens_, *calls]:
        yield {"ord": i, "kind": kind, "name": name, "method": method, "url": target, "value": value}
        i += 1


def members(root: Node, url):
    """Member paths of a page's scripts with how often each occurs."""
    for i, s in _page_scripts(root):
        for path, n in Counter(p for p, _ in script_members(s.text())).items():
            yield {"script_ix": i, "path": path, "n": n}


def data_sources(root: Node, url):
    """Where a page holds data, richest first: structured data, application state, script data, tables, endpoints, with their size."""
    rank = {"json_ld": 0, "app_state": 1, "script_data": 2, "table": 3, "endpoint": 4}
    out = [("json_ld", r["type"], len(r["raw"])) for r in json_ld(root, url) if r["error"] is None]
    out += [("app_state", r["name"], len(r["json"])) for r in app_state(root, url)]
    out += [("script_data", r["id"] or r["type"], len(r["json"])) for r in script_data(root, url) if r["valid"]]
    out += [("table", t["caption"] or t["id"], len(t["rows"])) for t in T.read_tables(root) if not t["error"]]
    out += [("endpoint", r["url"], 0) for r in endpoints(root, url)]
    for i, (kind, name, size) in sorted(enumerate(out), key=lambda x: (rank[x[1][0]], -x[1][2], x[0])):
        yield {"kind": kind, "name": name, "size": size, "found_ix": i}


EXTRACTORS: dict = {
    "outline": (outline, "ord int, level int, title string, id string, parent_ord int"),
    "lists": (lists, "list_ix int, ordered boolean, item_ix int, segments array<string>"),
    "direct_lists": (direct_lists, "list_ix int, ordered boolean, item_ix int, segments array<string>"),
    "tables": (table_rows, "table_ix int, caption string, row_ix int, cells map<string,string>, error string"),
    "table_heads": (table_heads, "table_ix int, caption string, id string, classes string, headers array<string>, types array<string>, row_count int, error string"),
    "reversed_tables": (reversed_tables, "table_ix int, cells map<string,string>"),
    "forms": (forms, "form_ix int, id string, name string, action string, method string, fields array<struct<name:string,type:string,value:string>>, successful array<struct<key:string,value:string>>, login boolean, relay string"),
    "meta": (meta_tags, "name string, source_attribute string, content string"),
    "open_graph": (open_graph, "name string, values array<string>"),
    "microdata": (microdata, "item_ix int, type string, id string, props map<string,array<string>>"),
    "microdata_unknown": (microdata_unknown, "item_ix int, type string, unknown array<string>"),
    "json_ld": (json_ld, "item_ix int, type string, name string, raw string, error string"),
    "head_links": (head_links, "tag string, name string, value string, url string, media_type string"),
    "canonical": (canonical, "url string"),
    "links": (links, "url string, href string, text string, title string, context string, external boolean"),
    "crawl_links": (crawl_links, "url string"),
    "images": (images, "tag string, url string, descriptor string, alt string, best boolean"),
    "crawl_assets": (crawl_assets, "url string, kind string"),
    "resources": (resources, "ord int, type string, source string, inline string, comment string, name string"),
    "scripts": (scripts, "script_ix int, src string, type string, javascript boolean, module boolean, inline_length int"),
    "javascript": (javascript, "script_ix int, name string, value string"),
    "app_state": (app_state, "name string, source string, json string"),
    "js_config": (js_config, "script_ix int, name string, value string"),
    "script_data": (script_data, "script_ix int, type string, id string, json string, valid boolean"),
    "tokens": (tokens, "name string, value string, source string"),
    "endpoints": (endpoints, "script_ix int, method string, url string, client string, operation string"),
    "api_inventory": (api_inventory, "kind string, method string, resolved_url string, name string, risk string, reasons array<string>"),
    "flight_rows": (flight_rows, "row_ix int, id bigint, tag string, data string, json string, complete boolean, payload_ix int"),
    "surface": (surface, "ord int, kind string, name string, method string, url string, value string"),
    "members": (members, "script_ix int, path string, n int"),
    "data_sources": (data_sources, "kind string, name string, size int, found_ix int"),
    "code_blocks": (code_blocks, "block_ix int, language string, code string, lines int, kind string"),
    "breadcrumbs": (breadcrumbs, "trail_ix int, item_ix int, label string, url string"),
    "faq": (faq, "question string, answer string, source string"),
    "spec_tables": (spec_tables, "table_ix int, row_ix int, name string, value string"),
    "callouts": (callouts, "kind string, title string, text string"),
    "layout": (layout, "kind string, tag string, id string, words int, links int, total int"),
    "actions": (actions, "label string, url string, intent string, score int"),
    "doc_endpoints": (doc_endpoints, "method string, path string, summary string, parameters array<string>, score int, promoted boolean"),
    "statistics": (statistics, "words int, links int, images int, elements int, headings int, paragraphs int, tables int, lists int, forms int, scripts int, depth int"),
    "text": (page_text, "title string, lang string, text string, lines string, markdown string"),
    "readable": (readable_rows, "text string, title string, selector string, score double, candidates int, words int"),
    "publication_dates": (publication_dates, "published string, modified string, bound string"),
    "facts": (facts, "ord int, kind string, source_ix int, name string, value string"),
    "plan": (plan, "mode string, confidence string, words int, links int, forms int, scripts int"),
}


def _resolved(field: str, only=None, external: str | None = None, keep=None):
    """A finisher that resolves one field, in rows where ``only`` holds; rows that ``keep`` rejects go."""

    def finish(rows, base, url):
        out = []
        for r in rows:
            if r[field] and (only is None or only(r)):
                r = {**r, field: resolve(r[field], base)}
            if external:
                r[external] = is_external(r[field], base)
            if keep is None or keep(r):
                out.append(r)
        return out

    return finish


def _resolved_forms(rows, base, url):
    return [{**r, "url": _action(r["url"], base, url)} if r["kind"] == "Form" else r for r in rows]


#: Kinds whose rows hold addresses, with what resolves them once the page's own address is known.
LATE = {
    "forms": lambda rows, base, url: [{**r, "action": _action(r["action"], base, url)} for r in rows],
    "head_links": _resolved("url", _holds_url), "canonical": _first_canonical, "links": _resolved("url", external="external", keep=lambda r: r["url"]),
    "crawl_links": _distinct_links, "images": _resolved("url"), "crawl_assets": _distinct_assets, "resources": _resolved("source"), "scripts": _resolved("src"),
    "surface": _resolved_forms, "api_inventory": _assessed, "breadcrumbs": _resolved("url"), "actions": _resolved("url"), "publication_dates": _bound_dates,
}


def _schemas(kinds: list[str]):
    structs = {k: _parse_datatype_string(EXTRACTORS[k][1]) for k in kinds}
    return structs, {k: pa.list_(to_arrow_type(s)) for k, s in structs.items()}, {k: [f.name for f in s] for k, s in structs.items()}


def extract_many(pages: DataFrame, kinds: list[str], key: str = "page_id", html: str = "html", url: str | None = "url") -> DataFrame:
    """``key`` and one array column of rows per kind, from one parse of each page.

    ``url`` names the column of page addresses, or is None where there is none.
    """
    return _extract(pages, kinds, key, html, url, False)


def _extract(pages: DataFrame, kinds: list[str], key: str, html: str, url: str | None, late: bool) -> DataFrame:
    structs, arrow, names = _schemas(kinds)
    kd = pages.schema[key].dataType

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch)):
            out: dict = {k: [] for k in kinds}
            bases: list = []
            urls = b.column(2).to_pylist()
            for h, u in zip(b.column(1).to_pylist(), urls):
                root = parse(h) if h else None
                bases.append(next((n.get("href") for n in root.elements("base") if n.get("href").strip()), None) if late and root is not None else None)
                for k in kinds:
                    rows = list(EXTRACTORS[k][0](root, RAW if late and k in LATE else u)) if root is not None else []
                    out[k].append([{n: r[n] for n in names[k]} for r in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, pa.string()), *[pa.array(out[k], arrow[k]) for k in kinds]], names=["key", "base", *kinds])

    schema = StructType().add("key", kd).add("base", "string")
    for k in kinds:
        schema = schema.add(k, ArrayType(structs[k]))
    src = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"))
    got = spread(src).mapInArrow(run, schema)
    return got if late else got.drop("base").withColumnRenamed("key", key)


def extract_joined(pages: DataFrame, kinds: list[str], urls: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """As ``extract_many``, for pages whose addresses stand in another table ``urls`` (key, url).

    Pages are parsed where they are read; only the extracted rows, with the references as they are
    written and the page's base, meet the addresses in a join and are resolved after it. A page's
    markup is never shuffled, and kinds without addresses need no join at all.
    """
    late = [k for k in kinds if k in LATE]
    got = _extract(pages, kinds, key, html, None, True)
    if not late:
        return got.drop("base").withColumnRenamed("key", key)
    structs, arrow, _ = _schemas(kinds)
    one = urls.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min("url").alias("url"))
    j = got.join(one, "key", "left").select("key", "base", "url", *kinds)

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch)):
            cols = [b.column(0)]
            bases, own = b.column(1).to_pylist(), b.column(2).to_pylist()
            bases = [(resolve(x, u) or u) if x else u for x, u in zip(bases, own)]
            for i, k in enumerate(kinds):
                if k in LATE:
                    rows = [LATE[k](r, x, u) if r else [] for r, x, u in zip(b.column(3 + i).to_pylist(), bases, own)]
                    cols.append(pa.array(rows, arrow[k]))
                else:
                    cols.append(b.column(3 + i))
            yield pa.RecordBatch.from_arrays(cols, names=["key", *kinds])

    schema = StructType().add("key", pages.schema[key].dataType)
    for k in kinds:
        schema = schema.add(k, ArrayType(structs[k]))
    return j.mapInArrow(run, schema).withColumnRenamed("key", key)


def extract(pages: DataFrame, kind: str, key: str = "page_id", html: str = "html", url: str | None = "url", urls: DataFrame | None = None) -> DataFrame:
    """Rows of one kind, each with its page's key; addresses are of the column ``url`` or, where given, of the table ``urls``."""
    got = extract_joined(pages, [kind], urls, key, html) if urls is not None else extract_many(pages, [kind], key, html, url)
    return got.select(key, F.explode(kind).alias("r")).select(key, "r.*")
