"""Findings about pages: accessibility, safety, compatibility, offline dependencies, response classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.dom import HEADINGS, Node
from pagemill.operators.extract import is_javascript, srcset
from pagemill.operators.select import _rows

FINDING = "code string, severity string, message string, element string"
COMPATIBILITY = "rule_id string, severity string, message string, selector string, element string, attribute string, value string"
#: Attributes that hold addresses, and starts of addresses that embed a harmless image.
URL_ATTRIBUTES = ("href", "xlink:href", "src", "action", "formaction")
SAFE_IMAGES = (
    "data:image/png;base64,", "data:image/jpeg;base64,", "data:image/jpg;base64,", "data:image/gif;base64,", "data:image/webp;base64,", "data:image/avif;base64,",
    "data:image/bmp;base64,", "data:image/x-icon;base64,", "data:image/svg+xml,", "data:image/svg+xml;base64,",
)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_REFRESH = re.compile(r"^[^;]*;\s*url\s*=\s*(.*)$", re.I | re.S)


def unsafe_url(tag: str, attr: str, value: str, rel: str = "") -> bool:
    """Whether an address has a scheme that its place doesn't allow.

    Assets may be loaded by HTTP only, or be an embedded image where an image stands; other
    addresses may also be mail and telephone ones. Relative addresses are safe.
    """
    v = re.sub(r"[\s\x00-\x1f\x7f-\x9f]", "", value).lower()
    m = _SCHEME.match(v)
    if not m or m[0] in ("http:", "https:"):
        return False
    icon = tag == "link" and attr == "href" and any(w.endswith("icon") for w in rel.lower().split())
    if (icon or tag == "video" and attr == "poster" or attr == "src" and tag in ("img", "image", "source", "input")) and v.startswith(SAFE_IMAGES):
        return False
    asset = attr == "src" or (tag, attr) in (("link", "href"), ("object", "data"), ("video", "poster"))
    return asset or m[0] not in ("mailto:", "tel:")


def described(n: Node) -> str:
    """tag#id, tag.class or tag."""
    return f"{n.tag}#{n.get('id')}" if n.get("id").strip() else ".".join([n.tag, *n.classes()[:1]])


def _shown(n: Node) -> bool:
    return bool(n.text().strip())


def _alt_inside(n: Node) -> bool:
    return any(i.get("alt").strip() for i in n.elements("img"))


class _Names:
    """What gives the elements of a page their accessible names."""

    def __init__(self, root: Node):
        self.ids: dict[str, list[Node]] = {}
        for n in root.elements():
            if n.get("id").strip():
                self.ids.setdefault(n.get("id"), []).append(n)
        self.labels: dict[str, list[Node]] = {}
        for n in root.elements("label"):
            if n.get("for").strip():
                self.labels.setdefault(n.get("for"), []).append(n)

    def named(self, n: Node, own_text: bool) -> bool:
        kind = n.get("type").lower()
        return (
            bool(n.get("aria-label").strip() or n.get("title").strip()) or own_text and _shown(n) or n.tag == "input" and kind == "image" and bool(n.get("alt").strip()) or _alt_inside(n)
            or any(_shown(x) for i in n.get("aria-labelledby").split() for x in self.ids.get(i, ()))
            or any(_shown(x) for x in self.labels.get(n.get("id"), ()) if n.get("id"))
            or any(a.tag == "label" and _shown(a) for a in n.ancestors())
            or kind in ("submit", "reset") or kind == "button" and bool(n.get("value").strip())
        )

    def labelled(self, n: Node) -> bool:
        """The rule for form fields: what a label reads counts as its text, title, or the images in it."""
        kind = n.get("type").strip().lower()
        own = n.tag == "button" and (_shown(n) or _alt_inside(n)) or n.tag == "input" and (kind == "image" and n.get("alt").strip() or kind == "button" and n.get("value").strip())
        return (
            bool(n.get("aria-label").strip() or n.get("title").strip() or own) or any(readable_label(self.ids[i][0]) for i in n.get("aria-labelledby").split() if i in self.ids)
            or any(readable_label(x) for x in self.labels.get(n.get("id"), ()) if n.get("id"))
            or any(a.tag == "label" and "for" not in a.attrs and readable_label(a) for a in n.ancestors())
        )


def readable_label(n: Node) -> bool:
    return _shown(n) or bool(n.get("aria-label").strip() or n.get("title").strip()) or _alt_inside(n)


def audit_tree(root: Node) -> list[dict]:
    """Findings in the order of the rules: metadata, ids, names, addresses, headings. Codes and messages are fixed values."""
    out: list[dict] = []

    def add(code: str, severity: str, message: str, element: str) -> None:
        out.append({"code": code, "severity": severity, "message": message, "element": element})

    every = list(root.elements())
    title, html = root.first("title"), root.first("html")
    if title is None or not title.clean():
        add("document-title-missing", "Warning", "The document does not define a non-empty title.", "head")
    if html is None or not html.get("lang").strip():
        add("document-language-missing", "Warning", "The document root does not declare a language.", "html")
    names = _Names(root)
    for i, ns in names.ids.items():
        if len(ns) > 1:
            add("duplicate-id", "Error", f"The id '{i}' is used by {len(ns)} elements.", f"#{i}")
    for n in every:
        if n.tag == "img" and "alt" not in n.attrs:
            add("image-alt-missing", "Error", "The image does not define an alt attribute. Use an empty alt value for decorative images.", described(n))
        if (n.tag == "button" or n.tag == "a" and "href" in n.attrs or n.get("role").lower() in ("button", "link")) and not names.named(n, True):
            add("interactive-name-missing", "Error", "The interactive element has no accessible name.", described(n))
        if (n.tag in ("select", "textarea") or n.tag == "input" and n.get("type").lower() != "hidden") and not names.named(n, False):
            add("form-label-missing", "Error", "The form control has no associated label or accessible name.", described(n))
    for n in every:
        places = [a for a in URL_ATTRIBUTES if n.get(a)] + [a for t, a in (("object", "data"), ("video", "poster")) if n.tag == t and n.get(a)]
        for a in places:
            if unsafe_url(n.tag, a, n.get(a), n.get("rel")):
                add("unsafe-url-scheme", "Error", f"The {a} attribute uses an executable URL scheme.", described(n))
        m = _REFRESH.match(n.get("content")) if n.tag == "meta" and n.get("http-equiv").strip().lower() == "refresh" else None
        if m and unsafe_url("meta", "href", m[1].strip().strip("\"'")):
            add("unsafe-url-scheme", "Error", "The meta refresh target uses an executable URL scheme.", described(n))
    last = 0
    for h in every:
        if h.tag in HEADINGS:
            level = int(h.tag[1])
            if last and level > last + 1:
                add("heading-level-skipped", "Warning", f"Heading hierarchy jumps from h{last} to h{level}.", described(h))
            last = level
    return out


def audit(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Findings of each page; null and empty pages have none."""
    return _rows(pages, lambda root, _: audit_tree(root), FINDING, key, html, None)


_LABELABLE = ("button", "meter", "output", "progress", "select", "textarea")


def _link_kind(n: Node) -> bool:
    rels = set(n.get("rel").lower().split())
    return bool(rels & {"stylesheet", "modulepreload", "preload", "prefetch", "preconnect", "dns-prefetch", "manifest", "icon", "apple-touch-icon", "mask-icon"})


def assets_of(root: Node) -> list[tuple[Node, str, str]]:
    """(element, attribute, address) of what a page loads: scripts, sheets, hints, icons, images and their candidates, media."""
    out = []
    for n in root.elements("script", "link", "img", "input", "source", "audio", "video", "track"):
        if n.tag == "script":
            take = ["src"] if "src" in n.attrs and is_javascript(n.get("type")) else []
        elif n.tag == "link":
            take = ["href"] if "href" in n.attrs and _link_kind(n) else []
            if "preload" in n.get("rel").lower().split() and n.get("as").lower() == "image":
                take.append("imagesrcset")
        elif n.tag == "input":
            take = ["src"] if n.get("type").strip().lower() == "image" and "src" in n.attrs else []
        elif n.tag == "source" and n.parent is not None and n.parent.tag == "picture":
            take = ["srcset"]
        else:
            take = [a for a in (("src", "srcset") if n.tag == "img" else ("poster", "src") if n.tag == "video" else ("src",)) if a in n.attrs]
        for a in take:
            out += [(n, a, u) for u, _ in srcset(n.get(a))] if a.endswith("srcset") else [(n, a, n.get(a))]
    return out


def compatibility(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Findings about ids, images, labels, fields, styles and resources of a page; rules and messages are fixed values.

    A resource is at fault when its address is blank, holds white space or can't be read, whatever the
    page's own address; so the operator needs the markup alone. Null and empty pages have none.
    """

    def fn(root, _):
        rows = []

        def add(rule: str, severity: str, message: str, n: Node, attribute: str | None, value: str | None) -> None:
            rows.append({"rule_id": rule, "severity": severity, "message": message, "selector": described(n), "element": n.tag, "attribute": attribute, "value": value})

        names = _Names(root)
        for i, ns in names.ids.items():
            for n in ns if len(ns) > 1 else ():
                add("duplicate-id", "Error", f"Duplicate id '{i}'.", n, "id", i)
        for n in root.elements("img"):
            if "alt" not in n.attrs:
                add("missing-img-alt", "Warning", "Image is missing an alt attribute.", n, "alt", n.attrs.get("src"))
        for n in root.elements("label"):
            if not readable_label(n):
                add("empty-label", "Warning", "Label has no readable text.", n, None, None)
            to = n.get("for")
            if to.strip() and to not in names.ids:
                add("label-target-missing", "Error", f"Label references missing id '{to}'.", n, "for", to)
            elif to.strip():
                t = names.ids[to][0]
                if t.tag not in _LABELABLE and not (t.tag == "input" and t.get("type").strip().lower() != "hidden"):
                    add("label-target-invalid", "Error", f"Label references non-labelable id '{to}'.", n, "for", to)
        for n in root.elements("input", *_LABELABLE):
            if not (n.tag == "input" and n.get("type").strip().lower() in ("hidden", "submit", "reset")) and not names.labelled(n):
                add("form-field-missing-label", "Warning", "Form field has no associated label or accessible name.", n, None, n.attrs.get("name"))
        for n in root.elements():
            if "style" in n.attrs and not n.get("style").strip():
                add("empty-inline-style", "Info", "Element has an empty inline style attribute.", n, "style", None)
        for n, a, u in assets_of(root):
            if not u.strip() or re.search(r"\s", u.strip()):
                rows.append({"rule_id": "invalid-resource-url", "severity": "Error", "message": f"Asset URL '{u}' could not be resolved.", "selector": n.tag, "element": n.tag, "attribute": a, "value": u})
        return rows

    return _rows(pages, fn, COMPATIBILITY, key, html, None)


#: What in a page's scripts needs a network at run time.
DEPENDENCIES = {
    "fetch": r"\bfetch\s*\(", "xhr": r"\bXMLHttpRequest\b", "axios": r"\baxios\s*[.(]", "websocket": r"\bnew\s+WebSocket\b", "eventsource": r"\bnew\s+EventSource\b",
    "serviceworker": r"serviceWorker\s*\.\s*register", "dynamic-import": r"\bimport\s*\(",
}


def offline_dependencies(html: Column) -> Column:
    """Kinds of run-time dependencies that a page's scripts show, as an array."""
    code = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    return F.array_compact(F.array(*[F.when(code.rlike(rx), F.lit(k)) for k, rx in DEPENDENCIES.items()]))


def response_class(status: Column, html: Column, headers: Column | None = None) -> Column:
    """What kind of refusal a response is: challenge, rate limit, auth, denied, block page, unavailable; null for none."""
    h = F.coalesce(html, F.lit(""))
    server = F.lit("") if headers is None else F.coalesce(F.lower(F.try_element_at(headers, F.lit("server"))), F.lit(""))
    challenge = h.rlike(r"(?i)checking your browser|cf-challenge|captcha|verify you are human") & (status.isin(403, 429, 503) | (F.length(h) < 4000))
    return (
        F.when(challenge | (server.contains("challenge")), "Challenge").when(status == 429, "RateLimit").when(status == 401, "AuthRequired").when(status == 403, "Denied")
        .when((F.length(h) < 4000) & h.rlike(r"(?i)access denied|request (was )?blocked"), "BlockPage").when(status.isin(502, 503, 504), "Unavailable")
    )
