"""URL handling for batched functions; the column forms are in ``columns``."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

#: Query parameters that only track.
TRACKING = ("utm_*", "fbclid", "gclid", "msclkid", "mc_*", "_hs*", "vero_*", "yclid")
TRACKING_PATTERN = "|".join(re.escape(t).replace(r"\*", ".*") for t in TRACKING)
_TRACKED = re.compile(f"(?:{TRACKING_PATTERN})$", re.I)
_DEFAULT_PORT = {"http": 80, "https": 443}


class _Raw(str):
    """Stands for an address not known yet: references stay as they are written, to be resolved later. One object in every process."""

    def __reduce__(self):
        return "RAW"


RAW = _Raw("")


def resolve(value: str | None, base: str | None) -> str:
    """Absolute form of a reference; '' when it can't be resolved."""
    v = (value or "").strip().replace("\\", "/")
    if not v or base is RAW:
        return v
    try:
        out = urljoin(base, v) if base else v
        return out if urlsplit(out).scheme or not base else ""
    except ValueError:
        return ""


def effective_base(root, url: str | None) -> str | None:
    """The page's base: its first ``base[href]``, resolved on the page's own address."""
    if url is RAW:
        return RAW
    b = next((n for n in root.elements("base") if n.get("href").strip()), None)
    return (resolve(b.get("href"), url) or url) if b is not None else url


def origin(url: str) -> tuple | None:
    try:
        p = urlsplit(url)
        return (p.scheme.lower(), (p.hostname or "").lower(), p.port or _DEFAULT_PORT.get(p.scheme.lower())) if p.hostname else None
    except ValueError:
        return None


def is_external(url: str, base: str | None) -> bool:
    """Whether an absolute address has another origin than the base; False without a base."""
    return bool(base) and origin(url) is not None and origin(url) != origin(base)


def normalise(url: str, remove_tracking: bool = True) -> str:
    """Lower scheme and host, no fragment or default port, no tracking parameters, sorted query, no trailing slash without a query."""
    try:
        p = urlsplit(url.strip())
        port = p.port
    except ValueError:
        return url
    if not p.scheme or not p.hostname:
        return url
    scheme = p.scheme.lower()
    host = p.hostname.lower() + (f":{port}" if port and _DEFAULT_PORT.get(scheme) != port else "")
    parts = [q.strip() for q in p.query.split("&")]
    parts = sorted(q for q in parts if q and not (remove_tracking and _TRACKED.match(q.split("=")[0])))
    path = p.path or "/"
    return f"{scheme}://{host}{path}?{'&'.join(parts)}" if parts else f"{scheme}://{host}{path}".rstrip("/")


def crawl_key(url: str, remove_tracking: bool = False) -> str:
    """Address without fragment and, if asked, without tracking parameters; order and case stay."""
    u = url.split("#", 1)[0]
    if remove_tracking and "?" in u:
        head, q = u.split("?", 1)
        kept = [x for x in q.split("&") if not _TRACKED.match(x.split("=")[0])]
        u = head + ("?" + "&".join(kept) if kept else "")
    return u
