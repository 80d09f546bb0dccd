"""Sensitive names and values: parameters of addresses and assignments in scripts, hidden from what is exported."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

#: Names whose values are sensitive, and those looked for in scripts and data.
SENSITIVE_NAMES = (
    "access_token api_key apikey auth code credential csrf error error_description error_uri id_token key mfa otp password passcode pin pwd refresh_token relaystate samlrequest samlresponse "
    "secret session session_state state token wctx wresult"
).split()
STRUCTURED_NAMES = "access_token api_key apikey auth code credential csrf key mfa otp passcode password pin pwd refresh_token relaystate samlrequest samlresponse secret session token wctx wresult".split()
HIDDEN = "<redacted>"
DEPTH = 4

_ANY_NAME = [re.compile(re.escape(n), re.I) for n in SENSITIVE_NAMES]
_USER = re.compile(r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//)[^/?#@]+@")
_TAIL = re.compile(r"[\s'\"\])}>]+$")


def sensitive_name(name: str) -> bool:
    """Whether a name holds a sensitive word on its own: bounded by other signs or by a change of case."""
    for rx in _ANY_NAME:
        at = 0
        while m := rx.search(name, at):
            a, b = m.span()
            before = a == 0 or not name[a - 1].isalnum() or name[a - 1].islower() and name[a].isupper()
            after = b == len(name) or not name[b].isalnum() or name[b - 1].islower() and name[b].isupper()
            if before and after:
                return True
            at = a + 1
    return bool(re.search(r"access%[A-Za-z0-9]*token", name, re.I))


def _parts(url: str) -> tuple[str, str | None, str | None]:
    """(before the parameters, query, fragment) of an address."""
    head, mark, fragment = url.partition("#")
    base, q, query = head.partition("?")
    return base, query if q else None, fragment if mark else None


def has_sensitive_query(url: str, depth: int = 0) -> bool:
    """Whether an address carries user information or a sensitive parameter, also inside its parameters' values."""
    if not url.strip():
        return False
    if _USER.match(url):
        return True
    _, query, fragment = _parts(url)
    for segment in ([query] if query else []) + ([fragment] if fragment and "=" in fragment else []):
        for pair in filter(None, segment.split("&")):
            name, eq, value = pair.partition("=")
            if sensitive_name(unquote(name)) or eq and depth < DEPTH and has_sensitive_query(unquote(value), depth + 1):
                return True
    return False


def _pairs(segment: str) -> str:
    out = []
    for pair in filter(None, segment.split("&")):
        name, eq, value = pair.partition("=")
        if sensitive_name(unquote(name)):
            tail = value[len(HIDDEN) :] if value.lower().startswith(HIDDEN) else (m[0] if (m := _TAIL.search(value)) else "")
            pair = f"{name}={HIDDEN}{tail}"
        elif eq and has_sensitive_query(unquote(value)):
            inner = redact_url(unquote(value))
            pair = f"{name}={inner if unquote(value) == value else quote(inner, safe='')}"
        out.append(pair)
    return "&".join(out)


def redact_url(url: str | None) -> str:
    """Address with user information and sensitive parameter values hidden; '' for a blank one."""
    if not url or not url.strip():
        return ""
    base, query, fragment = _parts(_USER.sub(rf"\1{HIDDEN}@", url))
    return base + ("" if query is None else "?" + _pairs(query)) + ("" if fragment is None else "#" + _pairs(fragment))


#: What of script and JSON text is an assignment or a member with a sensitive name.
_WORDS = "(?:" + "|".join(STRUCTURED_NAMES) + ")"
_ASSIGNED = r"(?:\{[^;]*\}|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'|[^;\r\n]+)"
_HELD = r"(?:\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'|[^,}\]]+)"
_RULES = [
    (re.compile(rf"([A-Za-z_$][\w$.]*{_WORDS}[\w$]*\s*=\s*){_ASSIGNED}", re.I | re.A), rf"\1{HIDDEN}"),
    (re.compile(rf"((?:\"[^\"]*{_WORDS}[^\"]*\"|'[^']*{_WORDS}[^']*')\s*:\s*){_HELD}", re.I), rf'\1"{HIDDEN}"'),
    (re.compile(rf"([A-Za-z_$][\w$]*{_WORDS}[\w$]*\s*:\s*){_HELD}", re.I | re.A), rf'\1"{HIDDEN}"'),
    (re.compile(rf"(?<![?&#A-Za-z0-9_])((?:[A-Za-z_$][\w$]*\.)?\bstate\s*=\s*){_ASSIGNED}", re.I | re.A), rf"\1{HIDDEN}"),
    (re.compile(rf"((?:\"state\"|'state'|\bstate)\s*:\s*){_HELD}", re.I), rf'\1"{HIDDEN}"'),
]
_LITERAL = re.compile(r"\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'")


def redact_structured(text: str | None) -> str:
    """Script or JSON text with the values of sensitive names hidden, also in the addresses it quotes."""
    if not text or not text.strip():
        return ""
    for rx, new in _RULES:
        text = rx.sub(new, text)
    return _LITERAL.sub(lambda m: m[0][0] + redact_url(m[0][1:-1]) + m[0][-1] if "?" in m[0] or "#" in m[0] or "//" in m[0] else m[0], text)


def redact_links(markdown: str | None) -> str:
    """Markdown with the addresses of its links and images redacted."""
    if not markdown or not markdown.strip():
        return ""
    return re.sub(r"(!?\[[^\]]*\]\()([^)\s]+)(\))", lambda m: m[1] + redact_url(m[2]) + m[3], markdown)
