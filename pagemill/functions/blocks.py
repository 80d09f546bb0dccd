"""Split an HTML page into visible text blocks with a handful of compiled scans.

A *block* is a maximal run of visible text between tags that are not inline.
The whole page is processed with a few C-level regex passes instead of a tree
builder, which is what makes block-level work affordable on very large corpora.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

#: The tags that do not end a block.
INLINE = ("a", "b", "code", "em", "i", "math", "mi", "mn", "mo", "span")
#: The elements whose text is not visible.
HIDDEN = ("head", "script", "style", "template", "noscript")

_ATTRS = r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>|[^>]*>"""
_NAME_END = r"(?=[\s/>])"
COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
_RAW = re.compile(
    r"<(script|style|template|noscript|title|textarea)" + _NAME_END + rf"(?:{_ATTRS})(.*?)(?:</\1\s*>|\Z)", re.S | re.I
)
_HEAD = re.compile(r"<head" + _NAME_END + r"[^<]*+(?:<(?!/head|body[\s/>])[^<]*+)*+(?:</head\s*>)?", re.I)
_BLOCK_TAG = re.compile(r"</?(?!(?:" + "|".join(INLINE) + r")[\s/>])[a-zA-Z](?:" + _ATTRS + ")", re.I)
_ANY_TAG = re.compile(r"</?[a-zA-Z](?:" + _ATTRS + ")")
_OTHER_SPACE = ("\n", "\t", "\r", "\f", "\xa0")
_TITLE = re.compile(r"<title" + _NAME_END + rf"(?:{_ATTRS})(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_CODE = re.compile(r"<(pre|code)" + _NAME_END + rf"(?:{_ATTRS}).*?(?:</\1\s*>|\Z)", re.S | re.I)


def squeeze(text: str) -> str:
    """Collapse HTML white space and no-break spaces; trim."""
    for c in _OTHER_SPACE:
        if c in text:
            text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def _hide(m: re.Match) -> str:
    return "<textarea>" + m[2] + "</textarea>" if m[1].lower() == "textarea" else "<hr>"


def body_markup(html: str) -> str:
    """The page without comments and without elements whose text is hidden."""
    if "<!" in html or "<?" in html:
        html = COMMENT.sub("", html)
    html = _HEAD.sub("<hr>", html)
    return _RAW.sub(_hide, html)


def split_blocks(markup: str) -> list[str]:
    """Blocks of markup that ``body_markup`` has cleaned."""
    out = []
    for piece in _BLOCK_TAG.split(markup):
        if not piece or piece.isspace():
            continue
        if "<" in piece:
            piece = _ANY_TAG.sub("", piece)
        if "&" in piece:
            piece = unescape(piece)
        piece = squeeze(piece)
        if piece:
            out.append(piece)
    return out


def split_at(markup: str) -> list[tuple[str, int]]:
    """Blocks of cleaned markup, each with the position at which its text begins."""
    out, at = [], 0
    for m in _BLOCK_TAG.finditer(markup):
        if m.start() > at:
            out += [(b, at) for b in split_blocks(markup[at : m.start()])]
        at = m.end()
    return out + [(b, at) for b in split_blocks(markup[at:])]


def visible_blocks(html: str | None) -> list[str]:
    """Blocks of a page in document order; none for a null or empty page."""
    return split_blocks(body_markup(html)) if html else []


def title_text(html: str) -> str:
    """Text of the first title element, or ''."""
    m = _TITLE.search(html)
    if m is None:
        return ""
    t = m[1]
    return squeeze(unescape(t) if "&" in t else t)


def without_code(markup: str) -> str:
    """Markup without code elements; an inline one leaves a space, a block one ends the block."""
    return _CODE.sub(lambda m: "<hr>" if m[1].lower() == "pre" else " ", markup)


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
