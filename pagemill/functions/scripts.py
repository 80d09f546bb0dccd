"""Script text as tokens; formatting and minifying that keep every token."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"(?P<space>[ \t\f\v ﻿]+)|(?P<line>\r\n|[\n\r  ])|(?P<comment>//[^\n\r  ]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<name>[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*)"
    r"|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of a script; what is no token comes as kind 'other', so the texts joined are the script."""
    out: list[tuple[str, str]] = []
    last = ("", "")
    at = 0
    while at < len(text):
        c = text[at]
        if c == "`":
            end = _template_end(text, at)
            tok = ("string", text[at:end])
        elif c == "/" and (m := _REGEX.match(text, at)) and (last[0] in ("", "sign") and last[1] not in (")", "]", "}") or last[1] in _BEFORE_REGEX):
            tok = ("regex", m[0])
        elif m := _TOKEN.match(text, at):
            tok = (m.lastgroup, m[0])
        else:
            tok = ("other", c)
        out.append(tok)
        at += len(tok[1])
        if tok[0] not in ("space", "line", "comment"):
            last = tok
    return out


def _template_end(text: str, at: int) -> int:
    """End of the template literal at ``at``, the templates inside its placeholders included."""
    open_ = ["`"]
    i = at + 1
    while i < len(text) and open_:
        c = text[i]
        if c == "\\":
            i += 1
        elif open_[-1] == "`":
            if c == "`":
                open_.pop()
            elif text.startswith("${", i):
                open_.append("{")
                i += 1
        elif c in "{`":
            open_.append(c)
        elif c == "}":
            open_.pop()
        i += 1
    return i


#: Signs after and before which a line end means nothing.
_GOES_ON_AFTER = frozenset("{ ( [ , ; : ? = + - * / % & | ^ ! ~ < > => == === != !== <= >= && || ?? ?. += -= *= /= . ...".split()) - {"++", "--"}
_GOES_ON_BEFORE = frozenset(") ] } , ; : ? = * % & | ^ < > => == === != !== <= >= && || ?? ?. += -= *= . )".split())


def minify_js(text: str) -> str:
    """Script without comments and spare white space; a line end stays where it may end a statement."""
    out: list[str] = []
    gap = ""
    for kind, t in tokens(text):
        if kind in ("space", "line", "comment"):
            gap = "\n" if kind == "line" or kind == "comment" and re.search(r"[\n\r]", t) else gap or " "
            continue
        if out and gap:
            before = out[-1]
            if gap == "\n" and before not in _GOES_ON_AFTER and t not in _GOES_ON_BEFORE:
                out.append("\n")
            elif re.match(r"[\w$\\#\u0080-￿]", t) and re.search(r"[\w$\u0080-￿]$", before) or before[-1] in "+-" and t[0] == before[-1] or before == "/" and t[0] in "/*" or kind == "regex" and re.search(r"[\w$]$", before):
                out.append(" ")
        out.append(t)
        gap = ""
    return "".join(out)


def format_js(text: str, indent: str = "    ") -> str:
    """Script with a statement per line and blocks indented; strings, comments and expressions in brackets stay in their line."""
    out: list[str] = []
    depth, brackets, start, spaced = 0, 0, True, False

    def line() -> None:
        nonlocal start
        while out and out[-1] == " ":
            out.pop()
        if out and out[-1] != "\n":
            out.append("\n")
        start = True

    for kind, t in tokens(text):
        if kind in ("space", "line"):
            if kind == "line" and not brackets and not start and out and out[-1] not in _GOES_ON_AFTER:
                line()
            spaced = True
            continue
        if t == "}" and not brackets:
            depth = max(0, depth - 1)
            line()
        if start:
            out.append(indent * depth)
            start = False
        elif spaced and out[-1] not in ("(", "[", " ") and t not in (")", "]", ";", ","):
            out.append(" ")
        spaced = False
        out.append(t)
        if t in ("(", "["):
            brackets += 1
        elif t in (")", "]"):
            brackets = max(0, brackets - 1)
        elif t == "{" and not brackets:
            depth += 1
            line()
        elif t in (";", "}") and not brackets or kind == "comment" and t.startswith("//"):
            line()
    return re.sub(r"\n\s*\n+", "\n", "".join(out)).strip("\n")


#: Words that name no member.
_KEYWORDS = frozenset(
    "await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof "
    "undefined var void while with yield async".split()
)


def members(text: str) -> list[tuple[str, int]]:
    """(member path, position) of each chain of names in a script, such as ``window.app.start``; keywords and keys of objects are none."""
    out: list[tuple[str, int]] = []
    chain: list[str] = []
    begin = at = 0
    before = last = ""

    def end(sign: str) -> None:
        if chain and not (sign == ":" and len(chain) == 1 and before in ("{", ",")):
            out.append((".".join(chain), begin))
        chain.clear()

    for kind, t in tokens(text):
        if kind == "name" and t not in _KEYWORDS:
            if last in (".", "?.") and chain:
                chain.append(t)
            elif last not in (".", "?."):
                end(t)
                begin, before = at, last
                chain.append(t)
        elif kind not in ("space", "line", "comment") and t not in (".", "?."):
            end(t)
        if kind not in ("space", "line", "comment"):
            last = t
        at += len(t)
    end("")
    return out
