"""HTML tables to rows: header choice, spans, footers, link columns, typed columns."""

from __future__ import annotations

import re
from collections import Counter

from pagemill.functions.dom import Node, normal
from pagemill.functions.text import fragment_lines
from pagemill.functions.urls import resolve

#: Limits of one table; beyond them the table is reported as over budget instead of expanded.
MAX_COLUMNS, MAX_ROWS, MAX_CELLS = 10_000, 100_000, 1_000_000
_SYMBOLS = re.compile(r"[!\"#$%'()*+,\-./:;<=>?@\[\]\\^`{|}~]")


class OverBudget(ValueError):
    """A table larger than the limits."""


def clean_header(name: str) -> str:
    """Header without symbols, '&' spelled out."""
    return normal(_SYMBOLS.sub("", name.replace("&", " and ")))


def unique(names: list[str]) -> list[str]:
    """Names with later repeats numbered, never reusing a name that occurs literally."""
    taken = {n.lower() for n in names}
    seen: set[str] = set()
    out = []
    for n in names:
        if n.lower() in seen:
            k = 1
            while f"{n}{k}".lower() in taken or f"{n}{k}".lower() in seen:
                k += 1
            n = f"{n}{k}"
        seen.add(n.lower())
        out.append(n)
    return out


def span(value: str, most: int) -> int:
    m = re.match(r"\s*\+?(\d+)", value or "")
    return min(int(m[1]), most) if m else 1


def owned_rows(table: Node, skip_footer: bool = False) -> list[tuple[Node, str, int]]:
    """(row, group tag, group number) of a table's own rows, footer rows last."""
    out, foot = [], []
    for g, c in enumerate(table.kids("tr", "thead", "tbody", "tfoot")):
        if c.tag == "tr":
            out.append((c, "tbody", -1))
        else:
            (foot if c.tag == "tfoot" else out).extend((r, c.tag, g) for r in c.kids("tr"))
    return out + ([] if skip_footer else foot)


def _cells(row: Node) -> list[Node]:
    return row.kids("td", "th")


def cell_text(cell: Node, form: str = "compact") -> str:
    return fragment_lines(cell) if form == "lines" else cell.clean(frozenset(("script", "style")))


def read_table(
    table: Node, *, base: str | None = None, skip_footer: bool = False, clean_headers: bool = False, placeholder: str | None = None, cell_form: str = "compact",
    link_urls: bool = False, replace: dict[str, str] | None = None, reverse: bool = False,
) -> dict | None:
    """``caption, id, class, headers, rows`` of a table; None if it has no data rows.

    The header is the widest head row that holds header cells, else the first row with one, else
    Column1..n. Row spans carry their value down to the end of the row group; cells beyond the
    headers are dropped. ``reverse`` reads each row as key and value of one record.
    """
    rows = owned_rows(table, skip_footer)
    if not rows:
        return None
    width = lambda r: sum(max(1, span(c.get("colspan"), 1000)) for c in _cells(r))
    heads = [(i, r) for i, (r, g, _) in enumerate(rows) if g == "thead" and any(c.tag == "th" for c in _cells(r))]
    head_at = None
    if heads:
        head_at = max(heads, key=lambda x: (width(x[1]), len(_cells(x[1])), x[0]))[0]
    else:
        head_at = next((i for i, (r, _, _) in enumerate(rows) if any(c.tag == "th" for c in _cells(r)) and not reverse), None)
    if head_at is None:
        named = next((r for r, g, _ in rows if g == "thead"), None) or next((r for r, _, _ in rows if _cells(r)), None)
        if named is None:
            return None
        headers = [f"Column{i + 1}" for i in range(width(named))]
        data = [x for x in rows if x[1] != "thead" or x[0] is not named]
    else:
        headers = []
        for c in _cells(rows[head_at][0]):
            headers += [cell_text(c)] * max(1, span(c.get("colspan"), 1000))
        data = [x for i, x in enumerate(rows) if i > head_at or x[1] == "tfoot"]
    if len(headers) > MAX_COLUMNS or len(data) > MAX_ROWS or len(headers) * len(data) > MAX_CELLS:
        raise OverBudget(f"{len(headers)} columns, {len(data)} rows")
    headers = [clean_header(h) if clean_headers else h for h in headers]
    headers = unique([h or f"Column{i + 1}" for i, h in enumerate(headers)])
    for old, new in (replace or {}).items():
        headers = [re.sub(re.escape(old), new.replace("\\", "\\\\"), h, flags=re.I) for h in headers]
    out: list[dict] = []
    active: dict[int, tuple[int, str | None, str]] = {}
    group = None
    remaining = Counter(g for _, _, g in data)
    for row, _, g in data:
        if g != group:
            active, group = {}, g
        left = remaining[g]
        remaining[g] -= 1
        record: dict = {}
        col = 0
        cells = iter(_cells(row))
        while col < len(headers):
            if col in active and active[col][0] > 0:
                n, v, u = active[col]
                active[col] = (n - 1, v, u)
            else:
                c = next(cells, None)
                if c is None:
                    if not any(k >= col and x[0] > 0 for k, x in active.items()):
                        break
                    col += 1
                    continue
                v = cell_text(c, cell_form)
                for old, new in (replace or {}).items():
                    v = re.sub(re.escape(old), new.replace("\\", "\\\\"), v, flags=re.I)
                v = placeholder if v == "" and placeholder is not None else v
                a = c.first("a")
                u = resolve(a.get("href"), base) or a.get("href") if a is not None else ""
                down = span(c.get("rowspan"), 65534)
                down = left if down == 0 else down
                for k in range(max(1, span(c.get("colspan"), 1000))):
                    if col + k < len(headers):
                        active[col + k] = (min(down, left) - 1, v, u)
                        record[headers[col + k]] = v
                        if link_urls and u:
                            record[f"{headers[col + k]}Url"] = u
                col += max(1, span(c.get("colspan"), 1000))
                continue
            record[headers[col]] = v
            if link_urls and u:
                record[f"{headers[col]}Url"] = u
            col += 1
        if record:
            out.append(record)
    if reverse:
        merged: dict = {}
        for i, (row, _, _) in enumerate(data):
            cs = _cells(row)
            if cs:
                merged[cell_text(cs[0]) or str(i + 1)] = cell_text(cs[1], cell_form) if len(cs) > 1 else None
        out = [merged] if merged else []
        headers = list(merged)
    if not out:
        return None
    cap = next(iter(table.kids("caption")), None)
    return {"caption": cap.clean() if cap else "", "id": table.get("id"), "classes": " ".join(table.classes()), "headers": headers, "rows": out}


def read_tables(root: Node, **options) -> list[dict]:
    """All tables of a page with their position; tables without data are left out, but count."""
    out = []
    for i, t in enumerate(root.elements("table")):
        try:
            got = read_table(t, **options)
        except OverBudget as e:
            got = {"caption": "", "id": t.get("id"), "classes": " ".join(t.classes()), "headers": [], "rows": [], "error": str(e)}
        if got:
            out.append({"table_ix": i, "error": None, **got})
    return out


_KINDS = (
    ("boolean", re.compile(r"(?i)true|false")),
    ("bigint", re.compile(r"[+-]?\d{1,18}")),
    ("double", re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")),
    ("date", re.compile(r"\d{4}-\d{2}-\d{2}")),
)


def infer_type(values: list[str | None]) -> str:
    """Narrowest column type that all non-empty values fit."""
    some = [v.strip() for v in values if v is not None and v.strip()]
    return next((k for k, rx in _KINDS if some and all(rx.fullmatch(v) for v in some)), "string")
