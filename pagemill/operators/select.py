"""Selection inside pages: elements, values, text, similar elements, records, discovery, relocation."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import css
from pagemill.functions.batches import map_arrow
from pagemill.functions.dom import Node, normal, parse, serialise
from pagemill.functions.urls import effective_base, resolve
from pagemill.functions.xpath import compile_xpath

NODE = "node_id int, tag string, id string, classes array<string>, text string, html string, attributes map<string,string>"


def _rows(pages: DataFrame, fn, fields: str, key: str, html: str, url: str | None) -> DataFrame:
    """Rows of ``fn(tree, url)`` per page; invalid selectors fail on the driver before any task runs."""
    kind = pages.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in re.split(r", (?=\w+ )(?![^<]*>)", fields)]

    def run(b, _):
        out: dict = {"key": [], **{n: [] for n in names}}
        for k, h, u in zip(*(b.column(i).to_pylist() for i in range(3))):
            if h:
                for r in fn(parse(h), u):
                    out["key"].append(k)
                    for n in names:
                        out[n].append(r[n])
        return out

    src = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"))
    return map_arrow(src, run, f"key {kind}, {fields}").withColumnRenamed("key", key)


def _node(n: Node) -> dict:
    return {"node_id": n.pre, "tag": n.tag, "id": n.get("id"), "classes": n.classes(), "text": n.clean(), "html": serialise(n), "attributes": list(n.attrs.items())}


def elements(pages: DataFrame, selector: str, first: bool = False, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements that match a CSS selector, in document order; only the first with ``first``."""
    css.compile_selector(selector)
    return _rows(pages, lambda root, _: map(_node, css.select(root, selector)[: 1 if first else None]), NODE, key, html, None)


def values_of(root: Node, selector: str, base: str | None) -> list[tuple[int, str]]:
    """(position, value) of a value selector: text, an attribute (addresses resolved) or the element's text."""
    sel, kind, attr = css.split_value_selector(selector)
    out = []
    for n in css.select(root, sel):
        if kind == "attr":
            if attr in n.attrs:
                v = n.get(attr)
                out.append((n.pre, (resolve(v, base) or v) if attr in ("href", "src", "action") else v))
        else:
            v = normal(n.own_text()) if kind == "text" else n.clean()
            if v or kind == "element":
                out.append((n.pre, v))
    return out


def values(pages: DataFrame, selector: str, first: bool = False, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """``node_id, value`` of a selector that may end in ``::text`` or ``::attr(name)``."""
    css.compile_selector(css.split_value_selector(selector)[0])

    def fn(root, u):
        return [{"node_id": i, "value": v} for i, v in values_of(root, selector, effective_base(root, u))[: 1 if first else None]]

    return _rows(pages, fn, "node_id int, value string", key, html, url)


def by_text(pages: DataFrame, text: str, match: str = "contains", selector: str = "*", case_sensitive: bool = False, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements whose own text is, contains or matches (``exact``, ``contains``, ``regex``) a text; code and styles are skipped."""
    css.compile_selector(selector)
    flags = 0 if case_sensitive else re.I
    rx = re.compile({"exact": rf"^{re.escape(text)}$", "contains": re.escape(text), "regex": text}[match], flags)

    def fn(root, _):
        return [_node(n) for n in css.select(root, selector) if n.tag not in ("script", "style", "template") and rx.search(normal(n.own_text()))]

    return _rows(pages, fn, NODE, key, html, None)


def by_xpath(pages: DataFrame, expression: str, first: bool = False, key: str = "page_id", html: str = "html") -> DataFrame:
    """Results of an XPath expression in document order: an element's position, tag and text; attribute values and text runs have no position."""
    run = compile_xpath(expression)

    def fn(root, _):
        out = []
        for i, x in enumerate(run(root)[: 1 if first else None]):
            node = isinstance(x, Node)
            out.append({"ord": i, "node_id": x.pre if node else None, "tag": x.tag if node and x.tag[0] != "#" else None, "value": (x.value if x.tag == "#text" else x.clean()) if node else x})
        return out

    return _rows(pages, fn, "ord int, node_id int, tag string, value string", key, html, None)


def selectors_for(pages: DataFrame, text: str, limit: int = 5, key: str = "page_id", html: str = "html") -> DataFrame:
    """Selectors that find the elements whose own text holds ``text``, best first: by id, by class, by tag, by position.

    ``matches`` counts the elements a selector finds on the page; of equal kinds the one that finds fewest is first.
    """

    def fn(root, _):
        seen: dict[str, tuple] = {}
        for n in root.elements():
            if n.tag in ("script", "style", "template") or text.lower() not in normal(n.own_text()).lower():
                continue
            ways = [(0, f"{n.tag}#{n.get('id')}")] if re.fullmatch(r"[A-Za-z][\w-]*", n.get("id")) else []
            ways += [(1, f"{n.tag}.{c}") for c in n.classes() if re.fullmatch(r"[A-Za-z][\w-]*", c)] + [(2, n.tag), (3, positional(n))]
            for kind, s in ways:
                if s not in seen:
                    seen[s] = (kind, len(css.select(root, s)), n.pre)
        order = sorted(seen, key=lambda s: (seen[s][0] == 2 and seen[s][1] > 1, seen[s][0], seen[s][1], seen[s][2], s))[:limit]
        return [{"rank": i + 1, "selector": s, "matches": seen[s][1]} for i, s in enumerate(order)]

    return _rows(pages, fn, "rank int, selector string, matches int", key, html, None)


# ---- fingerprints


def fingerprint(n: Node) -> dict:
    """Structural identity of an element."""
    same = [s for s in (n.parent.kids(n.tag) if n.parent is not None else [n])]
    return {
        "tag": n.tag, "attributes": {k: v for k, v in n.attrs.items() if k not in ("class", "style")}, "classes": sorted({w for c in n.classes() for w in re.split(r"[-_]", c.lower()) if w}),
        "text_hash": hashlib.sha256(n.clean()[:256].encode()).hexdigest()[:32], "children": [c.tag for c in n.kids()], "path": [a.tag for a in reversed(list(n.ancestors())) if a.tag[0] != "#"],
        "siblings": len(same),
    }


def _lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def score(want: dict, have: dict) -> int:
    """Likeness of two fingerprints: tag 20, attributes 15 each (id 40) to 70, classes 40, text 40, children 30, path 20, siblings 10."""
    s = 20 if want["tag"] == have["tag"] else 0
    s += min(70, sum(40 if k == "id" else 15 for k, v in want["attributes"].items() if v and have["attributes"].get(k) == v))
    a, b = set(want["classes"]), set(have["classes"])
    s += 40 * len(a & b) // len(a | b) if a | b else 0
    s += 40 if want["text_hash"] == have["text_hash"] else 0
    c, d = want["children"], have["children"]
    s += 15 if not c and not d else 30 * _lcs(c, d) // max(len(c), len(d)) if c and d else 0
    p, q = want["path"], have["path"]
    s += 20 * _lcs(p, q) // max(len(p), len(q)) if p and q else 0
    return s + (10 if want["siblings"] == have["siblings"] else 5 if min(want["siblings"], have["siblings"]) > 1 else 0)


def positional(n: Node) -> str:
    """A selector that finds just this element."""
    steps = []
    while n.parent is not None:
        if n.get("id") and re.fullmatch(r"[A-Za-z][\w-]*", n.get("id")):
            steps.append(f"{n.tag}#{n.get('id')}")
            break
        same = n.parent.kids(n.tag)
        steps.append(n.tag if len(same) == 1 else f"{n.tag}:nth-of-type({next(i for i, x in enumerate(same) if x is n) + 1})")
        n = n.parent
    return " > ".join(reversed(steps))


def similar(pages: DataFrame, selector: str, least: int = 80, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements like the first match of a selector on the same page: same tag and ancestor path, and a score of ``least``."""
    css.compile_selector(selector)

    def fn(root, _):
        m = css.select(root, selector)[:1]
        if not m:
            return []
        want = fingerprint(m[0])
        rows = []
        for n in root.elements(m[0].tag):
            have = fingerprint(n)
            if n is not m[0] and have["path"] == want["path"] and (s := score(want, have)) >= least:
                rows.append({"node_id": n.pre, "selector": positional(n), "score": s, "text": n.clean()})
        return rows

    return _rows(pages, fn, "node_id int, selector string, score int, text string", key, html, None)


def relocate(pages: DataFrame, want: dict, limit: int = 5, key: str = "page_id", html: str = "html") -> DataFrame:
    """The ``limit`` elements of each page most like a stored fingerprint, best first, with a confidence."""

    def fn(root, _):
        got = sorted(((score(want, fingerprint(n)), n) for n in root.elements()), key=lambda x: (-x[0], x[1].pre))[:limit]
        return [
            {"rank": i + 1, "selector": positional(n), "score": s, "confidence": "High" if s >= 120 else "Medium" if s >= 80 else "Low", "text": n.clean()[:256]}
            for i, (s, n) in enumerate(got) if s >= 40
        ]

    return _rows(pages, fn, "rank int, selector string, score int, confidence string, text string", key, html, None)


# ---- records


def records(pages: DataFrame, item_selector: str, fields: dict[str, str], key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """One row per item with a column per field; each field is a value selector inside the item, the first value counts.

    Fields are strings; cast them with ``try_cast``. A field without a match or with an empty value is null.
    """
    css.compile_selector(item_selector)
    for f in fields.values():
        css.compile_selector(css.split_value_selector(f)[0])

    def fn(root, u):
        base = effective_base(root, u)
        out = []
        for i, item in enumerate(css.select(root, item_selector)):
            r: dict = {"item_ix": i}
            for name, sel in fields.items():
                got = [(0, normal(item.own_text()))] if sel == "::text" else values_of(item, sel, base)
                r[name] = next((v for _, v in got if v.strip()), None)
            out.append(r)
        return out

    return _rows(pages, fn, "item_ix int, " + ", ".join(f"{n} string" for n in fields), key, html, url)


def record_report(found: DataFrame, fields: list[str], required: list[str] = ()) -> DataFrame:
    """``field, items, filled, coverage, status`` over extracted records: missing, partial or complete."""
    agg = found.agg(F.count("*").alias("items"), *[F.count(f).alias(f) for f in fields])
    long = agg.select("items", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.lit(f in required).alias("required")) for f in fields])).alias("x")).select("items", "x.*")
    cov = F.bround(F.when(F.col("items") > 0, 100.0 * F.col("filled") / F.col("items")).otherwise(0.0), 2)
    return long.select("field", "items", "filled", cov.alias("coverage"), F.when(F.col("filled") == 0, F.when(F.col("required"), "MissingRequired").otherwise("Missing")).when(F.col("filled") < F.col("items"), "Partial").otherwise("Complete").alias("status"))


_PRICE = re.compile(r"[$€£¥]\s?\d|\d[\d.,]*\s?(?:USD|EUR|PLN|€|zł)")


def collections(pages: DataFrame, query: str = "", least: int = 3, limit: int = 5, key: str = "page_id", html: str = "html") -> DataFrame:
    """Repeated record-like elements of each page, scored: ``rank, selector, items, fields, score, confidence``."""

    def fn(root, _):
        groups: dict[str, list[Node]] = defaultdict(list)
        for n in root.elements():
            for c in dict.fromkeys(n.classes()):
                if re.fullmatch(r"[A-Za-z][\w-]*", c):
                    groups[f"{n.tag}.{c}"].append(n)
            if n.tag in ("li", "tr", "article"):
                groups[n.tag].append(n)
        out = []
        for sel, items in groups.items():
            if len(items) < least or sum(1 for n in items if n.closest("nav")) > len(items) / 2 and not query:
                continue
            seen: Counter = Counter()
            for n in items:
                have = set()
                for d in n.elements():
                    if d.tag == "a" and d.get("href"):
                        have.add("link")
                    elif d.tag == "img":
                        have.add("image")
                    elif d.tag in ("h1", "h2", "h3", "h4"):
                        have.add("title")
                    elif d.tag in ("p", "span", "time") and d.clean():
                        have.add(d.tag)
                if _PRICE.search(n.text()):
                    have.add("price")
                seen.update(have)
            fields = sorted(f for f, k in seen.items() if k >= 0.4 * len(items))
            s = min(35, 5 * len(items)) + min(48, 8 * len(fields)) + sum(15 for f in ("link", "title", "price") if f in fields)
            s += 16 if re.search(r"product|card", sel) else 8 if "item" in sel else 0
            s -= 10 if "grid" in sel else 0
            s -= 5 if "." not in sel else 0
            s += 20 if query and any(query.lower() in n.text().lower() for n in items) else 0
            s -= 30 if sum(1 for n in items if n.closest("nav")) > len(items) / 2 else 0
            s -= 20 if len(items) > 100 else 0
            out.append({"selector": sel, "items": len(items), "fields": fields, "score": s, "confidence": "High" if s >= 120 else "Medium" if s >= 80 else "Low"})
        out.sort(key=lambda r: (-r["score"], -len(r["fields"]), r["items"], r["selector"]))
        return [{"rank": i + 1, **r} for i, r in enumerate(out[:limit])]

    return _rows(pages, fn, "rank int, selector string, items int, fields array<string>, score int, confidence string", key, html, None)


# ---- the tree as a table


def dom_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements with pre-order interval labels: a descendant's ``pre`` lies in (pre, last_pre] of its ancestor."""

    def fn(root, _):
        for n in root.elements():
            sib = n.parent.kids() if n.parent is not None else [n]
            yield {"pre": n.pre, "last_pre": n.last, "parent_pre": n.parent.pre if n.parent is not None else None, "depth": n.depth, "tag": n.tag, "attributes": list(n.attrs.items()), "own_text": normal(n.own_text()), "sibling_ix": next(i for i, s in enumerate(sib) if s is n)}

    return _rows(pages, fn, "pre int, last_pre int, parent_pre int, depth int, tag string, attributes map<string,string>, own_text string, sibling_ix int", key, html, None)


def inside(nodes: DataFrame, ancestors: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes that stand inside one of the given ancestors of their page: an interval semi join."""
    a = ancestors.select(F.col(key).alias("_k"), F.col("pre").alias("_a"), F.col("last_pre").alias("_z"))
    return nodes.join(a, (F.col(key) == F.col("_k")) & (F.col("pre") > F.col("_a")) & (F.col("pre") <= F.col("_z")), "left_semi")


def outside(nodes: DataFrame, ancestors: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes that neither are nor stand inside one of the given ancestors: an interval anti join."""
    a = ancestors.select(F.col(key).alias("_k"), F.col("pre").alias("_a"), F.col("last_pre").alias("_z"))
    return nodes.join(a, (F.col(key) == F.col("_k")) & (F.col("pre") >= F.col("_a")) & (F.col("pre") <= F.col("_z")), "left_anti")


# ---- style sheets


def style_rules(sheets: DataFrame, key: str, column: str = "css") -> DataFrame:
    """One row per declaration: rule position, selector, property, value, importance, condition and specificity."""

    def run(b, _):
        out: dict = {n: [] for n in ("key", "rule_ix", "selector", "property", "value", "important", "condition", "specificity")}
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for i, r in enumerate(css.rules(text or "")):
                try:
                    sp = list(css.specificity(r["selector"]))
                except css.SelectorError:
                    sp = None
                for p, v, imp in r["declarations"]:
                    for n, x in zip(out, (k, i, r["selector"], p, v, imp, r["condition"], sp)):
                        out[n].append(x)
        return out

    kind = sheets.schema[key].dataType.simpleString()
    schema = f"key {kind}, rule_ix int, selector string, property string, value string, important boolean, condition string, specificity array<int>"
    return map_arrow(sheets.select(F.col(key).alias("key"), F.col(column).alias("css")), run, schema).withColumnRenamed("key", key)


def style_variables(rules: DataFrame) -> DataFrame:
    return rules.where(F.startswith("property", F.lit("--")))


def style_usage(pages: DataFrame, limit: int = 20, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rules of a page's own style elements with the number of elements they match and the first ``limit`` of them."""

    def fn(root, _):
        for i, r in enumerate(x for s in root.elements("style") for x in css.rules(s.text())):
            try:
                hit = css.select(root, r["selector"])
            except css.SelectorError:
                continue
            yield {"rule_ix": i, "selector": r["selector"], "matches": len(hit), "elements": [positional(n) for n in hit[:limit]]}

    return _rows(pages, fn, "rule_ix int, selector string, matches int, elements array<string>", key, html, None)


def save_recipe(item_selector: str, fields: dict[str, str]) -> str:
    """A record extraction as JSON text."""
    css.compile_selector(item_selector)
    return json.dumps({"version": 1, "item": item_selector, "fields": fields}, sort_keys=True)


def run_recipe(pages: DataFrame, recipe: str, **kw) -> DataFrame:
    r = json.loads(recipe)
    if r.get("version") != 1 or not r.get("fields"):
        raise ValueError("not a recipe of version 1")
    return records(pages, r["item"], r["fields"], **kw)


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``shape, change``: item shapes that were added or are missing; a shape is the set of filled fields."""

    def shape(df: DataFrame) -> DataFrame:
        cols = sorted(c for c in df.columns if c not in ("page_id", "item_ix"))
        return df.select(F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in cols])), ",").alias("shape")).distinct()

    a, b = shape(baseline), shape(current)
    return a.subtract(b).withColumn("change", F.lit("missing")).unionByName(b.subtract(a).withColumn("change", F.lit("added")))
