"""Deeply nested records to flat tables, with Merkle identities.

Every object gets an identity: the hash of its canonical form, in which child objects are
replaced by their own identities, so equal subtrees are equal ids and are stored once. Where
and how often an object occurs is kept in bridge rows (page, path, parent path, ordinal).
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow

#: The properties that hold arrays of objects.
ARRAYS = (
    "MetaTags", "Regions", "Breadcrumbs", "Items", "FaqItems", "SpecTables", "Entries", "CodeBlocks", "Callouts",
    "ApiEndpoints", "Parameters", "RequestExamples", "ResponseExamples", "Headers", "BodyFields", "Forms", "Fields",
    "Tables", "Data",
)

BRIDGE = "page_id bigint, kind string, node_path string, parent_path string, ordinal int, node_id string, parent_id string, attributes string"


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def read_json(text: str):
    """Value of a JSON text of any depth; ValueError where it isn't JSON. The usual reader, and an explicit stack where that runs out of its own."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    root: list = []
    stack: list = [root]
    key = None
    keys: list = []
    state, at = "value", 0  # what may come next: value, first (value or end), key, firstkey, colon, more (comma or end)
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            break
        at = m.end()
        mark, top = m[1], stack[-1]
        if state in ("value", "first") and (mark in ("{", "[") or mark is None):
            v = ({} if mark == "{" else []) if mark else json.loads(m[2] or m[3])
            if isinstance(top, dict):
                top[key] = v
            else:
                top.append(v)
            state = "more"
            if mark:
                stack.append(v)
                keys.append(key)
                state = "firstkey" if mark == "{" else "first"
        elif state in ("key", "firstkey") and m[2]:
            key, state = json.loads(m[2]), "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "more" and mark == "," and len(stack) > 1:
            state = "key" if isinstance(top, dict) else "value"
        elif len(stack) > 1 and (mark == "}" and isinstance(top, dict) and state in ("more", "firstkey") or mark == "]" and isinstance(top, list) and state in ("more", "first")):
            stack.pop()
            key, state = keys.pop(), "more"
        else:
            break
    if len(stack) != 1 or len(root) != 1 or text[at:].strip(" \t\n\r"):
        raise ValueError("not JSON")
    return root[0]


def _loads(text: str):
    """Parsed JSON; a string that itself holds JSON text is opened, twice at most. None if it can't be parsed."""
    try:
        v = read_json(text)
        for _ in range(2):
            if isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"'):
                v = read_json(v)
        return v
    except ValueError:
        return None


def _cap(name: str) -> str:
    return name[:1].upper() + name[1:]


def node_identity(kind: str, attributes: str, children: list[tuple[str, int, str]]) -> str:
    """128-bit identity of an object from its own attributes and its children's identities."""
    return xxhash.xxh3_128_hexdigest(json.dumps([kind, attributes, children], ensure_ascii=True, separators=(",", ":")))


class _Object:
    """An object being read: where it stands, what it holds so far, and what of it is left to read."""

    __slots__ = ("attributes", "children", "kind", "left", "ordinal", "owner", "path", "rel", "slot", "slots")

    def __init__(self, kind: str, path: str, owner: str, ordinal: int, slot: int, rel, value):
        self.kind, self.path, self.owner, self.ordinal, self.slot, self.rel = kind, path, owner, ordinal, slot, rel
        self.attributes: dict = {}
        self.children: list = []
        self.slots: list[int] = []
        #: (value, name of the array it is an element of or '', steps to it, ordinal or -1), next one last.
        self.left: list = [(value, "", None, -1)]


def _join(steps) -> str:
    """Text of a chain (earlier steps, text, whether a dot stands before it)."""
    out = []
    while steps is not None:
        steps, text, dot = steps
        out.append(text)
        if dot and steps is not None:
            out.append(".")
    return "".join(reversed(out))


def unfold(record, arrays: frozenset[str] = frozenset(ARRAYS)) -> list[tuple]:
    """(kind, node_path, parent_path, ordinal, node_id, parent_id, attributes) of each array element that is an object.

    Objects are read with a stack of their own, children before the identity of their parent, so
    records may be nested to any depth.
    """
    rows: list[tuple] = []
    if isinstance(record, list):
        record = {"": record}
    if not isinstance(record, dict):
        return rows
    stack = [_Object("", "", "", 0, -1, "", record)]
    while stack:
        o = stack[-1]
        if not o.left:
            attributes = json.dumps(o.attributes, ensure_ascii=True, sort_keys=True, separators=(",", ":"))
            node = node_identity(o.kind, attributes, o.children)
            for s in o.slots:
                rows[s] = (*rows[s][:5], node, rows[s][6])
            stack.pop()
            if stack:
                rows[o.slot] = (o.kind, o.path, o.owner, o.ordinal, node, None, attributes)
                stack[-1].children.append((o.rel, o.ordinal, node))
            continue
        v, kind, steps, ordinal = o.left.pop()
        if ordinal >= 0 and isinstance(v, dict):
            # An element that is an object: a row of its own.
            at = _join((steps, f"[{ordinal}]", False))
            path = at if not o.path else f"{o.path}.{at}"
            o.slots.append(len(rows))
            rows.append(())
            stack.append(_Object(kind, path, o.path, ordinal, len(rows) - 1, _join(steps), v))
        elif isinstance(v, dict):
            names = sorted(v, key=_cap)
            for k in reversed(names):
                o.left.append((_opened(v[k]) if _cap(k) in arrays else v[k], _cap(k), (steps, _cap(k), True), -1))
        elif isinstance(v, list) and (ordinal >= 0 or kind in arrays or any(isinstance(x, (dict, list)) for x in v)):
            # A list inside a list counts on from the place of the outer one.
            inner = steps if ordinal < 0 else (steps, f"[{ordinal}]", False)
            o.left += [(x, kind, inner, i) for i, x in reversed(list(enumerate(v)))]
        elif ordinal < 0:
            o.attributes[_join(steps)] = v
        elif v is not None:
            o.attributes[_join((steps, f"[{ordinal}]", False))] = v
        if o.left and o.left[-1][3] < 0 and isinstance(o.left[-1][0], dict) and o.left[-1][1] in arrays:
            # A single object in the place of an array counts as its element 0.
            x, name, where, _ = o.left.pop()
            o.left.append((x, name, where, 0))
    return rows


def _opened(v):
    """What a string of JSON text holds, if that is a list or an object."""
    if isinstance(v, str):
        held = _loads(v)
        return held if isinstance(held, (list, dict)) else v
    return v


def bridge(pages: DataFrame, column: str = "structured_json", key: str = "page_id") -> DataFrame:
    """One row per occurrence of an array element that is an object.

    Null, empty, blank and cut-off records give no rows, as do records that hold no object. Nulls in
    an array count in the ordinals. Any depth of nesting is read. Repeated input rows give the same rows again; see ``occurrences``.
    """

    def fn(b: pa.RecordBatch, _):
        out: dict[str, list] = {c.split()[0]: [] for c in BRIDGE.split(", ")}
        names = list(out)
        for pid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text or text.isspace():
                continue
            for r in unfold(_loads(text)):
                out["page_id"].append(pid)
                for n, v in zip(names[1:], r):
                    out[n].append(v)
        return out

    return map_arrow(pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(column).alias("j")), fn, BRIDGE)


def occurrences(rows: DataFrame) -> DataFrame:
    """Bridge rows without those of repeated deliveries."""
    return rows.drop("attributes").distinct()


def objects(rows: DataFrame) -> DataFrame:
    """Each distinct object once: ``node_id, kind, attributes, occurrences``; a repeated delivery of a page counts once.

    Equal identities have equal attributes, so the least of them stands for all, and the places of
    an object are counted as hashes of (page, path).
    """
    once = rows.groupBy("node_id", "kind", F.xxhash64("page_id", "node_path").alias("place")).agg(F.min("attributes").alias("attributes"))
    return once.groupBy("node_id", "kind").agg(F.min("attributes").alias("attributes"), F.count("*").alias("occurrences"))


def flat_table(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The flat table of one kind: keys plus the named scalar attributes (null where absent)."""
    r = rows.where(F.col("kind") == kind)
    return r.select(
        "page_id", "node_path", "parent_path", "ordinal", "node_id", "parent_id", *[F.get_json_object("attributes", f"$['{c}']").alias(c) for c in columns]
    ).distinct()
