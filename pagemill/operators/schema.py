"""Shapes of data: JSON schemas inferred and merged, property paths, typed records, interface documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.functions.columns import web_date

# ---- JSON schema


def schema_of(value) -> dict:
    """Schema of one JSON value."""
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: schema_of(v) for k, v in sorted(value.items())}, "required": sorted(value)}
    if isinstance(value, list):
        items: dict = {}
        for v in value:
            items = merge_schemas(items, schema_of(v))
        return {"type": "array", "items": items}
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string"
    return {"type": kind}


def _kinds(s: dict) -> set:
    t = s.get("type", [])
    return set(t) if isinstance(t, list) else {t}


def merge_schemas(a: dict, b: dict) -> dict:
    """Schema that admits what either admits; associative and commutative. A property is required if both always have it."""
    if not a or not b:
        return a or b
    kinds = _kinds(a) | _kinds(b)
    if "number" in kinds:
        kinds.discard("integer")
    out: dict = {"type": next(iter(kinds)) if len(kinds) == 1 else sorted(kinds)}
    if "object" in kinds:
        both = [s for s in (a, b) if "properties" in s]
        names = sorted({n for s in both for n in s["properties"]})
        out["properties"] = {n: merge_schemas(*([s["properties"].get(n, {}) for s in both] + [{}] * (2 - len(both)))) for n in names}
        out["required"] = sorted(set.intersection(*[set(s["required"]) for s in both]))
    if "array" in kinds:
        out["items"] = merge_schemas(a.get("items", {}), b.get("items", {}))
    return out


def json_schemas(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """``by, schema, records``: the merged schema of the JSON texts of each group.

    Texts are merged inside each batch first, so a group sends one schema per batch whatever its
    rows; distinct schemas are then merged. Unreadable and null texts count as no record.
    """
    names = [f"k{i}" for i in range(len(by))]
    kinds = [rows.schema[c].dataType.simpleString() for c in by]

    def partial(b, _):
        got: dict = {}
        cols = [b.column(i).to_pylist() for i in range(len(by))]
        for i, t in enumerate(b.column(len(by)).to_pylist()):
            try:
                s = schema_of(json.loads(t)) if t else None
            except (ValueError, RecursionError):
                s = None
            if s is not None:
                k = tuple(c[i] for c in cols)
                old = got.get(k, ({}, 0))
                got[k] = (merge_schemas(old[0], s), old[1] + 1)
        out = {n: [k[i] for k in got] for i, n in enumerate(names)}
        return {**out, "schema": [json.dumps(s, sort_keys=True) for s, _ in got.values()], "records": [n for _, n in got.values()]}

    keys = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    part = map_arrow(rows.select(*[F.col(c).alias(n) for c, n in zip(by, names)], text), partial, f"{keys}, schema string, records bigint")
    part = part.groupBy(*names, "schema").agg(F.sum("records").alias("records"))

    def merged(key, frame):
        s: dict = {}
        for t in frame["schema"]:
            s = merge_schemas(s, json.loads(t))
        return pd.DataFrame([[*key, json.dumps(s, sort_keys=True), int(frame["records"].sum())]], columns=[*names, "schema", "records"])

    got = part.groupBy(*names).applyInPandas(merged, f"{keys}, schema string, records bigint")
    return got.toDF(*by, "schema", "records")


# ---- property paths


def property_path(column: Column, path: str) -> Column:
    """Value of a JSON text at a path such as ``a.b[0].c``, as text; null where there is none."""
    steps = re.findall(r"[^.\[\]]+|\[\d+\]", path)
    return F.get_json_object(column, "$" + "".join(s if s[0] == "[" else f"['{s}']" for s in steps))


def typed(column: Column, schema: str) -> Column:
    """JSON text read by a schema; null where it doesn't fit."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


# ---- field conversion

#: Names of the scalar types a field can have, with the type that holds them.
FIELD_TYPES = {
    "string": "string", "boolean": "boolean", "char": "string", "byte": "smallint", "sbyte": "tinyint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint",
    "uint64": "decimal(20,0)", "single": "float", "double": "double", "decimal": "decimal(28,8)", "datetime": "timestamp", "datetimeoffset": "timestamp",
}


def convert(value: Column, kind: str) -> Column:
    """Text as a field of a named type; null where it can't be read. Numbers may have thousands separators, dates any web form."""
    k = kind.lower()
    if k not in FIELD_TYPES:
        raise ValueError(f"no such field type: {kind}")
    t = F.trim(value)
    if k in ("string", "char"):
        return value if k == "string" else F.when(F.length(value) == 1, value)
    if k == "boolean":
        return F.when(F.lower(t) == "true", True).when(F.lower(t) == "false", False)
    if k in ("datetime", "datetimeoffset"):
        return web_date(t)
    number = F.when(t.rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d*)(\.\d+)?([eE][+-]?\d+)?$"), F.replace(t, F.lit(","), F.lit("")))
    return number.try_cast(FIELD_TYPES[k])


def convert_fields(records: DataFrame, kinds: dict[str, str], defaults: dict[str, object] | None = None, required: list[str] = ()) -> DataFrame:
    """Records with typed fields, and ``failed``: the fields that had a text which their type can't read, or miss one they need."""
    defaults = defaults or {}
    out, failed = [], []
    for c in records.columns:
        if c not in kinds:
            out.append(F.col(c))
            continue
        v = convert(F.col(c), kinds[c])
        failed.append(F.when(F.col(c).isNotNull() & (F.trim(c) != "") & v.isNull() | (F.lit(c in required) & F.col(c).isNull()), F.lit(c)))
        out.append((F.coalesce(v, F.lit(defaults[c]).cast(FIELD_TYPES[kinds[c].lower()])) if c in defaults else v).alias(c))
    return records.select(*out, F.array_compact(F.array(*failed)).alias("failed") if failed else F.array().cast("array<string>").alias("failed"))


# ---- interface documents


def openapi_documents(endpoints: DataFrame, by: str, title: str = "API") -> DataFrame:
    """``by, document, operations``: an OpenAPI 3 document per group of ``method, path, summary, parameters, promoted`` rows.

    Endpoints that aren't promoted are left out. Equal operations are merged first: the longest
    summary and all parameters stay, so the document of a group holds one entry per operation.
    """
    ops = endpoints.where("promoted").groupBy(by, "path", F.lower("method").alias("method")).agg(
        F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("summary"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("parameters")))).alias("parameters")
    )
    parameter = lambda p: F.struct(p.alias("name"), F.lit("path").alias("in"), F.lit(True).alias("required"), F.struct(F.lit("string").alias("type")).alias("schema"))
    ok = F.create_map(F.lit("200"), F.struct(F.lit("Success").alias("description")))
    op = F.struct(F.col("summary"), F.transform("parameters", parameter).alias("parameters"), ok.alias("responses"))
    # A JSON text per path, joined in order: the keys of a record can't be data, those of a text can.
    member = lambda key, value: F.concat(F.lit('"'), F.regexp_replace(key, r'(["\\\\])', r"\\$1"), F.lit('":'), value)
    joined = lambda entries: F.array_join(F.transform(F.array_sort(F.collect_list(entries)), lambda e: e["text"]), ",")
    paths = ops.groupBy(by, "path").agg(joined(F.struct(F.col("method"), member(F.col("method"), F.to_json(op)).alias("text"))).alias("ops"), F.count("*").alias("n"))
    doc = paths.groupBy(by).agg(joined(F.struct(F.col("path"), member(F.col("path"), F.concat(F.lit("{"), "ops", F.lit("}"))).alias("text"))).alias("paths"), F.sum("n").alias("operations"))
    head = json.dumps({"openapi": "3.0.3", "info": {"title": title, "version": "1.0.0"}}, separators=(",", ":"))[:-1]
    return doc.select(by, F.concat(F.lit(head + ',"paths":{'), "paths", F.lit("}}")).alias("document"), "operations")
