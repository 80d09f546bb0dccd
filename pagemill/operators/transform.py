"""Whole-page transforms and comparisons over columns, and the merged API catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import dom, formats, redact, scripts, text
from pagemill.functions.batches import map_arrow


def _body(html: str):
    root = dom.parse(html)
    return root.first("body") or root


#: Transforms by name: markup in, text out; null stays null.
TRANSFORMS = {
    "format_html": formats.format_html, "minify_html": formats.minify_html, "inline_css": formats.inline_css, "format_css": formats.format_css, "minify_css": formats.minify_css,
    "entity_decode": formats.deentitize, "entity_encode": formats.entitize, "markdown": lambda h: text.markdown(_body(h)), "text": lambda h: text.fragment_text(_body(h)),
    "lines": lambda h: text.fragment_lines(_body(h)), "readable": lambda h: text.readable(dom.parse(h))["text"],
    "minify_js": scripts.minify_js, "format_js": scripts.format_js, "redact_url": redact.redact_url, "redact_structured": redact.redact_structured, "redact_links": redact.redact_links,
}


def transform(df: DataFrame, name: str, key: str = "page_id", column: str = "html") -> DataFrame:
    """``key`` and one column named after the transform."""
    fn = TRANSFORMS[name]
    kind = df.schema[key].dataType.simpleString()

    def run(b, _):
        return {"key": b.column(0).to_pylist(), "out": [None if v is None else fn(v) for v in b.column(1).to_pylist()]}

    return map_arrow(df.select(F.col(key).alias("key"), F.col(column).alias("v")), run, f"key {kind}, out string").toDF(key, name)


def differences(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """``key, kind, path, old, new`` between two versions of a page; a null version counts as an empty page."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(b, _):
        out: dict = {n: [] for n in ("key", "kind", "path", "old", "new")}
        for k, x, y in zip(*(b.column(i).to_pylist() for i in range(3))):
            for d in formats.compare(x or "", y or ""):
                out["key"].append(k)
                for n in ("kind", "path", "old", "new"):
                    out[n].append(d[n])
        return out

    got = map_arrow(pairs.select(F.col(key).alias("key"), F.col(old).alias("o"), F.col(new).alias("n")), run, f"key {kind}, kind string, path string, old string, new string")
    return got.withColumnRenamed("key", key)


def api_catalog(endpoints: DataFrame) -> DataFrame:
    """Endpoints of all documentation pages merged by method and path: longest summary, all parameters, pages and mean score."""
    return endpoints.groupBy("method", "path").agg(
        F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("summary"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("parameters")))).alias("parameters"),
        F.countDistinct("page_id").alias("pages"), F.round(F.avg("score"), 2).alias("mean_score"), F.max("promoted").alias("promoted"),
    )


def embed_images(pages: DataFrame, assets: DataFrame, limit: int = 200_000, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, html``: pages whose images of known content are data addresses.

    ``assets`` holds ``key, reference, content_type, data``: the image as the page refers to it. Only
    these rows are grouped, at most ``limit`` bytes an image; larger ones stay references.
    """
    a = assets.where(F.octet_length("data") <= limit).groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.collect_set(F.struct("reference", F.concat(F.lit("data:"), "content_type", F.lit(";base64,"), F.base64("data"))))).alias("places"))
    kind = pages.schema[key].dataType.simpleString()

    def run(b, _):
        out = []
        for h, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            root = dom.parse(h) if h and places else None
            for n in root.elements("img") if root is not None else ():
                n.attrs["src"] = dict(places).get(n.get("src"), n.get("src"))
            out.append(h if root is None else dom.serialise(root))
        return {"key": b.column(0).to_pylist(), "html": out}

    j = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).join(a, F.col("key") == F.col("_k"), "left").select("key", "html", "places")
    return map_arrow(j, run, f"key {kind}, html string").withColumnRenamed("key", key)


def linked_endpoints(references: DataFrame, scripts_: DataFrame) -> DataFrame:
    """Endpoints of the scripts that pages link to: each script is read once, whatever pages link to it.

    ``references`` holds ``page_id, src``; ``scripts_`` ``url, content``.
    """
    from pagemill.operators.extract import endpoints_of

    def run(b, _):
        out: dict = {n: [] for n in ("script_url", "method", "url", "client", "operation")}
        for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for r in endpoints_of(t or ""):
                out["script_url"].append(u)
                for n in ("method", "url", "client", "operation"):
                    out[n].append(r[n])
        return out

    once = scripts_.groupBy("url").agg(F.min("content").alias("content"))
    found = map_arrow(once.join(references.select(F.col("src").alias("url")), "url", "left_semi").select("url", "content"), run, "script_url string, method string, url string, client string, operation string")
    return references.select("page_id", F.col("src").alias("script_url")).distinct().join(found, "script_url")


def sign_on_handoffs(forms: DataFrame) -> DataFrame:
    """Forms that hand a sign-on over: kind, field names, what they carry, and the target with sensitive values hidden.

    ``forms`` are rows of the extractor of that name. Kinds are saml, wsfed, oidc and oauth, in this
    order of precedence; forms with none of their fields are left out. Values don't come out.
    """
    from pagemill.functions.columns import redact_query

    names = F.transform("fields", lambda f: F.lower(f["name"]))
    has = lambda *n: F.arrays_overlap(names, F.array(*[F.lit(x) for x in n]))
    filled = lambda n: F.exists("fields", lambda f: (F.lower(f["name"]) == n) & (F.trim(f["value"]) != ""))
    kind = F.when(has("samlresponse", "samlrequest"), "saml").when(has("wresult"), "wsfed").when(has("id_token"), "oidc").when(has("code", "access_token", "error"), "oauth")
    return forms.withColumn("kind", kind).where("kind is not null").select(
        "page_id", "form_ix", "kind", "method", redact_query(F.col("action")).alias("action"), F.transform("fields", lambda f: f["name"]).alias("field_names"),
        filled("code").alias("authorization_code_present"), (filled("state") | filled("relaystate")).alias("state_present"),
        F.element_at(F.concat(F.transform(F.filter("fields", lambda f: F.lower(f["name"]) == "error"), lambda f: f["value"]), F.array(F.lit(""))), 1).alias("error"),
    )


def table_values(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """All tables as one long table: ``page_id, table_ix, row_ix, column, value, type``, with the type that all values of the column fit.

    ``rows`` and ``heads`` are rows of the extractors ``tables`` and ``table_heads``.
    """
    types = heads.select("page_id", "table_ix", F.explode(F.map_from_arrays("headers", "types")).alias("column", "type"))
    cells = rows.where("row_ix is not null").select("page_id", "table_ix", "row_ix", F.explode("cells").alias("column", "value"))
    return cells.join(types, ["page_id", "table_ix", "column"], "left").select("page_id", "table_ix", "row_ix", "column", "value", "type")
