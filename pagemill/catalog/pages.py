"""Queries that parse pages: one per extractor, selection, audit and discovery operator."""

from pyspark.sql import functions as F

from pagemill.operators import audit, corpus, select, transform
from pagemill.operators.extract import EXTRACTORS, extract, extract_joined
from pagemill.session import load

QUERIES: dict = {}
SQL: dict = {}


def addresses(spark, d):
    return load(spark, d, "crawl_pages").select("page_id", "url")


def _extractor(kind: str):
    return lambda spark, d: extract(load(spark, d, "http_cache"), kind, urls=addresses(spark, d))


for _kind in EXTRACTORS:
    QUERIES[f"extract_{_kind}"] = _extractor(_kind)


def host_overview(spark, d):
    """Pages, outgoing links and readable words of each host, from one parse of each page."""
    x = extract_joined(load(spark, d, "http_cache").select("page_id", "html"), ["crawl_links", "readable"], addresses(spark, d))
    x = x.select("page_id", F.size("crawl_links").alias("links"), F.col("readable")[0]["words"].alias("words"))
    p = load(spark, d, "crawl_pages").where("page_id is not null and host is not null").groupBy("page_id").agg(F.min("host").alias("host"))
    return x.join(p, "page_id").groupBy("host").agg(F.count("*").alias("pages"), F.sum("links").alias("links"), F.round(F.avg("words"), 3).alias("mean_words"))


QUERIES |= {
    "host_overview": host_overview,
    "select_elements": lambda s, d: select.elements(load(s, d, "http_cache"), "article p, main p, div.t").drop("html"),
    "select_values": lambda s, d: select.values(load(s, d, "http_cache"), "li > a::attr(href)"),
    "select_by_text": lambda s, d: select.by_text(load(s, d, "http_cache"), "javascript", selector="p, h1, h2").drop("html"),
    "select_similar": lambda s, d: select.similar(load(s, d, "http_cache"), "li"),
    "select_records": lambda s, d: select.records(load(s, d, "http_cache"), "tr", {"name": "td:nth-child(1)", "amount": "td:nth-child(2)", "note": "td:nth-child(3)"}),
    "record_report": lambda s, d: select.record_report(select.records(load(s, d, "http_cache"), "tr", {"name": "td:nth-child(1)", "amount": "td:nth-child(2)", "link": "a::attr(href)"}), ["name", "amount", "link"]),
    "select_collections": lambda s, d: select.collections(load(s, d, "http_cache")),
    "style_usage": lambda s, d: select.style_usage(load(s, d, "http_cache")),
    "dom_nodes": lambda s, d: select.dom_nodes(load(s, d, "http_cache")),
    "audit": lambda s, d: audit.audit(load(s, d, "http_cache")),
    "compatibility": lambda s, d: audit.compatibility(load(s, d, "http_cache")),
}


def nodes_outside_navigation(spark, d):
    n = select.dom_nodes(load(spark, d, "http_cache"))
    return select.outside(n, n.where("tag in ('nav', 'footer', 'aside')")).select("page_id", "pre", "tag")


QUERIES["nodes_outside_navigation"] = nodes_outside_navigation


def api_catalog(spark, d):
    return transform.api_catalog(extract(load(spark, d, "http_cache"), "doc_endpoints", url=None))


def page_changes(spark, d):
    """Differences between the two latest cached bodies of each address.

    Which bodies these are is told by ids alone; only bodies of addresses with two of them are moved, once.
    """
    cache = load(spark, d, "http_cache")
    p = load(spark, d, "crawl_pages").where("page_id is not null and url is not null").groupBy("page_id").agg(F.min("url").alias("url"), F.min("started").alias("started"))
    p = p.join(cache.where("html is not null").select("page_id"), "page_id", "left_semi")
    t = corpus.last_two(p, "url", ["started", "page_id"]).where("previous is not null")
    role = lambda c, name: F.struct(F.col(f"{c}.page_id").alias("page_id"), F.lit(name).alias("role"))
    pairs = t.select("url", F.explode(F.array(role("last", "new"), role("previous", "old"))).alias("x"))
    both = cache.select("page_id", "html").join(pairs.select("url", "x.page_id", "x.role"), "page_id").groupBy("url").agg(*[F.max(F.when(F.col("role") == r, F.col("html"))).alias(r) for r in ("old", "new")])
    return transform.differences(both, "url", "old", "new")


def _transform(name: str):
    return lambda spark, d: transform.transform(load(spark, d, "http_cache"), name)


QUERIES |= {"api_catalog": api_catalog, "page_changes": page_changes} | {f"transform_{n}": _transform(n) for n in ("format_html", "minify_html", "inline_css", "markdown")}
