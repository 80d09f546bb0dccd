"""Exports of a crawl: one folder per dataset, each written by all executors at once."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_crawl(folder: str, pages: DataFrame, links: DataFrame | None = None, chunks: DataFrame | None = None, assets: DataFrame | None = None) -> None:
    """pages.jsonl, pages.csv, skipped pages and assets, links.jsonl, chunks.jsonl and assets.jsonl under ``folder``."""
    skipped = F.col("status") == "Skipped"
    by_asset = F.coalesce(F.col("skip_reason") == "AssetPath", F.lit(False))
    pages.write.mode("overwrite").json(f"{folder}/pages.jsonl")
    flat = pages.select(*[c if not t.startswith(("array", "map", "struct")) else F.to_json(c).alias(c) for c, t in pages.dtypes])
    flat.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(f"{folder}/pages.csv")
    pages.where(skipped & ~by_asset).write.mode("overwrite").json(f"{folder}/skipped-pages.jsonl")
    pages.where(skipped & by_asset).write.mode("overwrite").json(f"{folder}/skipped-assets.jsonl")
    for name, df in (("links", links), ("chunks", chunks), ("assets", assets)):
        if df is not None:
            df.write.mode("overwrite").json(f"{folder}/{name}.jsonl")


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text lines."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def csv_field(value) -> object:
    """A CSV field: quoted where needed, line ends as one kind."""
    v = F.regexp_replace(value, "\r\n?", "\n")
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def report_text(histograms: DataFrame) -> str:
    """A text report of summary histograms, which hold a few rows per facet."""
    out: dict[str, list[str]] = {}
    for r in histograms.orderBy("facet", F.desc("n"), "value").collect():
        out.setdefault(r["facet"], []).append(f"  {r['value']}: {r['n']}")
    return "\n".join(f"{k}\n" + "\n".join(v) for k, v in out.items())


def read_export(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A dataset that ``export_crawl`` wrote: pages, skipped-pages, skipped-assets, links, chunks or assets."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{folder}/{name}.jsonl")


def graph_rows(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """``part, value``: the lines of a graph export, one JSON text per node and per edge."""
    nodes = degrees.select(F.lit("node").alias("part"), F.to_json(F.struct("url", "in_degree", "out_degree", "internal_out")).alias("value"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("source", "target", "relation")).alias("value")))


def write_graph(folder: str, edges: DataFrame, degrees: DataFrame) -> None:
    """nodes and edges of a link graph under ``folder``/graph, a folder of JSON lines each."""
    graph_rows(edges, degrees).write.mode("overwrite").partitionBy("part").text(f"{folder}/graph")


def index_rows(pages: DataFrame) -> DataFrame:
    """``url, item``: list items of an HTML index of pages, with title, address and status escaped."""

    @F.pandas_udf("string")
    def item(url, title, status):
        import pandas as pd

        return pd.Series([f'<li><a href="{escape(u or "")}">{escape(t or u or "")}</a> <span>{escape(s or "")}</span></li>' for u, t, s in zip(url, title, status)])

    return pages.select("url", item("url", "title", "status").alias("item"))


def write_index(folder: str, pages: DataFrame, title: str = "Crawl") -> None:
    """An HTML index in parts: each file is a list of its own, so all executors write at once."""
    rows = index_rows(pages).select("item")

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [f"<!doctype html><title>{escape(title)}</title><ul>"]})
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": b.column(0).cast(pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["</ul>"]})

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(f"{folder}/index")


def to_har(entries: DataFrame, by: list[str]) -> DataFrame:
    """``by, log``: a HAR log per group of ``started, method, url, status, content_type, size, millis`` rows, in order of time."""
    e = F.struct(
        F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedDateTime"), F.col("millis").alias("time"), F.struct("method", "url").alias("request"),
        F.struct("status", F.struct(F.col("content_type").alias("mimeType"), "size").alias("content")).alias("response"),
    )
    log = F.struct(F.struct(F.lit("1.2").alias("version"), F.transform(F.array_sort(F.collect_list(F.struct("started", "url", e.alias("e")))), lambda x: x["e"]).alias("entries")).alias("log"))
    return entries.groupBy(*by).agg(F.to_json(log).alias("log"))
