"""Lines repeated across one site's documents (problem 5).

Lines are parsed into templates by a token tree of fixed depth: the path of a line is its
token count followed by its first tokens, where a token with digits is a wildcard. The path
depends on the line alone, so trees built in different partitions merge by adding the
counts of equal paths. A leaf's page count bounds the url count of every line under it, so
leaves below the host's threshold are dropped without losing a line; the lines of the
remaining leaves are then counted exactly.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.functions.blocks import body_markup, crc, split_blocks
from pagemill.llm.memo import Memo
from pagemill.operators.hot import for_each_part, hot_keys, split_rows
from pagemill.session import materialise

DEPTH = 3
MIN_URLS = 4
MIN_SHARE = 0.2

_DIGITS = re.compile("[0-9]+")


def normal_line(block: str) -> str:
    """Lower-cased, each run of digits as '#'."""
    return _DIGITS.sub("#", block.lower())


def template_path(line: str, depth: int = DEPTH) -> tuple:
    """Path of a normalised line in the token tree: token count, then ``depth`` tokens or '<*>'."""
    tokens = line.split(" ")
    return (len(tokens), *("<*>" if "#" in t else t for t in tokens[:depth]))


def merge_template(a: list[str] | None, b: list[str]) -> list[str]:
    """Template of a leaf: tokens on which all its lines agree, '<*>' elsewhere. Associative and commutative."""
    return list(b) if a is None else [x if x == y else "<*>" for x, y in zip(a, b)]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _describe(block: str) -> tuple[int, int, int]:
    line = normal_line(block)
    path = "\x1f".join(map(str, template_path(line)))
    return crc(block), _signed(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))), _signed(xxhash.xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")))


def page_lines(cache: DataFrame, texts: bool = False) -> DataFrame:
    """``page_id, lines``: per page its distinct blocks as (crc, line, leaf) hashes; null and empty html give none.

    With ``texts`` also ``blocks``, the blocks themselves in their order.
    """

    def fn(b, memo):
        out: dict = {"page_id": b.column(0).to_pylist(), "lines": [], "blocks": []}
        for html in b.column(1).to_pylist():
            blocks = split_blocks(body_markup(html)) if html else []
            out["lines"].append([{"crc": c, "line": n, "leaf": p} for c, n, p in (memo[x] for x in dict.fromkeys(blocks))])
            out["blocks"].append(blocks)
        return out

    schema = "page_id bigint, lines array<struct<crc:bigint,line:bigint,leaf:bigint>>" + (", blocks array<string>" if texts else "")
    return map_arrow(cache.select("page_id", "html"), fn, schema, lambda: Memo(_describe))


def page_hosts(pages: DataFrame) -> DataFrame:
    """One row per ``page_id`` with ``host`` and ``url``; repeated deliveries collapse. Pages without host or url are left out."""
    p = pages.where("page_id is not null and host is not null and url is not null")
    return p.groupBy("page_id").agg(F.min(F.struct("host", "url")).alias("p")).select("page_id", "p.host", "p.url")


def hot_hosts(pages: DataFrame) -> DataFrame:
    """Hosts with so many pages that their rows are split."""
    return hot_keys(pages.groupBy("host").agg(F.count("*").alias("n")), "host")


def site_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, host, url_hash, lines`` of each cached page whose host and url are known."""
    return lines.select("page_id", "lines").join(page_hosts(pages), "page_id").select("page_id", "host", F.xxhash64("url").alias("url_hash"), "lines")


def thresholds(site: DataFrame, min_urls: int, min_share: float) -> DataFrame:
    """``host, need``: addresses a line must stand on."""
    n = site.select("host", "url_hash").distinct().groupBy("host").agg(F.count("*").alias("n"))
    return n.select("host", F.greatest(F.lit(min_urls), F.ceil(F.col("n") * min_share - 1e-9)).alias("need"))


def repeated_lines(site: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, line, urls``: lines in the bodies of at least ``min_urls`` urls and ``min_share`` of the host's urls."""
    hot = hot_hosts(site)
    leaves = (
        site.select("host", F.explode(F.array_distinct("lines.leaf")).alias("leaf")).groupBy("host", "leaf").agg(F.count("*").alias("pages"))
        .join(thresholds(site, min_urls, min_share), "host").where("pages >= need").select("host", "leaf", "need")
    )
    lines = site.select("host", "url_hash", F.explode("lines").alias("l")).select("host", "url_hash", "l.line", "l.leaf")
    per_url = split_rows(lines, hot, "host", "url_hash").join(for_each_part(leaves, hot, "host"), ["host", "leaf", "_salt"]).select("host", "need", "line", "url_hash").distinct()
    return per_url.groupBy("host", "need", "line").agg(F.count("*").alias("urls")).where("urls >= need").select("host", "line", "urls")


def repeated_blocks(site: DataFrame, repeated: DataFrame) -> DataFrame:
    """``page_id, block_crc`` of all blocks that are a repeated line of their page's host.

    At most ``1 / min_share`` times the mean line count of a page can repeat in a host, so its
    lines are one bounded array; it is joined to the pages, of which large hosts are split.
    """
    hot = hot_hosts(site)
    per_host = for_each_part(repeated.groupBy("host").agg(F.collect_set("line").alias("known")), hot, "host")
    hit = split_rows(site, hot, "host", "page_id").join(per_host, ["host", "_salt"]).select("page_id", F.array_distinct(F.expr("filter(lines, x -> array_contains(known, x.line)).crc")).alias("c"))
    return hit.select("page_id", F.explode("c").alias("block_crc"))


def templates(cache: DataFrame, pages: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, template, lines, urls``: the templates that cover many of a host's addresses.

    The lines of a leaf of the token tree are merged token by token: what all of them hold stays,
    the rest is a slot '<*>'. Trees of different partitions merge by the least and greatest token
    of each place, which is associative. Only leaves on at least ``min_urls`` addresses and
    ``min_share`` of the host's come out; null and empty html give nothing.
    """

    def fn(b, memo):
        lines = [[{"leaf": memo[x][2], "line": normal_line(x)} for x in dict.fromkeys(split_blocks(body_markup(h)))] if h else [] for h in b.column(1).to_pylist()]
        return {"page_id": b.column(0).to_pylist(), "lines": lines}

    text = map_arrow(cache.select("page_id", "html"), fn, "page_id bigint, lines array<struct<leaf:bigint,line:string>>", lambda: Memo(_describe))
    site = materialise(text.join(page_hosts(pages), "page_id").select("page_id", "host", F.xxhash64("url").alias("url_hash"), "lines"))
    hot = hot_hosts(site)
    leaves = site.select("host", "url_hash", F.explode(F.array_distinct("lines.leaf")).alias("leaf")).distinct().groupBy("host", "leaf").agg(F.count("*").alias("urls"))
    leaves = leaves.join(thresholds(site, min_urls, min_share), "host").where("urls >= need").select("host", "leaf", "urls")
    lines = split_rows(site.select("host", "url_hash", F.explode("lines").alias("l")).select("host", "url_hash", "l.leaf", "l.line"), hot, "host", "url_hash")
    lines = lines.join(for_each_part(leaves, hot, "host"), ["host", "leaf", "_salt"]).select("host", "leaf", "urls", "line").distinct()
    place = lines.select("host", "leaf", "urls", F.posexplode(F.split("line", " ")).alias("at", "token")).groupBy("host", "leaf", "urls", "at")
    place = place.agg(F.count("*").alias("lines"), F.when(F.min("token") == F.max("token"), F.min("token")).otherwise("<*>").alias("token"))
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ")
    return place.groupBy("host", "leaf", "urls").agg(tokens.alias("template"), F.max("lines").alias("lines")).select("host", "template", "lines", "urls")


def found(cache: DataFrame, pages: DataFrame) -> DataFrame:
    site = materialise(site_lines(page_lines(cache), pages))
    return repeated_blocks(site, repeated_lines(site))


def without_repeated(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, host, text, removed``: each body's blocks, one per line, without its host's repeated lines.

    Pages are parsed once: their blocks are written beside the hashes, and only this text, never the
    markup, meets the lines to drop. Pages of unknown host keep all their blocks; rows of one
    ``page_id`` share its host.
    """
    parsed = materialise(page_lines(cache, True))
    site = materialise(site_lines(parsed, pages))
    drop = repeated_blocks(site, repeated_lines(site)).groupBy("page_id").agg(F.collect_set("block_crc").alias("drop"))
    hosts = site.groupBy("page_id").agg(F.min("host").alias("host")).join(drop, "page_id", "left")
    j = parsed.select("page_id", "blocks").join(hosts, "page_id", "left")
    kept = F.when(F.col("drop").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda x: ~F.array_contains("drop", F.crc32(x.cast("binary")))))
    return j.withColumn("kept", kept).select("page_id", "host", F.array_join("kept", "\n").alias("text"), (F.size("blocks") - F.size("kept")).alias("removed"))
