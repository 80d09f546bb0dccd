"""Relational operators over a corpus of pages: duplicates, chunks, keywords, graph, frontier, summaries."""

from __future__ import annotations

from collections import Counter
from heapq import nsmallest

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.functions.columns import fingerprint, glob, host_in_scope, squash, summary_crawl, url_host, url_path
from pagemill.operators.hot import for_each_part, hot_keys, split_rows
from pagemill.session import materialise

CHUNK_WORDS, CHUNK_OVERLAP = 140, 30
_KEYWORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'_-]*")

#: Words that are no keywords.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her him his i if in into is it its me more most my no not of on or our ours she so some than that the their "
    "them then there these they this those to too up us was we were what when where which who will with you your"
).split()


# ---- duplicates


def duplicate_pages(pages: DataFrame, order: str, text: str = "text", html: str | None = None) -> DataFrame:
    """Pages with ``fingerprint``, the key of the first page with the same content, and whether they repeat it.

    First is least ``order``. The first page of a content is found by an aggregate, not a sort of
    the group, and its rows meet it in parts, so a content with a third of all pages is no single
    task's work. Null text counts as empty.
    """
    p = pages.withColumn("fingerprint", fingerprint(F.coalesce(F.col(text), F.lit("")), F.col(html) if html else None))
    # Written once: it is read for the join and for the large contents.
    first = materialise(p.groupBy("fingerprint").agg(F.min(order).alias("first"), F.count("*").alias("copies")))
    hot = hot_keys(first, "fingerprint", "copies")
    j = split_rows(p, hot, "fingerprint", order).join(for_each_part(first, hot, "fingerprint"), ["fingerprint", "_salt"]).drop("_salt")
    return j.withColumn("duplicate", F.col(order) != F.col("first"))


def static_rendered_difference(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rows added and removed between two versions of facts, counted with multiplicity."""
    return static.exceptAll(rendered).withColumn("change", F.lit("removed")).unionByName(rendered.exceptAll(static).withColumn("change", F.lit("added")))


# ---- chunks


def overlapping_chunks(docs: DataFrame, key: str, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``key, chunk_index, words, text`` frames of ``size`` words that step by ``size - overlap``; blank texts give none."""
    step = size - overlap
    d = docs.select(key, squash(F.col(text)).alias("t")).where("t <> ''").select(key, F.split("t", " ").alias("w"))
    n = F.size("w")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - overlap - 1, F.lit(step)))
    c = d.select(key, "w", F.posexplode(starts).alias("chunk_index", "s"))
    return c.select(key, "chunk_index", F.slice("w", F.col("s") + 1, size).alias("w")).select(key, "chunk_index", F.size("w").alias("words"), F.array_join("w", " ").alias("text"))


def word_chunks(docs: DataFrame, key: str, text: str = "text", size: int = 350) -> DataFrame:
    """Frames of ``size`` words (50 at least) without overlap; an empty text still gives one empty chunk."""
    size = max(50, size)
    d = docs.select(key, squash(F.coalesce(F.col(text), F.lit(""))).alias("t")).select(key, F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", " ")).alias("w"))
    c = d.select(key, "w", F.posexplode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(size))).alias("chunk_index", "s"))
    return c.select(key, "chunk_index", F.slice("w", F.col("s") + 1, size).alias("w")).select(key, "chunk_index", F.size("w").alias("words"), F.array_join("w", " ").alias("text"))


def distinct_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks with ``fingerprint`` and ``chunk_id``: the first of equal ones by (key, index) is kept and names them."""
    c = chunks.withColumn("fingerprint", fingerprint(F.col("text")))
    first = c.groupBy("fingerprint").agg(F.min(F.struct(key, "chunk_index")).alias("f"), F.count("*").alias("copies"))
    # Only the first chunk of a fingerprint can meet it: the join is on its place as well, so no fingerprint is one task's work.
    first = first.select(F.col("fingerprint").alias("_f"), F.col(f"f.{key}").alias("_k"), F.col("f.chunk_index").alias("_i"), "copies")
    kept = c.join(first, (F.col("fingerprint") == F.col("_f")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col("chunk_index") == F.col("_i"))).drop("_f", "_k", "_i")
    return kept.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.left("fingerprint", F.lit(16)))).withColumn("summary", summary_crawl(F.col("text")))


def keywords(docs: DataFrame, key: str, text: str = "text", top: int = 12, stop: list[str] | None = None) -> DataFrame:
    """``key, term, n, rank``: the ``top`` most frequent words of each text: three letters or more, no stop words; ties by the word itself.

    All words of a text are in its row, so they are counted there, batch by batch; nothing is shuffled.
    Null and empty texts have none; repeated keys are separate texts.
    """
    drop = frozenset(STOP_WORDS if stop is None else stop)
    kind = docs.schema[key].dataType.simpleString()

    def fn(b, terms):
        out: dict = {"key": [], "term": [], "n": [], "rank": []}
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen: Counter = Counter()
            for w, n in Counter(_KEYWORD.findall(t or "")).items():
                term = terms.get(w)
                if term is None:
                    if len(terms) > 200_000:
                        terms.clear()
                    term = w.strip("'_-").lower()
                    term = terms[w] = term[:-2] if term.endswith("'s") else term
                if len(term) >= 3 and term not in drop:
                    seen[term] += n
            for i, (term, n) in enumerate(nsmallest(top, seen.items(), key=lambda x: (-x[1], x[0]))):
                out["key"].append(k)
                out["term"].append(term)
                out["n"].append(n)
                out["rank"].append(i + 1)
        return out

    return map_arrow(docs.select(F.col(key).alias("key"), text), fn, f"key {kind}, term string, n bigint, rank int", dict).withColumnRenamed("key", key)


# ---- graph


def link_edges(links: DataFrame, fetched: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Distinct ``source, target, relation``: a target is fetched, skipped or external, in that order.

    ``links`` holds source and target; ``fetched`` and ``skipped`` hold url.
    """
    e = links.select("source", "target").where("source is not null and target is not null").distinct()
    known = fetched.select(F.col("url").alias("target"), F.lit(0).alias("r"))
    if skipped is not None:
        known = known.unionByName(skipped.select(F.col("url").alias("target"), F.lit(1).alias("r")))
    known = known.groupBy("target").agg(F.min("r").alias("r"))
    return e.join(known, "target", "left").select("source", "target", F.when(F.col("r") == 0, "fetched").when(F.col("r") == 1, "skipped").otherwise("external").alias("relation"))


def degrees(edges: DataFrame) -> DataFrame:
    """``url, in_degree, out_degree, internal_out`` of every url of the graph, partial counts before the shuffle."""
    both = edges.select(F.col("source").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o"), (F.col("relation") != "external").cast("int").alias("n")).unionByName(
        edges.select(F.col("target").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("n"))
    )
    return both.groupBy("url").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("n").alias("internal_out"))


# ---- scope and frontier


def skip_reason(start_host: str, *, subdomains: bool = True, path_prefix: str = "", include: list[str] = (), exclude: list[str] = (), assets: list[str] = (), url: str = "url"):
    """Why a candidate is left out, in a fixed order of checks; null where it is not."""
    u = F.col(url)
    r = F.when(~u.rlike("(?i)^https?://[^/]+"), "InvalidUrl").when(~host_in_scope(url_host(u), F.lit(start_host), subdomains), "OutsideHost")
    if path_prefix:
        r = r.when(~F.startswith(url_path(u), F.lit(path_prefix)), "OutsidePath")
    if assets:
        r = r.when(glob(u, list(assets)), "AssetPath")
    if include:
        r = r.when(~glob(u, list(include)), "NotIncluded")
    if exclude:
        r = r.when(glob(u, list(exclude)), "Excluded")
    return r


def robots_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each distinct url with ``allowed``: the longest matching rule of its host decides, an allowing one among equals.

    ``rules`` holds host, allow, pattern of the groups that apply. Rules are joined to urls by
    host and matched as patterns, never all with all.
    """
    rx = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"[.+?^{}()|\[\]\\]", r"\\$0"), r"\*", ".*"), r"\$(?!$)", r"\\\$"))
    r = rules.where("pattern is not null and pattern <> ''").select(F.lower("host").alias("h"), "allow", rx.alias("rx"), F.length(F.regexp_replace("pattern", r"\*", "")).alias("len")).distinct()
    u = urls.select("url").where("url is not null").distinct().select("url", url_host(F.col("url")).alias("h"), F.regexp_replace(F.regexp_replace("url", "^[^:]+://[^/?#]*", ""), "#.*$", "").alias("p"))
    hit = u.join(r, "h").where(F.expr("regexp_like(p, rx)")).groupBy("url").agg(F.max(F.struct("len", "allow")).alias("m"))
    return u.join(hit, "url", "left").select("url", F.coalesce("m.allow", F.lit(True)).alias("allowed"))


def crawl_frontier(start: DataFrame, links: DataFrame, max_depth: int, reason=None) -> DataFrame:
    """Breadth-first visit of known links: ``url, parent_url, depth, skip_reason``; each url once, at its least depth.

    ``start`` holds url, ``links`` source and target. Each level is one join and one anti join; levels
    are written out, so lineage does not grow with depth and a lost executor repeats one level.
    """
    seen = materialise(start.select("url").where("url is not null").distinct().select("url", F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("depth")))
    reason = F.lit(None).cast("string") if reason is None else reason
    seen = seen.withColumn("skip_reason", reason)
    level = seen
    for depth in range(1, max_depth + 1):
        step = level.where("skip_reason is null").select(F.col("url").alias("source")).join(links.select("source", "target"), "source")
        step = step.where("target is not null").groupBy(F.col("target").alias("url")).agg(F.min("source").alias("parent_url"))
        level = materialise(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).withColumn("skip_reason", reason))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


# ---- refresh and summaries


def last_two(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, last, previous``: the last row of each key by ``order`` and the one before it, as structs; previous is null for a single row.

    Two aggregates instead of a sort per key; a key with very many rows meets its last one in parts.
    Rows of equal order count as one.
    """
    row = F.struct(*order, *[c for c in rows.columns if c != key and c not in order])
    last = rows.groupBy(key).agg(F.max(row).alias("last"), F.count("*").alias("n"))
    hot = hot_keys(last, key)
    at = for_each_part(last.select(key, F.struct(*[F.col(f"last.{c}").alias(c) for c in order]).alias("_at")), hot, key)
    before = split_rows(rows, hot, key, order[-1]).join(at, [key, "_salt"]).where(F.struct(*order) < F.col("_at")).groupBy(key).agg(F.max(row).alias("previous"))
    return last.select(key, "last").join(before, key, "left")


def refresh(new: DataFrame, old: DataFrame) -> DataFrame:
    """``url, state`` of the pages of a new crawl against an old one: new, unchanged, changed; and gone.

    Both hold url, entity_tag, last_modified, fingerprint. Equal tags or, without tags, equal dates
    or, without either, equal content mean unchanged.
    """
    a, b = new.alias("a"), old.alias("b")
    j = a.join(b, F.col("a.url") == F.col("b.url"), "full")
    tag = F.col("a.entity_tag").isNotNull() & F.col("b.entity_tag").isNotNull()
    date = F.col("a.last_modified").isNotNull() & F.col("b.last_modified").isNotNull()
    same = F.when(tag, F.col("a.entity_tag") == F.col("b.entity_tag")).when(date, F.col("a.last_modified") == F.col("b.last_modified")).otherwise(F.col("a.fingerprint").eqNullSafe(F.col("b.fingerprint")))
    state = F.when(F.col("b.url").isNull(), "new").when(F.col("a.url").isNull(), "gone").when(same, "unchanged").otherwise("changed")
    return j.select(F.coalesce("a.url", "b.url").alias("url"), state.alias("state"))


HISTOGRAMS = ("status", "skip_reason", "status_code", "content_mode_used", "content_selection_reason_code", "render_mode")


def summary_histograms(pages: DataFrame, columns=HISTOGRAMS) -> DataFrame:
    """``facet, value, n`` of every facet in one pass: rows are unpivoted and counted, partially before the shuffle."""
    p = pages.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return p.where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def crawl_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    """Counts, depth and duration of a crawl per group."""
    ok = F.col("status") == "Success"
    secs = F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return pages.groupBy(*by).agg(
        F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.count_if(F.col("status") == "Failed").alias("failed"), F.count_if(F.col("status") == "Skipped").alias("skipped"),
        F.count_if(F.col("rendered")).alias("rendered"), F.countDistinct("url").alias("urls"), F.max("depth").alias("max_depth"), F.sum(secs).alias("total_micros"),
    )


def top_pages(pages: DataFrame, by: list, limit: int) -> DataFrame:
    """The first ``limit`` rows in the given order: a top-k, never a whole sort."""
    return pages.orderBy(*by).limit(limit)


# ---- graph and crawl reports


def graph_histograms(edges: DataFrame) -> DataFrame:
    """``facet, value, n``: edges by relation, by source host and by target host; ``rank`` orders the values of a facet by count, then by value."""
    facets = (("relation", F.col("relation")), ("source_host", url_host(F.col("source"))), ("target_host", url_host(F.col("target"))))
    e = edges.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), c.alias("value")) for k, c in facets])).alias("x"))
    return e.where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def response_budget(pages: DataFrame, size: str, order: str, by: str, budget: int) -> DataFrame:
    """Pages with ``used``, the bytes of their group up to and including them in the given order, and whether they fit the budget.

    Null sizes count as 0. Sums are taken over days first and then inside a day, so a large group is many tasks.
    """
    day = F.date_trunc("day", order)
    p = pages.withColumn("_s", F.coalesce(F.col(size), F.lit(0))).withColumn("_d", day)
    days = p.groupBy(by, "_d").agg(F.sum("_s").alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_d")) - F.col("_n")).drop("_n")
    inner = F.sum("_s").over(Window.partitionBy(by, "_d").orderBy(order, *[c for c in ("page_id", "asset_id") if c in pages.columns]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = p.withColumn("_in", inner).join(days.withColumnRenamed(by, "_k").withColumnRenamed("_d", "_e"), F.col(by).eqNullSafe(F.col("_k")) & F.col("_d").eqNullSafe(F.col("_e")))
    return j.withColumn("used", F.col("_in") + F.col("_before")).withColumn("fits", F.col("used") <= budget).drop("_s", "_d", "_in", "_before", "_k", "_e")


def http_metrics(entries: DataFrame, by: list[str]) -> DataFrame:
    """Requests, failures, bytes and times of request logs per group."""
    failed = F.coalesce(F.col("status") >= 400, F.lit(True))
    return entries.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failed"), F.sum("size").alias("bytes"), F.round(F.avg("millis"), 3).alias("mean_millis"), F.max("millis").alias("max_millis"),
    )


def paced(requests: DataFrame, delay: float, by: str = "host", order: str = "url") -> DataFrame:
    """Requests with ``at``, the seconds after the start at which each may be sent: one per ``delay`` in a group, in order.

    Ranks are taken in salted parts with prefix counts, so a host with most of all requests is many tasks.
    """
    parts = 64
    r = requests.withColumn("_p", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
    ahead = r.groupBy(by, "_p").agg(F.count("*").alias("_n"))
    ahead = ahead.withColumn("_ahead", F.sum("_n").over(Window.partitionBy(by).orderBy("_p")) - F.col("_n")).drop("_n")
    ranked = r.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_p").orderBy(order)) - 1)
    j = ranked.join(ahead.withColumnRenamed(by, "_k").withColumnRenamed("_p", "_q"), F.col(by).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    return j.withColumn("at", (F.col("_r") + F.col("_ahead")) * F.lit(float(delay))).drop("_p", "_r", "_k", "_q", "_ahead")


def local_places(assets: DataFrame, url: str = "url") -> DataFrame:
    """``url, place``: a file name for each distinct asset, under a folder per host; names are told apart by the address's hash."""
    u = F.col(url)
    name = F.regexp_replace(F.regexp_extract(url_path(u), r"([^/]*)$", 1), r"[^A-Za-z0-9._-]+", "-")
    stem, ext = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,8}$", ""), F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})$", 1)
    place = F.concat(F.lit("assets/"), url_host(u), F.lit("/"), F.when(stem == "", "index").otherwise(F.left(stem, F.lit(48))), F.lit("-"), F.left(F.sha2(u, 256), F.lit(12)), ext)
    return assets.where(u.isNotNull()).select(u.alias("url"), place.alias("place")).distinct()
