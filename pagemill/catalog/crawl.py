"""Relational queries over a crawl's tables, each with the SQL it must agree with."""

from pyspark.sql import functions as F

from pagemill.functions import columns as C
from pagemill.functions.urls import TRACKING
from pagemill.operators import audit, corpus
from pagemill.session import load
from pagemill.streaming.pages import status_counts

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


_TRACKED = "|".join(t.replace("*", ".*") for t in TRACKING)


def _urls(spark, d):
    return load(spark, d, "crawl_pages").select("url").where("url is not null").distinct()


# ---- summaries


@query("SELECT host, count(*) AS pages, count(DISTINCT url) AS urls FROM crawl_pages GROUP BY host")
def host_histogram(spark, d):
    return load(spark, d, "crawl_pages").groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM crawl_pages WHERE {c} IS NOT NULL GROUP BY 2" for c in corpus.HISTOGRAMS))
def summary_histograms(spark, d):
    return corpus.summary_histograms(load(spark, d, "crawl_pages"))


@query("""
SELECT run_id, count(*) AS pages, count(*) FILTER (status = 'Success') AS succeeded, count(*) FILTER (status = 'Failed') AS failed,
  count(*) FILTER (status = 'Skipped') AS skipped, count(*) FILTER (rendered) AS rendered, count(DISTINCT url) AS urls, max(depth) AS max_depth,
  CAST(sum(epoch_us(finished) - epoch_us(started)) AS BIGINT) AS total_micros
FROM crawl_pages GROUP BY run_id""")
def crawl_summary(spark, d):
    return corpus.crawl_summary(load(spark, d, "crawl_pages"), ["run_id"])


@query("SELECT host, status, grouping(host, status) AS level, count(*) AS n FROM crawl_pages GROUP BY GROUPING SETS ((host, status), (host), (status), ())")
def summary_levels(spark, d):
    return load(spark, d, "crawl_pages").cube("host", "status").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("""
SELECT date_trunc('hour', stored_at) AS "start", status, count(*) AS pages FROM crawl_pages WHERE stored_at IS NOT NULL GROUP BY 1, 2""")
def hourly_status(spark, d):
    return status_counts(load(spark, d, "crawl_pages"))


@query("SELECT page_id, url, content_selection_score, started FROM crawl_pages WHERE content_selection_score IS NOT NULL ORDER BY content_selection_score DESC, page_id, stored_at LIMIT 100")
def top_pages(spark, d):
    p = load(spark, d, "crawl_pages").where("content_selection_score is not null")
    return corpus.top_pages(p, [F.desc("content_selection_score"), "page_id", "stored_at"], 100).select("page_id", "url", "content_selection_score", "started")


# ---- addresses


@query(rf"""
WITH u AS (SELECT DISTINCT url FROM crawl_pages WHERE url IS NOT NULL),
p AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) AS auth,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM u),
n AS (SELECT url, scheme, CASE scheme WHEN 'http' THEN regexp_replace(auth, ':(80)?$', '') WHEN 'https' THEN regexp_replace(auth, ':(443)?$', '') ELSE auth END AS auth,
  CASE WHEN path = '' THEN '/' ELSE path END AS path,
  array_to_string(list_sort(list_filter(list_transform(string_split(q, '&'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_full_match(string_split(x, '=')[1], '(?i){_TRACKED}'))), '&') AS q FROM p)
SELECT url, CASE WHEN scheme = '' OR auth = '' THEN url WHEN q = '' THEN regexp_replace(scheme || '://' || auth || path, '/+$', '') ELSE scheme || '://' || auth || path || '?' || q END AS normal FROM n""")
def url_normalize(spark, d):
    return _urls(spark, d).select("url", C.url_normalize(F.col("url")).alias("normal"))


@query(r"""
SELECT DISTINCT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')) AS host_name,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
FROM crawl_pages WHERE url IS NOT NULL""")
def url_parts(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", C.url_scheme(u).alias("scheme"), C.url_host(u).alias("host_name"), C.url_path(u).alias("path"), C.url_query(u).alias("query"))


@query("SELECT DISTINCT url, regexp_replace(url, '#.*$', '') AS crawl_key FROM crawl_pages WHERE url IS NOT NULL")
def url_crawl_key(spark, d):
    return _urls(spark, d).select("url", C.url_crawl_key(F.col("url")).alias("crawl_key"))


@query(rf"""
WITH u AS (SELECT DISTINCT url, regexp_replace(url, '#.*$', '') AS k FROM crawl_pages WHERE url IS NOT NULL),
q AS (SELECT url, k, array_to_string(list_filter(string_split(regexp_extract(k, '\?(.*)$', 1), '&'), lambda x: NOT regexp_full_match(string_split(x, '=')[1], '(?i){_TRACKED}')), '&') AS q FROM u)
SELECT url, CASE WHEN instr(k, '?') = 0 THEN k WHEN q = '' THEN regexp_replace(k, '\?.*$', '') ELSE regexp_replace(k, '\?.*$', '') || '?' || q END AS crawl_key FROM q""")
def url_without_tracking(spark, d):
    return _urls(spark, d).select("url", C.url_crawl_key(F.col("url"), True).alias("crawl_key"))


@query(r"""
SELECT url, CASE WHEN NOT regexp_matches(url, '(?i)^https?://[^/]+') THEN 'InvalidUrl'
  WHEN NOT (h = 'docs.ystond.example' OR h LIKE '%.docs.ystond.example') THEN 'OutsideHost'
  WHEN regexp_full_match(url, '(?i).*\.pdf') THEN 'AssetPath' WHEN regexp_full_match(url, '(?i).*/posts/.*') THEN 'Excluded' END AS reason
FROM (SELECT DISTINCT url, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')) AS h FROM crawl_pages WHERE url IS NOT NULL)""")
def scope_reasons(spark, d):
    return _urls(spark, d).select("url", corpus.skip_reason("docs.ystond.example", assets=["*.pdf"], exclude=["*/posts/*"]).alias("reason"))


@query("""
SELECT DISTINCT page_id, url <> response_url AS moved, NOT (regexp_extract(url, '^[^:]+') = regexp_extract(response_url, '^[^:]+')
  AND regexp_extract(url, '://([^/?#]*)', 1) = regexp_extract(response_url, '://([^/?#]*)', 1)) AS other_origin
FROM crawl_pages WHERE url IS NOT NULL AND response_url IS NOT NULL""")
def redirected_pages(spark, d):
    p = load(spark, d, "crawl_pages").where("url is not null and response_url is not null")
    return p.select("page_id", (F.col("url") != F.col("response_url")).alias("moved"), (~C.same_origin(F.col("url"), F.col("response_url"))).alias("other_origin")).distinct()


# ---- graph


def _edges(spark, d):
    p = load(spark, d, "crawl_pages")
    links = p.select(F.col("parent_url").alias("source"), F.col("url").alias("target"))
    return corpus.link_edges(links, p.where("status = 'Success'").select("url"), p.where("status = 'Skipped'").select("url"))


_EDGES = """
WITH e AS (SELECT DISTINCT parent_url AS source, url AS target FROM crawl_pages WHERE parent_url IS NOT NULL AND url IS NOT NULL),
k AS (SELECT url, min(CASE status WHEN 'Success' THEN 0 ELSE 1 END) AS r FROM crawl_pages WHERE status IN ('Success', 'Skipped') GROUP BY url),
g AS (SELECT source, target, CASE r WHEN 0 THEN 'fetched' WHEN 1 THEN 'skipped' ELSE 'external' END AS relation FROM e LEFT JOIN k ON url = target)
"""


@query(_EDGES + "SELECT * FROM g")
def link_edges(spark, d):
    return _edges(spark, d)


@query(_EDGES + """
SELECT url, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(n) AS BIGINT) AS internal_out FROM (
  SELECT source AS url, 0 AS i, 1 AS o, CASE WHEN relation <> 'external' THEN 1 ELSE 0 END AS n FROM g UNION ALL SELECT target, 1, 0, 0 FROM g) GROUP BY url""")
def link_degrees(spark, d):
    return corpus.degrees(_edges(spark, d))


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT parent_url AS s, url AS t FROM crawl_pages WHERE parent_url IS NOT NULL AND url IS NOT NULL),
v(url, depth) AS (SELECT DISTINCT url, 0 FROM crawl_pages WHERE depth = 0 AND url IS NOT NULL UNION SELECT t, depth + 1 FROM v JOIN l ON s = url WHERE depth < 4)
SELECT url, min(depth) AS depth FROM v GROUP BY url""")
def crawl_frontier(spark, d):
    p = load(spark, d, "crawl_pages").where("url is not null")
    links = p.where("parent_url is not null").select(F.col("parent_url").alias("source"), F.col("url").alias("target")).distinct()
    return corpus.crawl_frontier(p.where("depth = 0").select("url"), links, 4).select("url", "depth")


@query("""
WITH r AS (SELECT url, entity_tag, last_modified, page_id, row_number() OVER (PARTITION BY url ORDER BY started DESC, page_id DESC) AS k
  FROM (SELECT url, page_id, min(started) AS started, min(entity_tag) AS entity_tag, min(last_modified) AS last_modified FROM crawl_pages WHERE status = 'Success' AND url IS NOT NULL GROUP BY url, page_id)),
a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM r WHERE k = 2)
SELECT a.url, CASE WHEN b.url IS NULL THEN 'new' WHEN a.entity_tag IS NOT NULL AND b.entity_tag IS NOT NULL THEN CASE WHEN a.entity_tag = b.entity_tag THEN 'unchanged' ELSE 'changed' END
  WHEN a.last_modified IS NOT NULL AND b.last_modified IS NOT NULL THEN CASE WHEN a.last_modified = b.last_modified THEN 'unchanged' ELSE 'changed' END ELSE 'unchanged' END AS state
FROM a LEFT JOIN b ON a.url = b.url""")
def refresh_states(spark, d):
    p = load(spark, d, "crawl_pages").where("status = 'Success' and url is not null")
    p = p.groupBy("url", "page_id").agg(F.min("started").alias("started"), F.min("entity_tag").alias("entity_tag"), F.min("last_modified").alias("last_modified"))
    t = corpus.last_two(p.withColumn("fingerprint", F.lit(None).cast("string")), "url", ["started", "page_id"])
    return corpus.refresh(t.select("url", "last.*"), t.where("previous is not null").select("url", "previous.*"))


# ---- assets


@query("""
SELECT source, content_type, count(*) AS assets, count(DISTINCT final_url) AS urls, CAST(sum(content_length) AS BIGINT) AS bytes
FROM (SELECT DISTINCT * FROM crawl_assets) GROUP BY source, content_type""")
def asset_summary(spark, d):
    a = load(spark, d, "crawl_assets").distinct()
    return a.groupBy("source", "content_type").agg(F.count("*").alias("assets"), F.countDistinct("final_url").alias("urls"), F.sum("content_length").alias("bytes"))


@query("""
SELECT p.host, count(*) AS assets, count(*) FILTER (a.error IS NOT NULL) AS failed FROM (SELECT DISTINCT asset_id, page_id, error FROM crawl_assets) a
JOIN (SELECT DISTINCT page_id, host FROM crawl_pages) p ON a.page_id = p.page_id GROUP BY p.host""")
def asset_hosts(spark, d):
    a = load(spark, d, "crawl_assets").select("asset_id", "page_id", "error").distinct()
    p = load(spark, d, "crawl_pages").select("page_id", "host").distinct()
    return a.join(p, "page_id").groupBy("host").agg(F.count("*").alias("assets"), F.count("error").alias("failed"))


@query("SELECT DISTINCT p.page_id FROM crawl_pages p WHERE p.status = 'Success' AND NOT EXISTS (SELECT 1 FROM crawl_assets a WHERE a.page_id = p.page_id)")
def pages_without_assets(spark, d):
    p = load(spark, d, "crawl_pages").where("status = 'Success'").select("page_id").distinct()
    return p.join(load(spark, d, "crawl_assets").select("page_id"), "page_id", "left_anti")


@query("SELECT r.run_id, r.run_status, r.applied_scenario, count(p.page_id) AS pages FROM crawl_runs r LEFT JOIN crawl_pages p ON p.run_id = r.run_id GROUP BY 1, 2, 3")
def run_pages(spark, d):
    n = load(spark, d, "crawl_pages").groupBy("run_id").agg(F.count("page_id").alias("pages"))
    return load(spark, d, "crawl_runs").join(n, "run_id", "left").select("run_id", "run_status", "applied_scenario", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("""
SELECT host, status, render_mode FROM crawl_pages WHERE run_id % 2 = 0 EXCEPT ALL SELECT host, status, render_mode FROM crawl_pages WHERE run_id % 2 = 1""")
def run_difference(spark, d):
    p = load(spark, d, "crawl_pages")
    cols = ["host", "status", "render_mode"]
    return p.where("run_id % 2 = 0").select(*cols).exceptAll(p.where("run_id % 2 = 1").select(*cols))


# ---- texts


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}''’-]*')) AS BIGINT) AS words_text,
CAST(len(regexp_extract_all(text, '\\p{L}[\\p{L}\\p{M}\\p{N}''-]*')) AS BIGINT) AS words_plan,
CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS BIGINT) AS words_split FROM documents WHERE text IS NOT NULL""")
def word_counts(spark, d):
    t = F.col("text")
    x = load(spark, d, "documents").where("text is not null")
    return x.select("doc_id", C.words_text(t).cast("bigint").alias("words_text"), C.words_plan(t).cast("bigint").alias("words_plan"), C.words_split(t).cast("bigint").alias("words_split"))


_SQUASH = "trim(regexp_replace(text, '[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"


@query(f"""
WITH w AS (SELECT doc_id, string_split(t, ' ') AS w FROM (SELECT doc_id, {_SQUASH} AS t FROM documents WHERE text IS NOT NULL) WHERE t <> ''),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 140 THEN [0] ELSE generate_series(0, len(w) - 31, 110) END) AS s FROM w)
SELECT doc_id, CAST(s // 110 AS BIGINT) AS chunk_index, CAST(len(w[s + 1 : s + 140]) AS BIGINT) AS words, md5(array_to_string(w[s + 1 : s + 140], ' ')) AS digest FROM s""")
def overlapping_chunks(spark, d):
    c = corpus.overlapping_chunks(load(spark, d, "documents"), "doc_id")
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("words").cast("bigint").alias("words"), F.md5("text").alias("digest"))


@query(f"""
WITH w AS (SELECT doc_id, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(t, ' ') END AS w FROM (SELECT doc_id, coalesce({_SQUASH}, '') AS t FROM documents)),
s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 350)) AS s FROM w)
SELECT doc_id, CAST(s // 350 AS BIGINT) AS chunk_index, CAST(len(w[s + 1 : s + 350]) AS BIGINT) AS words, md5(array_to_string(w[s + 1 : s + 350], ' ')) AS digest FROM s""")
def word_chunks(spark, d):
    c = corpus.word_chunks(load(spark, d, "documents"), "doc_id")
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("words").cast("bigint").alias("words"), F.md5("text").alias("digest"))


@query(f"""
WITH w AS (SELECT doc_id, string_split(t, ' ') AS w FROM (SELECT doc_id, {_SQUASH} AS t FROM documents WHERE text IS NOT NULL) WHERE t <> ''),
c AS (SELECT doc_id, array_to_string(w[s + 1 : s + 140], ' ') AS x FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 140 THEN [0] ELSE generate_series(0, len(w) - 31, 110) END) AS s FROM w))
SELECT upper(sha256(x)) AS fingerprint, count(*) AS copies FROM c GROUP BY 1""")
def chunk_duplicates(spark, d):
    c = corpus.distinct_chunks(corpus.overlapping_chunks(load(spark, d, "documents"), "doc_id"), "doc_id")
    return c.select("fingerprint", "copies")


#: The words that are no keywords, stated apart from the operator's own list.
_STOP = (
    "'a','an','and','are','as','at','be','been','but','by','for','from','had','has','have','he','her','him','his','i','if','in','into','is','it','its','me','more','most','my','no','not','of','on','or','our','ours','she',"
    "'so','some','than','that','the','their','them','then','there','these','they','this','those','to','too','up','us','was','we','were','what','when','where','which','who','will','with','you','your'"
)


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''_-]*')) AS w FROM documents),
n AS (SELECT doc_id, regexp_replace(lower(regexp_replace(w, '^[''_-]+|[''_-]+$', '', 'g')), '''s$', '') AS term FROM t),
c AS (SELECT doc_id, term, count(*) AS n FROM n WHERE len(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT doc_id, term, n, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM c) WHERE k <= 12""")
def keywords(spark, d):
    k = corpus.keywords(load(spark, d, "documents"), "doc_id")
    return k.select("doc_id", "term", "n", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT doc_id, translate(CASE WHEN len(text) <= 240 THEN text ELSE rtrim(left(text, 240), ' ') || '...' END, '#*`', '') AS summary FROM documents WHERE text IS NOT NULL""")
def text_summaries(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", C.strip_markdown(C.summary_dataset(F.col("text"))).alias("summary"))


@query(r"""
WITH f AS (SELECT doc_id, upper(sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '^[ \t\n\f\r\x0B]+', ''), '[ \t\n\f\r\x0B]+$', ''))) AS fingerprint FROM documents)
SELECT doc_id, fingerprint, min(doc_id) OVER (PARTITION BY fingerprint) AS "first", count(*) OVER (PARTITION BY fingerprint) AS copies FROM f""")
def duplicate_documents(spark, d):
    return corpus.duplicate_pages(load(spark, d, "documents"), "doc_id").select("doc_id", "fingerprint", "first", "copies")


# ---- markup, by expressions alone


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '[ \t\n\f\r\x0B]+', ' ', 'g'), '>[ ]+<', '><', 'g'))) AS digest FROM http_cache")
def collapsed_markup(spark, d):
    return load(spark, d, "http_cache").select("page_id", F.md5(C.collapse_markup(F.col("html"))).alias("digest"))


@query()
def response_classes(spark, d):
    p = load(spark, d, "crawl_pages").where("page_id is not null").groupBy("page_id").agg(F.max("status_code").alias("status_code"))
    j = load(spark, d, "http_cache").join(p, "page_id", "left")
    return j.select("page_id", audit.response_class(F.col("status_code"), F.col("html"), F.col("request_headers")).alias("response_class"), audit.offline_dependencies(F.col("html")).alias("dependencies"))
