"""Queries over literal pages and texts, each with the rows that must come out typed as SQL values.

The pages hold what the test tables lack: forms, metadata, structured data, scripts, spans, cookies.
Nested results are shown flat: lists joined by '|', maps and records as JSON text.
"""

from pyspark.sql import functions as F

from pagemill.catalog.literal_rows import EXPECTED
from pagemill.functions import columns as C
from pagemill.operators import audit, content, corpus, extract, nested, schema, select, transform
from pagemill.plans.functions_sql import register
from pagemill.sources import sinks
from pagemill.sources import text_files as T

QUERIES: dict = {}
SQL: dict = {}

U = "https://shop.example/docs/page"
PAGES = {
    "outline": "<h1>One</h1><p>text</p><h2 id=a>One A</h2><h3>Deep</h3><h2>One B</h2><h1>Two</h1><h2>Two A</h2>",
    "lists": "<ul><li>first<li>second<ul><li>inner</ul></ul><ol><li> One <b>bold</b></li><li></li><li>Two</li></ol>",
    "forms": (
        "<form id=login action=/login method=post><input name=user value=ann><input type=password name=pass><input type=checkbox name=keep checked><input type=checkbox name=no><button>Go</button></form>"
        "<form action=find><select name=s><option value=1>One<option selected>Two</select><textarea name=t>text</textarea><fieldset disabled><input name=off value=x></fieldset></form><input form=login name=late value=z>"
        "<form method=post action=https://sso.example/acs><input type=hidden name=SAMLResponse value=abc></form><script>document.forms[2].submit()</script>"
    ),
    "head": (
        "<head><title>Head page</title><meta charset=utf-8><meta name=description content='A page'><meta property='og:title' content=' Title '><meta property='og:image' content=/i.png><meta property='og:image' content=/j.png>"
        "<meta property='og:empty'><meta http-equiv=refresh content=5><link rel=canonical href='/docs/page?b=2&a=1#x'><link rel=alternate type=application/rss+xml href=feed.xml><link rel=preload as=image imagesrcset='p.png 1x, q.png 2x'></head>"
    ),
    "items": (
        "<div itemscope itemtype=https://schema.org/Person itemid=#p><span itemprop=name>Ann Lee</span><a itemprop=url href=/ann>x</a><b itemprop='jobTitle'>Reader</b><i itemprop=age>30</i>"
        "<div itemprop=address itemscope><span itemprop=street>Road 1</span></div></div><div itemscope itemtype=https://schema.org/Product><meta itemprop=price content=5></div>"
    ),
    "ld": (
        '<script type="application/ld+json">{"@graph":[{"@type":"Article","name":"A","url":"https://shop.example/docs/page","datePublished":"2024-03-01"},{"@type":["Thing","Place"]}]}</script>'
        '<script type="application/ld+json">[{"@type":"Event","name":"E"}]</script><script type="application/ld+json">{"broken":</script><meta property="article:modified_time" content="2024-04-02">'
    ),
    "tables": (
        "<table id=a class='t u'><caption>Prices</caption><thead><tr><th colspan=2>Wide<tr><th>Item<th>Cost</thead><tfoot><tr><th>Sum<td>5</tfoot><tbody><tr><td rowspan=2>Pear<td>2<tr><td>3</tbody></table>"
        "<table><tr><td>1<td colspan=2>x<tr><td>2<td>true<td>2024-01-02</table><table><tr><th>Name<th>Name<th><tr><td>a<td>b<td>c</table><table></table>"
    ),
    "links": (
        "<base href=/root/><p>See <a href=a.html title=' the  A '>the A</a> and <a href='https://other.example/x#f'>other</a></p><a href=#top>top</a><a href='mailto:q@e.example'>mail</a><a href='a.html'>again</a>"
        "<map><area href=/area></map><a>none</a><a href='http://[bad'>bad</a>"
    ),
    "media": (
        "<img src=a.png srcset='a.png 1x, b.png 2x' alt=Alt><picture><source srcset='c.webp 400w, d.webp 800w'><img src=e.png></picture><video src=v.mp4 poster=p.png></video><script src=/s.js></script><link rel=stylesheet href=s.css>"
        "<link rel=next href=n><style>p{background:url('bg.png')}</style><noscript><img src=ns.png></noscript><iframe src=https://frame.example/></iframe>"
    ),
    "resources": "<!-- the library --><script src=../lib/one.js?v=1></script><!-- colours --><link rel=stylesheet href=css/two.css><p>x</p><style>a{}</style><script type=module>run()</script><script type=text/template>no</script>",
    "scripts": (
        "<script>var a = {x: 1, 'y': [true, null,], z: 'it\\'s'}; window.config = {env: 'prod', port: 8080}; app['user'].name = \"Ann\"; let n = 5; const s = JSON.parse('{\"k\":[1]}'); f = call(1);</script>"
        '<script id=__NEXT_DATA__ type=application/json>{"page":"/"}</script><script>window.__INITIAL_STATE__ = {on: !0, off: !1};</script><script type=importmap>{"imports":{}}</script><script type=application/json id=bad>{</script>'
    ),
    "tokens": (
        "<meta name=csrf-token content=m1><input type=hidden name=__RequestVerificationToken value=f1><input name=q value=1><div data-token=d1></div><script nonce=n1>const csrfToken = 's1'; cfg = {\"xsrf_token\": \"s2\"};</script>"
    ),
    "calls": (
        "<script>fetch('/api/v1/users'); fetch('/api/v1/users', {method: 'POST'}); axios.get('https://other.example/data.json'); $.post('/ajax/save', d); x.open('PUT', '/rest/item?token=1'); q = '/graphql'; fetch('/api/v1/users');</script>"
        "<form action=/login method=post name=signin></form>"
    ),
    "flight": "<script>self.__next_f.push([1,\"1:{\\\"a\\\":1}\\n2:T5,hello3:I[\\\"x\\\"]\\n\"])</script><script>self.__next_f.push([1,\"ff:\\\"end\\\"\"])</script>",
    "docs": (
        "<nav class=breadcrumb><a href=/>Home</a><a href=/docs>Docs</a><span>Here</span></nav><details><summary>Why?</summary>Because.</details><div class='note'><strong>Mind</strong> the gap</div>"
        "<pre><code class=language-json>{\"a\": 1}</code></pre><pre>$ curl https://e</pre><pre data-lang=http>GET /v1/items HTTP/1.1</pre><table><tr><th>Weight<td>5 kg<tr><th>Size<td>2 m</table>"
        "<h2>GET /v1/items/{id}</h2><p>Reads one item.</p><div itemscope itemtype=https://schema.org/Question><b itemprop=name>How?</b><div itemprop=text>So.</div></div><a class='btn primary' href=/buy>Buy now</a><button>Sign up</button><nav><a class=btn href=/x>Download</a></nav>"
    ),
    "layout": "<header>Top words here</header><nav><a href=a>A</a><a href=b>B</a></nav><main><article><h1>T</h1><p>one two three four</p></article></main><div role=complementary>side</div><footer>end</footer>",
    "text": "<html lang=en><head><title>Tale</title></head><body><p>One  <b>two</b>\nthree</p><ul><li>a<li>b</ul><pre>x\n  y</pre><script>no</script><p>1 &lt; 2<br>next</p></body></html>",
    "readable": (
        "<nav><a href=1>menu item one</a></nav><article id=story><h1>Story</h1><p>" + "good words " * 10 + "</p></article><div class=sidebar>" + "<a href=x>link text</a> " * 8 + "</div><div class=cookie-consent>we use cookies accept</div>"
    ),
    "shell": "<div id=root></div><script src=a.js></script><script src=b.js></script><script src=c.js></script>",
    "login": "<form><input type=password name=p></form>",
    "static": "<p>" + "plain words here " * 30 + "</p>",
    "audit": "<html><head></head><body><h1>A</h1><h3>B</h3><img src=i.png><button id=d></button><a id=d href='javascript:go()'></a><input id=u><label for=u></label><img src='data:image/png;base64,AA' alt=ok><a href=mailto:x@e>mail</a></body></html>",
    "sound": "<html lang=en><head><title>T</title></head><body><h1>A</h1><h2>B</h2><img src=i.png alt=''><button aria-label=Go></button><a href=/d>Docs</a><label for=q>Q</label><input id=q><input type=submit></body></html>",
    "compat": "<img src='a b.png'><label for=none></label><label for=box>Box</label><div id=box style=''></div><div id=box></div><input name=n><button></button><select title=ok></select><link rel=icon href=' '>",
    "cards": "".join(f"<div class=card><h3>{t}</h3><a href=/p/{i}>more</a><span>${i}</span></div>" for i, t in enumerate(("Ape", "Bee", "Cat"), 1)) + "<p>Plain <i>text</i></p><p class=x>Other text</p>",
    "styles": "<style>.card > p, p.x { color: red !important; --main: 1px } @media print { a { b: c } }</style><div class=card><p>a</p></div><p class=x>b</p>",
    "modes": (
        "<html><body><nav class=sidebar><a href=1>one link</a><a href=2>two link</a><a href=3>three link</a></nav><div id=wrap><article class='post wide'><h1>Head</h1><p>" + "alpha beta " * 15 + "</p><p hidden>secret</p></article></div>"
        "<div class=share>Share this</div></body></html>"
    ),
    "plain": "<div><p>few words only</p></div>",
    "main": "<main id=m><p>" + "word " * 30 + "</p></main><section><p>" + "more text " * 40 + "</p></section>",
}


def _type(t: str) -> str:
    return {"tinyint": "TINYINT", "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}[t]


def _sql_value(v, t: str) -> str:
    if v is None:
        return f"CAST(NULL AS {_type(t)})"
    if t == "string":
        return "'" + v.replace("'", "''") + "'"
    return f"CAST('{v}' AS {_type(t)})" if t.startswith("timestamp") else f"CAST({str(v).lower()} AS {_type(t)})"


def values_sql(columns: str, rows: list[tuple]) -> str:
    """The rows as an SQL query; columns as 'name type, name type'."""
    cols = [c.split(" ") for c in columns.split(", ")]
    names = ", ".join(f'"{n}"' for n, _ in cols)
    if not rows:
        return "SELECT " + ", ".join(f'CAST(NULL AS {_type(t)}) AS "{n}"' for n, t in cols) + " WHERE false"
    body = ", ".join("(" + ", ".join(_sql_value(v, t) for v, (_, t) in zip(r, cols)) + ")" for r in rows)
    return f"SELECT {names} FROM (VALUES {body}) AS v({names})"


def flat(df):
    """Lists of texts joined, other nested values as JSON text, instants as they read in UTC."""
    out = []
    for f in df.schema:
        t, c = f.dataType.simpleString(), F.col(f.name)
        if t == "array<string>":
            c = F.array_join(c, "|", "")
        elif t == "array<int>":
            c = F.array_join(c.cast("array<string>"), "|", "")
        elif t.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        elif t == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def literal(name: str):
    """Register a query of (spark) under ``lit_<name>``; its expected columns and rows stand in ``literal_rows``."""

    def keep(fn):
        QUERIES[f"lit_{name}"] = lambda spark, d: flat(fn(spark))
        if f"lit_{name}" in EXPECTED:
            SQL[f"lit_{name}"] = values_sql(*EXPECTED[f"lit_{name}"])
        return fn

    return keep


def page_table(spark, *names: str):
    return spark.createDataFrame([(i, PAGES[n], U) for i, n in enumerate(names, 1)], "page_id bigint, html string, url string")


def texts(spark, *values: str):
    return spark.createDataFrame([(i, v, U) for i, v in enumerate(values, 1)], "id bigint, content string, url string")


_KINDS = {
    "outline": ("outline",), "lists": ("lists",), "direct_lists": ("lists",), "tables": ("tables",), "table_heads": ("tables",), "reversed_tables": ("tables",), "forms": ("forms",), "meta": ("head",), "open_graph": ("head",), "microdata": ("items",),
    "microdata_unknown": ("items",), "head_links": ("head",), "canonical": ("head", "outline"), "links": ("links",), "crawl_links": ("links",), "images": ("media", "head"), "crawl_assets": ("media",),
    "resources": ("resources",), "scripts": ("resources",), "javascript": ("scripts",), "app_state": ("scripts",), "js_config": ("scripts",), "script_data": ("scripts",), "tokens": ("tokens",), "endpoints": ("calls",),
    "api_inventory": ("calls",), "flight_rows": ("flight",), "code_blocks": ("docs",), "breadcrumbs": ("docs",), "faq": ("docs",), "spec_tables": ("docs",), "callouts": ("docs",), "layout": ("layout",), "actions": ("docs",),
    "doc_endpoints": ("docs",), "statistics": ("docs", "links"), "text": ("text",), "readable": ("readable",), "publication_dates": ("ld", "head"), "facts": ("head", "links"), "surface": ("tokens", "calls", "forms"), "members": ("scripts", "calls"), "data_sources": ("scripts", "ld", "tables"), "plan": ("shell", "login", "static", "forms"),
}

for _kind, _names in _KINDS.items():
    literal(_kind)(lambda spark, k=_kind, n=_names: extract.extract(page_table(spark, *n), k))


@literal("json_ld")
def _json_ld(spark):
    return extract.extract(page_table(spark, "ld"), "json_ld").withColumn("error", F.col("error").isNotNull())


@literal("audit")
def _audit(spark):
    return audit.audit(page_table(spark, "audit", "sound"))


@literal("compatibility")
def _compatibility(spark):
    return audit.compatibility(page_table(spark, "compat", "sound"))


@literal("select_elements")
def _elements(spark):
    return select.elements(page_table(spark, "cards"), "div.card > a, p:not(.x)")


@literal("select_values")
def _values(spark):
    return select.values(page_table(spark, "cards"), ".card a::attr(href)", url="url")


@literal("select_own_text")
def _own_text(spark):
    return select.values(page_table(spark, "cards"), "p::text")


@literal("select_by_text")
def _by_text(spark):
    return select.by_text(page_table(spark, "cards"), "text", selector="p").drop("html")


@literal("select_similar")
def _similar(spark):
    return select.similar(page_table(spark, "cards"), ".card")


@literal("select_relocated")
def _relocated(spark):
    want = {"tag": "div", "attributes": {}, "classes": ["card"], "text_hash": "", "children": ["h3", "a", "span"], "path": [], "siblings": 3}
    return select.relocate(page_table(spark, "cards"), want, 3)


@literal("select_records")
def _records(spark):
    return select.records(page_table(spark, "cards"), ".card", {"title": "h3", "link": "a::attr(href)", "price": "span", "none": "em"}, url="url")


@literal("record_report")
def _report(spark):
    return select.record_report(_records(spark), ["title", "price", "none"], ["none"])


@literal("recipe")
def _recipe(spark):
    return select.run_recipe(page_table(spark, "cards"), select.save_recipe(".card", {"t": "h3"}))


@literal("recipe_drift")
def _drift(spark):
    r = _records(spark).drop("page_id")
    return select.drift(r, r.withColumn("price", F.when(F.col("item_ix") > 0, F.col("price"))))


@literal("collections")
def _collections(spark):
    return select.collections(page_table(spark, "cards"))


@literal("style_rules")
def _style_rules(spark):
    sheet = spark.createDataFrame([(1, "#a .b p:hover, i { color: red !important; --main: 1px } @media print { a[href] { b: url('x.png') } }"), (2, None)], "id bigint, css string")
    return select.style_rules(sheet, "id")


@literal("style_variables")
def _style_variables(spark):
    return select.style_variables(_style_rules(spark)).select("id", "selector", "property", "value")


@literal("style_usage")
def _style_usage(spark):
    return select.style_usage(page_table(spark, "styles"))


@literal("dom_nodes")
def _dom_nodes(spark):
    return select.dom_nodes(page_table(spark, "styles").where("page_id = 1"))


@literal("content_selection")
def _content(spark):
    p = page_table(spark, "modes", "plain", "main")
    return content.content_selection(p, "Focused").unionByName(content.content_selection(p, "Reader")).unionByName(content.content_selection(p, "Raw", "article")).unionByName(content.content_selection(p, "Focused", "#wrap"))


@literal("content_comparison")
def _comparison(spark):
    return content.content_comparison(page_table(spark, "modes", "plain", "main"))


@literal("content_winners")
def _winners(spark):
    return content.content_winners(page_table(spark, "modes", "plain", "main"))


@literal("page_reader")
def _reader(spark):
    return content.page_reader(page_table(spark, "modes", "tables"), url="url").drop("markdown", "text")


@literal("dataset_chunks")
def _chunks(spark):
    return content.dataset_chunks(page_table(spark, "forms", "static"), 50, url="url").drop("text", "markdown", "summary")


@literal("sensitive_parameters")
def _redacted(spark):
    """The column form hides whole words of names only; ``transform`` also sees changes of case and nested addresses."""
    t = texts(spark, "https://u:p@e.example/a?b=1&access_token=x#state=5&c=2", "/p?monkey=1&api_key=2", "https://e.example/plain")
    return t.select("id", C.redact_query(F.col("content")).alias("redacted"))


# ---- sources


@literal("robots_directives")
def _robots(spark):
    t = texts(spark, "# c\nUser-agent: *\nDisallow: /private # x\nAllow: /private/ok\n\nUser-Agent: Botty\nUser-agent: Other\nDisallow:\nCrawl-delay: 5\nSitemap: https://shop.example/s.xml\nnonsense")
    return T.robots(t, "id")


@literal("robots_rules")
def _rules(spark):
    d = _robots(spark)
    return T.robots_rules(d, "id", "AnyBot/1.0").withColumn("agent", F.lit("any")).unionByName(T.robots_rules(d, "id", "botty-crawler").withColumn("agent", F.lit("botty")))


@literal("robots_verdict")
def _verdict(spark):
    rules = spark.createDataFrame([("shop.example", False, "/private"), ("shop.example", True, "/private/ok"), ("shop.example", False, "/*.pdf$"), ("shop.example", False, "")], "host string, allow boolean, pattern string")
    urls = spark.createDataFrame([(f"https://shop.example{p}",) for p in ("/", "/private/x", "/private/ok/1", "/a.pdf", "/a.pdf?x")] + [("https://o.example/private",)], "url string")
    return corpus.robots_verdict(urls, rules)


_SITEMAP = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://shop.example/A</loc><lastmod>2024-03-01</lastmod></url><url><loc>/b</loc></url><url><loc>https://shop.example/a</loc></url></urlset>'


@literal("sitemaps")
def _sitemaps(spark):
    return T.sitemaps(texts(spark, _SITEMAP, '<sitemapindex><sitemap><loc>https://shop.example/s2.xml</loc><lastmod>2024-01-01T10:00:00+02:00</lastmod></sitemap></sitemapindex>', "<broken"), "id")


@literal("sitemap_urls")
def _sitemap_urls(spark):
    return T.sitemap_urls(_sitemaps(spark))


@literal("feeds")
def _feeds(spark):
    rss = "<rss><channel><title>News</title><item><title> A  b </title><link>/a</link><guid>g1</guid><description>d</description><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate><category>x</category><category>y</category></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>At</title><entry><title>T</title><link rel="self" href="/self"/><link href="/t"/><id>u1</id><summary>s</summary><published>2024-03-02T00:00:00Z</published><updated>2024-03-03T00:00:00Z</updated><author><name>Ann</name></author><category term="z"/></entry></feed>'
    return T.feeds(texts(spark, rss, atom, "no"), "id", url="url").withColumnRenamed("source_id", "file").withColumnRenamed("id", "guid")


@literal("manifests")
def _manifests(spark):
    return T.manifests(texts(spark, '{"name":"App","short_name":"A","start_url":"/","display":"standalone","icons":[{"src":"i.png","sizes":"48x48"}]}', "x"), "id")


@literal("well_known")
def _well_known(spark):
    return T.well_known(texts(spark, "Contact: mailto:a@e.example\n# c\nExpires: 2025-01-01\n", "/* TEAM */\nDev: Ann\nfree text"), "id")


@literal("ads_entries")
def _ads(spark):
    return T.ads_entries(texts(spark, "# ads\nAds.example, 12, direct, f0 # c\nother.example,9,RESELLER\nbad line"), "id")


@literal("har_entries")
def _har(spark):
    log = '{"log":{"entries":[{"startedDateTime":"2024-03-01T10:00:00Z","time":12.5,"request":{"method":"GET","url":"https://e.example/a"},"response":{"status":200,"content":{"mimeType":"application/json","size":10}}},{"request":{"method":"POST","url":"https://e.example/b"},"response":{"status":404,"content":{"mimeType":"text/html"}}}]}}'
    return T.har_entries(texts(spark, log), "id")


@literal("network_data_sources")
def _network(spark):
    return T.network_data_sources(_har(spark)).select("id", "entry_ix", "url", "content_type")


@literal("netscape_cookies")
def _netscape(spark):
    return T.netscape_cookies(texts(spark, "# Netscape HTTP Cookie File\n.e.example\tTRUE\t/\tTRUE\t1700000000\tsid\tabc\n#HttpOnly_e.example\tFALSE\t/a\tFALSE\t0\tk\tv w\nshort\tline"), "id")


@literal("netscape_export")
def _netscape_export(spark):
    return T.to_netscape(_netscape(spark))


@literal("set_cookies")
def _set_cookies(spark):
    t = texts(spark, "sid=a=b; Path=/x; Domain=e.example; Secure; HttpOnly; SameSite=Lax; Expires=Fri, 01-Mar-2024 00:00:00 GMT", "k=v", "=none", "flag; Path=/")
    return t.select("id", T.set_cookie(F.col("content")).alias("c")).select("id", "c.*")


@literal("browser_cookies")
def _browser(spark):
    return T.browser_cookies(texts(spark, '[{"name":"a","value":"1","domain":".e.example","path":"/","expirationDate":1700000000.5,"httpOnly":true,"secure":false,"sameSite":"lax"},{"value":"no name"}]', '{"name":"b","value":"2","expires":5}'), "id")


@literal("saml_responses")
def _saml(spark):
    import base64

    xml = '<samlp:Response xmlns:samlp="p" xmlns="a" Destination="https://sp.example/acs"><Issuer>idp</Issuer><samlp:Status><samlp:StatusCode Value="urn:status:Success"/></samlp:Status><Assertion><Subject><NameID>u</NameID></Subject><Conditions NotBefore="2024-01-01T00:00:00Z" NotOnOrAfter="2024-01-02T00:00:00Z"><AudienceRestriction><Audience>sp</Audience></AudienceRestriction></Conditions><AttributeStatement><Attribute Name="mail"/></AttributeStatement></Assertion></samlp:Response>'
    return T.saml_responses(texts(spark, base64.b64encode(xml.encode()).decode(), xml, "!!", "<other/>"), "id")


@literal("json_web_tokens")
def _jwt(spark):
    t = texts(spark, "Bearer eyJhbGciOiJIUzI1NiJ9.eyJpc3MiOiJpZHAiLCJzdWIiOiJ1MSIsImV4cCI6MTcwMDAwMDAwMCwiaWF0IjoxNjAwMDAwMDAwfQ.c2ln", "no.token", "a.b.c")
    return t.select("id", C.jwt(F.col("content")).alias("t")).select("id", "t.algorithm", "t.issuer", "t.subject", "t.expires", "t.issued", "t.not_before")


@literal("json_shapes")
def _shapes(spark):
    return T.json_shapes(texts(spark, '{"b":[1,"x",2],"a":{"c":null}}', "[]", "{"), "id", "content")


@literal("decoded_bytes")
def _decoded(spark):
    rows = [(1, "Größe".encode("utf-8"), None), (2, "Größe".encode("cp1252"), "iso-8859-1"), (3, b'<meta charset="windows-1251">' + "Сеть".encode("cp1251"), None), (4, b"\xff\xfe" + "é".encode("utf-16-le"), "utf-8"), (5, None, None), (6, b"x" * 5000 + b'<meta charset="koi8-r">' + "Сеть".encode("koi8-r"), None)]
    df = spark.createDataFrame(rows, "id bigint, data binary, charset string")
    return T.decode_column(df, "data", "charset", "id").select("id", F.right("html", F.lit(6)).alias("tail"))


@literal("web_dates")
def _dates(spark):
    t = texts(
        spark, "2024-03-01", "2024-03", "2024-03-01T10:20:30Z", "2024-03-01 10:20+02:00", "Fri, 01 Mar 2024 10:00:00 GMT", "1 Mar 24 10:00:00 +0100", "1 Mar 94 10:00 EST", "1 Mar 2024 10:30", "01-Mar-2024", "Mar-2024", "03/01/2024",
        "March 1, 2024", "1 March 2024", "March 2024", "soon", "",
    )
    return t.select("id", C.web_date(F.col("content")).alias("instant"))


@literal("page_names")
def _names(spark):
    t = texts(spark, "My First: Page!", "---", "a" * 60, "Über uns 2")
    return t.select("id", C.slug(F.col("content"), F.col("id")).alias("slug"), C.table_name(F.col("content")).alias("table_name"), C.text_hash(F.col("content")).alias("hash"))


@literal("summaries")
def _summaries(spark):
    t = texts(spark, "short  text", "word " * 60, "x" * 200)
    return t.select("id", C.summary_crawl(F.col("content")).alias("summary"), C.words_crawl(F.col("content")).alias("words"), C.strip_markdown(F.col("content")).alias("plain"))


@literal("csv_fields")
def _csv(spark):
    return texts(spark, "plain", 'say "hi"', "a,b", "two\r\nlines").select("id", sinks.csv_field(F.col("content")).alias("field"))


@literal("json_lines")
def _json_lines(spark):
    return sinks.json_lines(texts(spark, "a", 'b"'))


@literal("page_differences")
def _differences(spark):
    df = spark.createDataFrame([(1, "<p class=a>one</p><ul><li>x</ul>", "<p class=b>two</p><ul><li>x<li>y</ul>"), (2, "<p>same</p>", "<p>same</p>"), (3, None, "<b>new</b>")], "page_id bigint, old string, new string")
    d = transform.differences(df, "page_id", "old", "new")
    return d.withColumnRenamed("old", "before").withColumnRenamed("new", "after")


_TRANSFORMS = {
    "markdown": ("<h1>T</h1><p>a <b>b</b> <i>c</i> <a href=/x>l</a></p><ul><li>1<li>2</ul><pre><code class=language-py>x = 1</code></pre><table><tr><th>h<tr><td>v</table><blockquote>q</blockquote><img src=i.png alt=A>",),
    "text": ("<p>a<b>b</b></p><p>c</p><script>no</script>", ""), "lines": ("<p>a</p><div>b<br>c</div><pre>x\n  y</pre>",), "format_html": ("<div><p>a <b>b</b></p><ul><li>x</ul></div>",),
    "minify_html": ("<div>  <p> a </p>\n <!-- c --> <pre> k </pre></div>",), "format_css": ("a{b:c;d:e}@media print{i{f:g}}",), "minify_css": ("/* c */ a { b : c ; content: ' x ' }\n i > p { d: e; }",),
    "minify_js": ("// c\nvar a = 1 ; /* x */ function f ( b ) {\n  return b + ++a\n}\nlet r = /a b/g.test(`x ${ f(1) } y`)\nf(2)",), "format_js": ("function f(a){if(a){return [1,2];}else{x='{;}'}}var y=1;for(let i=0;i<2;i++){f(i)}",),
    "redact_url": ("https://u:p@e.example/a?b=1&access_token=x#state=5&c=2", "/p?next=https%3A%2F%2Fo.example%2F%3Ftoken%3D1", "/p?monkey=1&myToken=2)", "https://e.example/plain", ""),
    "redact_structured": ('var appToken = "x"; cfg = {"api_key": "1", "name": "n", state: "s"}; go("https://e.example/?code=1")', "plain"), "redact_links": ("see [a](/p?token=1) and ![b](i.png)",),
    "inline_css": ("<style>p{color:red} .k{color:blue}</style><p>a</p><p class=k style=margin:0>b</p>",), "entity_decode": ("a &lt; b &amp; c &eacute;",), "entity_encode": ("a < b & 'c'",),
}
for _name, _values in _TRANSFORMS.items():
    literal(f"transform_{_name}")(lambda spark, n=_name, v=_values: transform.transform(spark.createDataFrame([(i, x) for i, x in enumerate(v, 1)], "page_id bigint, html string"), n).toDF("page_id", "result"))


@literal("sql_functions")
def _sql_functions(spark):
    register(spark)
    page_table(spark, "cards").createOrReplaceTempView("literal_cards")
    return spark.sql("SELECT page_id, html_text(html) AS t, css_select(html, 'h3') AS heads, url_resolve('../x', url) AS u, url_normalize('HTTP://E.example:80/a/?utm_source=1#f') AS n FROM literal_cards")


@literal("xpath")
def _xpath(spark):
    p, out = page_table(spark, "cards", "tables"), None
    for e in ("//div[@class='card'][2]/a/@href", "//h3[text()='Cat']/following-sibling::span", "//p[not(@class)]/text() | //p[contains(., 'Other')]", "//div[last()]/h3", "//td[position() > 1 and . != 'x']", "//caption/parent::table/@id", "//div[count(a) = 1 and starts-with(h3, 'A')]/h3"):
        got = select.by_xpath(p, e).withColumn("expression", F.lit(e))
        out = got if out is None else out.unionByName(got)
    return out


@literal("selectors_for")
def _selectors_for(spark):
    return select.selectors_for(page_table(spark, "cards"), "text")


@literal("typed_fields")
def _typed(spark):
    r = spark.createDataFrame([(1, "1,234.50", "7", "TRUE", "1 March 2024", "x"), (2, "abc", "300", "yes", "", None), (3, None, " 12 ", None, None, "long")], "id bigint, price string, count string, on string, day string, letter string")
    return schema.convert_fields(r, {"price": "Double", "count": "SByte", "on": "Boolean", "day": "DateTime", "letter": "Char"}, {"count": -1}, ["letter"])


@literal("property_paths")
def _paths(spark):
    t = texts(spark, '{"a":{"b":[{"c":5},{"c":"x"}]},"d e":null}', "[1", '{"a":1}')
    c = F.col("content")
    return t.select("id", schema.property_path(c, "a.b[1].c").alias("deep"), schema.property_path(c, "a").alias("shallow"), schema.typed(c, "a struct<b:array<struct<c:string>>>").alias("typed"))


@literal("json_schemas")
def _json_schemas(spark):
    t = texts(spark, '{"a":1,"b":[{"c":"x"},{"c":null,"d":true}]}', '{"a":1.5,"b":[]}', "{", '{"a":null}').withColumn("kind", F.when(F.col("id") < 4, "k").otherwise("one"))
    return schema.json_schemas(t, ["kind"], "content")


@literal("openapi_documents")
def _openapi(spark):
    pages = spark.createDataFrame([(1, "<h2>GET /v1/items/{id}</h2><p>Reads one item.</p><h2>POST /v1/items</h2><p>Adds.</p>", U), (2, "<h3>GET /v1/items/{id}</h3><p>Reads one.</p><pre>DELETE /v1</pre>", U)], "page_id bigint, html string, url string")
    e = extract.extract(pages, "doc_endpoints").withColumn("host", F.lit("shop.example"))
    return schema.openapi_documents(e, "host", "Shop")


@literal("linked_endpoints")
def _linked(spark):
    refs = extract.extract(page_table(spark, "media", "resources"), "scripts").select("page_id", "src")
    return transform.linked_endpoints(refs, spark.createDataFrame([("https://shop.example/s.js", "fetch('/api/x')"), ("https://shop.example/other.js", "fetch('/api/y')"), ("https://shop.example/s.js", "fetch('/api/x')")], "url string, content string"))


@literal("embedded_images")
def _embedded(spark):
    p = spark.createDataFrame([(1, "<p><img src=a.png><img src=b.png></p>"), (2, None)], "page_id bigint, html string")
    a = spark.createDataFrame([(1, "a.png", "image/png", b"abc"), (1, "b.png", "image/png", b"x" * 300_000)], "page_id bigint, reference string, content_type string, data binary")
    return transform.embed_images(p, a)


def _graph(spark):
    links = spark.createDataFrame([("https://a.example/", "https://a.example/x"), ("https://a.example/", "https://b.example/"), ("https://a.example/x", "https://a.example/")], "source string, target string")
    return corpus.link_edges(links, spark.createDataFrame([("https://a.example/",), ("https://a.example/x",)], "url string"))


@literal("graph_histograms")
def _graph_histograms(spark):
    return corpus.graph_histograms(_graph(spark))


@literal("graph_export")
def _graph_export(spark):
    e = _graph(spark)
    return sinks.graph_rows(e, corpus.degrees(e))


@literal("html_index")
def _html_index(spark):
    return sinks.index_rows(spark.createDataFrame([("https://e.example/?a=1&b=2", "A <b>", "Success"), ("https://e.example/n", None, None)], "url string, title string, status string"))


@literal("har_export")
def _har_export(spark):
    return sinks.to_har(_har(spark).withColumn("started", F.try_to_timestamp("started")), ["id"])


@literal("http_metrics")
def _http_metrics(spark):
    return corpus.http_metrics(_har(spark), ["id"])


@literal("response_budget")
def _budget(spark):
    p = spark.createDataFrame([(i, "h" if i < 4 else "k", i * 10 if i != 2 else None, f"2024-03-0{1 + i // 3} 10:0{i}:00") for i in range(6)], "page_id bigint, host string, size int, at string").withColumn("at", F.to_timestamp("at"))
    return corpus.response_budget(p, "size", "at", "host", 35).select("page_id", "host", "used", "fits")


@literal("paced_requests")
def _paced(spark):
    got = corpus.paced(spark.createDataFrame([("h", f"u{i}") for i in range(5)] + [("k", "z")], "host string, url string"), 1.5)
    return got.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("at").alias("slots"), F.max("at").alias("last"))


@literal("local_places")
def _local_places(spark):
    return corpus.local_places(spark.createDataFrame([("https://E.example/a/b c.png?x=1",), ("https://e.example/",), (None,), ("https://e.example/",)], "url string"))


@literal("enum_values")
def _enums(spark):
    return texts(spark, " success", "FAILED", "other", "").select("id", C.enum_value(F.col("content"), ["Success", "Failed", "Skipped"], "Unknown").alias("value"))


@literal("sign_on_handoffs")
def _handoffs(spark):
    more = "<form method=post action='https://rp.example/cb?token=1'><input type=hidden name=code value=c1><input type=hidden name=state value=s></form><form action=/err><input name=error value=denied><input name=state></form><form><input name=q></form>"
    f = page_table(spark, "forms").unionByName(spark.createDataFrame([(2, more, U)], "page_id bigint, html string, url string"))
    return transform.sign_on_handoffs(extract.extract(f, "forms"))


@literal("table_values")
def _table_values(spark):
    p = page_table(spark, "tables")
    return transform.table_values(extract.extract(p, "tables"), extract.extract(p, "table_heads"))


@literal("static_rendered")
def _static_rendered(spark):
    one = lambda html: extract.extract(spark.createDataFrame([(1, html)], "page_id bigint, html string"), "outline", url=None).select("level", "title")
    return corpus.static_rendered_difference(one("<h1>A</h1><h2>B</h2><h2>B</h2>"), one("<h1>A</h1><h2>B</h2><h2>New</h2>"))


@literal("excluded_elements")
def _exclude(spark):
    from pagemill.functions.formats import without

    h = "<nav>n</nav><p class=ad>a</p><p id=x>x</p><p>keep</p>"
    return spark.createDataFrame([(1, without(h, ["nav", ".ad", "#x"]))], "page_id bigint, html string")


@literal("nested_objects")
def _nested(spark):
    t = texts(spark, '{"items":[{"Name":"a","Data":[{"x":1},null,{"x":1}]},{"Name":"a","Data":{"x":1}}]}', '{"Items":"[{}]"}', "{")
    return nested.bridge(t, "content", "id").select("page_id", "kind", "node_path", "parent_path", "ordinal", "attributes")
