"""Extractors on small pages."""

from pagemill.functions.dom import parse
from pagemill.operators import audit, transform, extract as X, select as S, tables as T


def rows(kind, html, url=None):
    return list(X.EXTRACTORS[kind][0](parse(html), url))


def test_outline():
    got = rows("outline", "<h1>a</h1><h2>b</h2><h3>c</h3><h2>d</h2><h1>e</h1><h2>f</h2>")
    assert [r["parent_ord"] for r in got] == [None, 0, 1, 0, None, 4]


def test_lists_two_ways():
    html = "<ul><li>a<ul><li>b</li></ul></li><li> </li></ul>"
    assert [r["segments"] for r in rows("lists", html) if r["list_ix"] == 0] == [["a", "b"], ["b"]]
    assert [r["segments"] for r in rows("direct_lists", html) if r["list_ix"] == 0] == [["a", "b"]]


def test_table_spans_headers_and_footer():
    t = T.read_tables(parse("<table><thead><tr><th>A<th>B<th>B</thead><tfoot><tr><td>f</tfoot><tbody><tr><td rowspan=2>x<td colspan=2>y<tr><td>p<td>q<td>drop</tbody></table>"))[0]
    assert t["headers"] == ["A", "B", "B1"]
    assert t["rows"] == [{"A": "x", "B": "y", "B1": "y"}, {"A": "x", "B": "p", "B1": "q"}, {"A": "f"}]
    assert T.read_tables(parse("<table><tr><td>1<td>2</table>"))[0]["headers"] == ["Column1", "Column2"]
    assert T.read_tables(parse("<table></table>")) == []
    assert T.read_tables(parse("<table><tr><td>k<td>v<tr><td>m<td>n</table>"), reverse=True)[0]["rows"] == [{"k": "v", "m": "n"}]
    assert T.infer_type(["1", " 2", None]) == "bigint" and T.infer_type(["1", "x"]) == "string" and T.infer_type(["1.5", "2"]) == "double" and T.infer_type([None]) == "string"
    big = "<table><tr>" + "<td colspan=1000>" * 11 + "</table>"
    assert T.read_tables(parse(big))[0]["error"]


def test_generated_tables_checksum():
    for n in (25, 2500):
        html = "<table><tr><th>Id<th>Value</tr>" + "".join(f"<tr><td>{i}<td>{7 * i}" for i in range(n)) + "</table>"
        r = T.read_tables(parse(html))[0]["rows"]
        assert len(r) == n and sum(int(x["Value"]) for x in r) == 7 * n * (n - 1) // 2


def test_forms():
    f = rows("forms", "<form id=f action=/login method=post><input name=u value=1><input type=password name=p><input type=checkbox name=c><fieldset disabled><input name=d></fieldset></form><input form=f name=o value=2>", "https://e.org/a")[0]
    assert f["action"] == "https://e.org/login" and f["method"] == "POST" and f["login"]
    assert [(s["key"], s["value"]) for s in f["successful"]] == [("u", "1"), ("p", ""), ("o", "2")]
    relay = rows("forms", "<form action=https://i.org/acs method=post><input type=hidden name=SAMLResponse value=x></form><script>document.forms[0].submit()</script>")[0]
    assert relay["relay"] == "saml"


def test_metadata():
    html = "<meta name=description content=d><meta property=og:title content=t><meta property=og:image content=''><div itemscope itemtype=https://schema.org/Person><b itemprop=name>N</b><i itemprop=age>3</i></div><script type=application/ld+json>{\"@graph\":[{\"@type\":[\"A\",\"B\"],\"name\":\"x\"}]}</script><script type=application/ld+json>{bad</script>"
    assert [r["name"] for r in rows("meta", html)] == ["description", "og:title", "og:image"]
    assert rows("open_graph", html) == [{"name": "title", "values": ["t"]}, {"name": "image", "values": []}]
    assert rows("microdata", html)[0]["props"] == [("name", ["N"]), ("age", ["3"])]
    assert rows("microdata_unknown", html)[0]["unknown"] == ["age"]
    ld = rows("json_ld", html)
    assert ld[0]["type"] == "A,B" and ld[1]["error"]


def test_links_and_images():
    html = "<base href=/d/><p>see <a href='x?q#f' title=' T '>l</a> <a href=javascript:1>j</a> <a href='https://o.org/'>o</a></p><img src=a.png srcset='b.png 2x, c.png 1x' alt=z>"
    got = rows("links", html, "https://e.org/p")
    assert [r["url"] for r in got] == ["https://e.org/d/x?q#f", "javascript:1", "https://o.org/"] and [r["external"] for r in got][2]
    assert [r["url"] for r in rows("crawl_links", html, "https://e.org/p")] == ["https://e.org/d/x?q", "https://o.org/"]
    assert [(r["descriptor"], r["best"]) for r in rows("images", html, "https://e.org/p")] == [("", False), ("2x", True), ("1x", False)]
    assert {r["url"] for r in rows("crawl_assets", html, "https://e.org/p")} == {f"https://e.org/d/{x}.png" for x in "abc"}


def test_scripts():
    html = "<script id=__NEXT_DATA__ type=application/json>{\"p\":1}</script><script>window.config={a:'x',b:[1,2,]};let n=3;fetch('/api/u',{method:'POST'});var csrfToken='abcdef';</script><script type=importmap>{}</script>"
    assert ("config", '{"a": "x", "b": [1, 2]}') in [(r["name"], r["value"]) for r in rows("javascript", html)]
    assert rows("app_state", html)[0]["json"] == '{"p": 1}'
    assert rows("endpoints", html)[0]["method"] == "POST"
    assert rows("api_inventory", html, "https://e.org/")[0]["risk"] == "High"
    assert rows("tokens", html)[0]["name"] == "csrfToken"
    assert [r["type"] for r in rows("script_data", html)] == ["application/json", "importmap"]
    flight = '<script>self.__next_f.push([1,"0:[1]\\n1:T3,abc2:I{}\\n"])</script>'
    assert [(r["id"], r["tag"], r["data"]) for r in rows("flight_rows", flight)] == [(0, "", "[1]"), (1, "T", "abc"), (2, "I", "{}")]


def test_documentation_blocks():
    html = "<div class=breadcrumb><a href=/a>A</a> <span>B</span></div><h2>GET /v1/users/{id}</h2><p>One user.</p><pre><code class=language-bash>curl x</code></pre><details><summary>Q?</summary>Yes</details><div class='note'>Mind</div><header>h</header><table><tr><td>k<td>v</table>"
    assert [r["label"] for r in rows("breadcrumbs", html)] == ["A", "B"]
    e = rows("doc_endpoints", html)[0]
    assert (e["method"], e["path"], e["parameters"], e["promoted"]) == ("GET", "/v1/users/{id}", ["id"], True)
    assert rows("code_blocks", html)[0]["kind"] == "curl"
    assert rows("faq", html)[0]["answer"] == "Yes"
    assert rows("callouts", html)[0]["kind"] == "note"
    assert rows("spec_tables", html)[0]["name"] == "k"
    assert rows("layout", html)[0]["kind"] == "header"
    assert rows("publication_dates", "<meta property=article:published_time content=2024-01-02>")[0]["published"] == "2024-01-02"
    assert rows("publication_dates", "<meta property=article:published_time content=2024-01-02><meta name=pubdate content=2024-01-03>") == []
    assert rows("plan", "<div id=root></div><script src=a></script>")[0]["mode"] == "RenderedSnapshot"


def test_every_extractor_on_odd_pages(spark):
    pages = [(1, None, None), (2, "", None), (3, "<", "x"), (4, "<p" * 50, "https://e.org/"), (5, "<div>" * 600 + "t", "https://e.org/"), (6, "<p>é 😀</p>".encode("utf-16", "surrogatepass").decode("utf-16"), "::"), (6, "<a href='http://[bad'>x</a>", "http://[bad")]
    df = spark.createDataFrame(pages, "page_id bigint, html string, url string")
    kinds = list(X.EXTRACTORS)
    assert X.extract_many(df, kinds).count() == len(pages)
    assert X.extract(df.limit(0), "links").count() == 0
    same = X.extract(df.withColumn("name", df.url), "meta")
    assert same.columns == ["page_id", "name", "source_attribute", "content"]


def test_pages_that_are_deep_or_broken_in_one_place(spark):
    nest = "[" * 1000 + "]" * 1000
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000 + "<p>after</p>"
    pages = [
        (1, deep), (2, f'<script type="application/ld+json">{nest}</script><script id="__NEXT_DATA__">{nest}</script><script type="application/json">{nest}</script><script>var a = {nest}; window.config = JSON.parse("{nest}")</script>'),
        (3, '<script>self.__next_f.push([3,"!!"])</script><script>self.__next_f.push([1,"10000000000:{}\\nffffffffffffffffffff:{}\\n"])</script>'),
        (4, '<script type="application/ld+json">{"@type":"Article","mainEntityOfPage":5,"datePublished":"2024-01-02"}</script><script type="application/ld+json">{"@type":"Article","mainEntityOfPage":{"@id":7}}</script>'),
        (5, "<table>" + "<tr><td>x</td></tr>" * 5000 + "</table>"), (6, f"<pre>{nest}</pre>"),
    ]
    df = spark.createDataFrame([(i, h, "https://e.org/") for i, h in pages], "page_id bigint, html string, url string")
    assert X.extract_many(df, list(X.EXTRACTORS)).count() == len(pages)
    assert {r["id"] for r in X.extract(df.where("page_id = 3"), "flight_rows").collect()} == {1 << 40, -1}
    text = X.extract(df.where("page_id = 1"), "text").first()
    assert "deep text" in text["text"] and text["text"].endswith("after")
    assert S.elements(df.where("page_id = 1"), "p").count() == 2 and S.dom_nodes(df).count() > 3000
    for name in ("format_html", "minify_html", "inline_css", "markdown", "lines", "readable"):
        assert transform.transform(df, name).count() == len(pages)
    assert transform.differences(df.selectExpr("page_id", "html as a", "concat(html, '<p>x') as b"), "page_id", "a", "b").where("page_id = 1 and kind = 'added'").count() == 1


def test_addresses_joined_late_match_those_beside_the_page(spark):
    body = (
        "{base}<link rel=canonical href='c?b=1&a=2'><link rel=icon href=i.png><script src=s.js></script><style>p{{background:url(b.png)}}</style>"
        "<a href=x#f>X</a><a href=/y>Y</a><a href='x'>again</a><a href='mailto:q@e'>m</a><a href='http://o.example/z'>Z</a><img srcset='a.png 1x, b.png 2x' alt=k>"
        "<form method=post action=go name=f><input name=q></form><form action='javascript:x'></form><nav class=breadcrumb><a href=/>Home</a></nav><script>fetch('/api/v1/x', {{method: 'POST'}})</script>"
        '<script type="application/ld+json">{{"@type":"Article","url":"https://e.org/d/p","datePublished":"2024-01-02"}}</script><script type="application/ld+json">{{"@type":"Article","url":"https://e.org/q","datePublished":"2023-01-02"}}</script>'
        "<button class=btn>Buy now</button><a class='btn primary' href=buy>Order</a>"
    )
    pages = [(1, body.format(base=""), "https://e.org/d/p"), (2, body.format(base="<base href='/root/'>"), "https://e.org/q"), (3, body.format(base="<base href='http://b.example/k/'>"), None), (4, body.format(base=""), None), (5, None, "https://e.org/"), (6, "", "https://e.org/")]
    df = spark.createDataFrame(pages, "page_id bigint, html string, url string")
    urls = df.select("page_id", "url").unionByName(df.limit(2).select("page_id", "url"))
    kinds = sorted(X.LATE) + ["outline"]
    a = {r["page_id"]: r.asDict(True) for r in X.extract_many(df, kinds).collect()}
    got = X.extract_joined(df.drop("url"), kinds, urls)
    b = {r["page_id"]: r.asDict(True) for r in got.collect()}
    assert a == b and len(b[1]["links"]) == 7 and b[1]["publication_dates"][0]["published"] == "2024-01-02"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "html" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    assert "Exchange" not in X.extract_joined(spark.read.parquet("/root/testdata/sf0.001/http_cache.parquet").repartition(4).select("page_id", "html"), ["outline"], urls)._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


HTML = "<div class=card><h3>A</h3><a href=/a>x</a><span>$1</span></div><div class=card><h3>B</h3><a href=/b>y</a><span>$2</span></div><div class=card><h3>C</h3><a href=/c></a></div><p>JavaScript note</p>"


def test_selection(spark):
    df = spark.createDataFrame([(1, HTML, "https://e.org/"), (2, None, None)], "page_id bigint, html string, url string")
    assert [r["value"] for r in S.values(df, ".card a::attr(href)", url="url").collect()] == ["https://e.org/a", "https://e.org/b", "https://e.org/c"]
    assert S.elements(df, ".card", first=True).count() == 1
    assert S.by_text(df, "javascript").count() == 1 and S.by_text(df, "javascript", case_sensitive=True).count() == 0
    rec = S.records(df, ".card", {"title": "h3", "url": "a::attr(href)", "price": "span"}, url="url")
    assert [tuple(r)[2:] for r in rec.orderBy("item_ix").collect()] == [("A", "https://e.org/a", "$1"), ("B", "https://e.org/b", "$2"), ("C", "https://e.org/c", None)]
    rep = {r["field"]: r["status"] for r in S.record_report(rec, ["title", "price"]).collect()}
    assert rep == {"title": "Complete", "price": "Partial"}
    top = S.collections(df).collect()[0]
    assert top["selector"] == "div.card" and top["items"] == 3
    assert S.similar(df, ".card").count() >= 1
    want = S.fingerprint(next(parse(HTML).elements("h3")))
    assert S.relocate(df, want).collect()[0]["selector"].startswith("div:nth-of-type(1)")
    n = S.dom_nodes(df)
    assert S.inside(n, n.where("tag = 'div'")).count() == 8 and S.outside(n, n.where("tag = 'div'")).count() == 1
    assert {r["change"] for r in S.drift(rec, rec.where("price is not null")).collect()} == {"missing"}
    assert S.run_recipe(df, S.save_recipe(".card", {"t": "h3"})).count() == 3
    css = spark.createDataFrame([(1, "a{--x:1;color:red}"), (2, None)], "id int, css string")
    assert S.style_variables(S.style_rules(css, "id")).count() == 1
    assert S.style_usage(spark.createDataFrame([(1, "<style>p{a:b}i{c:d}</style><p>x")], "page_id int, html string")).collect()[0]["matches"] == 1


def test_audit(spark):
    html = "<h1>a</h1><h3>b</h3><img src=x><a href='javascript:x'>y</a><div id=d></div><div id=d></div><label for=none>l</label><button></button><input aria-labelledby=d>"
    codes = [r["code"] for r in audit.audit_tree(parse(html))]
    assert codes == ["document-title-missing", "document-language-missing", "duplicate-id", "image-alt-missing", "interactive-name-missing", "form-label-missing", "unsafe-url-scheme", "heading-level-skipped"]
    assert not audit.unsafe_url("img", "src", "data:image/png;base64,x") and audit.unsafe_url("a", "href", "java\tscript:x") and audit.unsafe_url("script", "src", "mailto:x") and not audit.unsafe_url("a", "href", "mailto:x")
    df = spark.createDataFrame([(1, "<img src='a b.png'><label for=q></label><label for=d>x</label><div id=d style=' '></div><input id=z name=n>", "https://e.org/", 429), (2, None, None, None), (3, "", None, None)], "page_id int, html string, url string, status int")
    assert [r["rule_id"] for r in audit.compatibility(df).collect()] == ["missing-img-alt", "empty-label", "label-target-missing", "label-target-invalid", "form-field-missing-label", "empty-inline-style", "invalid-resource-url"]
    assert df.select(audit.response_class(df.status, df.html)).first()[0] == "RateLimit"
    assert X.extract(df, "facts").count() == 1
