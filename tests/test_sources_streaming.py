"""Text formats, exports, streams, SQL functions, the catalog."""

from pyspark.sql import functions as F

from pagemill.sources import sinks
from pagemill.sources import text_files as T


def files(spark, *texts, url="https://e.org/"):
    return spark.createDataFrame([(i, t, url) for i, t in enumerate(texts)] + [(99, None, url)], "id int, content string, url string")


def test_bytes():
    assert T.decode_bytes("é".encode("cp1252"), "iso-8859-1") == "é"
    assert T.decode_bytes(b"\xef\xbb\xbf\xc3\xa9", "cp1252") == "é"
    assert T.decode_bytes("<meta charset=koi8-r>Ж".encode("koi8-r")) == "<meta charset=koi8-r>Ж"
    assert T.decode_bytes(b"\xff", "no-such") == "�" and T.decode_bytes(None) is None


def test_xml(spark):
    sm = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>/a</loc><lastmod>2024-01-02</lastmod></url><url><loc> https://E.org/A </loc></url></urlset>"
    rows = T.sitemaps(files(spark, sm, "<sitemapindex><sitemap><loc>/s.xml</loc></sitemap></sitemapindex>", "<bad", "<!DOCTYPE x [<!ENTITY a 'b'>]><urlset/>"), "id")
    assert rows.count() == 3 and rows.where("is_sitemap").count() == 1
    assert T.sitemap_urls(rows).count() == 1
    rss = "<rss><channel><title>F</title><item><title>T</title><link>/x</link><guid>g</guid><pubDate>Sat, 03 Feb 2024 10:00:00 GMT</pubDate><category>c</category><category>c</category></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><title>T</title><link rel='self' href='/s'/><link href='/y'/><id>i</id><updated>2024-02-03T10:00:00Z</updated></entry></feed>"
    got = T.feeds(files(spark, rss, atom), "id").orderBy("source_id").collect()
    assert got[0]["url"] == "https://e.org/x" and got[0]["categories"] == ["c"] and str(got[0]["published"]) == "2024-02-03 10:00:00"
    assert T.feeds(files(spark, rss), "url").columns[0] == "source_url"
    assert got[1]["url"] == "https://e.org/y" and got[1]["id"] == "i" and got[1]["source_id"] == 1
    saml = "<p:Response xmlns:p='urn:p'><Issuer>i</Issuer><Status><StatusCode Value='urn:x:Success'/></Status><Assertion><Conditions NotBefore='n'/><Attribute Name='mail'><AttributeValue>s</AttributeValue></Attribute></Assertion></p:Response>"
    s = T.saml_responses(files(spark, saml, "%%%"), "id").collect()
    assert len(s) == 1 and s[0]["status"] == "Success" and s[0]["attributes"] == ["mail"]


def test_json_and_lines(spark):
    assert T.manifests(files(spark, '{"name":"n","icons":[{"src":"i"}]}'), "id").first()["icons"][0]["src"] == "i"
    har = '{"log":{"entries":[{"startedDateTime":"2024-02-03T10:00:00Z","time":1.5,"request":{"method":"GET","url":"u"},"response":{"status":200,"content":{"mimeType":"application/json","size":3}}}]}}'
    e = T.har_entries(files(spark, har), "id")
    assert e.first()["status"] == 200 and T.network_data_sources(e).count() == 1
    w = T.well_known(files(spark, "# c\nContact: mailto:x\n/* TEAM */\nDev: me\nads.com, 1, direct, f0"), "id").collect()
    assert [(r["section"], r["name"], r["value"]) for r in w] == [(None, "Contact", "mailto:x"), ("TEAM", "Dev", "me"), ("TEAM", None, "ads.com, 1, direct, f0")]
    assert T.ads_entries(files(spark, "ads.com, 1, direct, f0"), "id").first()["relation"] == "DIRECT"
    assert T.json_shapes(files(spark, '[{"a":1,"b":null},{"b":true}]', "x{"), "id", "content").first()["shape"] == "[{a:number,b:null}|{b:bool}]"


def test_cookies(spark):
    line = "#HttpOnly_.e.org\tTRUE\t/\tTRUE\t9\tn\tv"
    c = T.netscape_cookies(files(spark, "# x\n" + line + "\nshort\tline"), "id")
    assert c.count() == 1 and T.to_netscape(c).first()[0] == line
    h = spark.createDataFrame([("a=b=c; Path=/p; Secure; HttpOnly; SameSite=Lax; Expires=Sat, 03-Feb-2024 10:00:00 GMT",), ("novalue",), ("",), (None,)], "h string")
    got = h.select(T.set_cookie(F.col("h")).alias("c")).collect()
    assert got[0]["c"]["value"] == "b=c" and got[0]["c"]["secure"] and got[0]["c"]["same_site"] == "Lax" and got[0]["c"]["expires"] == 1706954400
    assert [r["c"] for r in got[1:]] == [None, None, None]
    assert T.browser_cookies(files(spark, '[{"name":"a","value":"b","expires":1.5}]', '{"name":"z","expirationDate":3}', "[]"), "id").count() == 2


def test_exports_and_stream(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/crawl_pages.parquet")
    sinks.export_crawl(str(tmp_path / "x"), pages, assets=spark.read.parquet(f"{sf}/crawl_assets.parquet"))
    assert spark.read.json(str(tmp_path / "x/pages.jsonl")).count() == pages.count()
    assert sinks.json_lines(pages).count() == pages.count()
    from pagemill.streaming import pages as P

    cache = spark.read.parquet(f"{sf}/http_cache.parquet")
    cache.repartition(3).write.parquet(str(tmp_path / "in"))
    s = P.page_stream(spark, str(tmp_path / "in"), cache.schema, 1)
    P.stream_facts(s, ["links", "outline"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    from pagemill.operators.extract import extract

    assert spark.read.parquet(str(tmp_path / "out/links")).count() == extract(cache, "links", url=None).count()
    P.stream_facts(s, ["links", "outline"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/links")).count() == extract(cache, "links", url=None).count()


def test_sql_functions(spark):
    from pagemill.plans.functions_sql import register

    register(spark)
    r = spark.sql("select html_text('<p>a<p>b') t, css_select('<i>x</i><i>y', 'i') s, url_normalize('HTTP://E.org:80/') n, html_text(null) z, url_resolve('/a', 'https://e.org/b') u").first()
    assert r["t"] == "a b" and r["s"] == ["x", "y"] and r["n"] == "http://e.org" and r["z"] is None and r["u"] == "https://e.org/a"


def test_entry_and_catalog(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
