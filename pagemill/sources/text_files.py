"""Readers of the text formats around web pages: robots, sitemaps, feeds, manifests, well-known files, HAR, cookies."""

from __future__ import annotations

import codecs
import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.functions.columns import web_date
from pagemill.functions.dom import normal
from pagemill.functions.urls import resolve

# ---- bytes

_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def decode_bytes(data: bytes | None, charset: str | None = None) -> str | None:
    """Text of a response: byte order mark, then transport charset, then declared charset, then UTF-8."""
    if data is None:
        return None
    for bom, enc in _BOMS:
        if data.startswith(bom):
            return data[len(bom) :].decode(enc, "replace")
    m = _CHARSET.search(data)
    for name in (charset, m[1].decode() if m else None):
        try:
            if name:
                n = name.strip("\"' ")
                n = "cp1252" if n.lower() in ("iso-8859-1", "latin1", "latin-1", "ascii", "us-ascii") else n
                return data.decode(codecs.lookup(n).name, "replace")
        except (LookupError, UnicodeError):
            continue
    return data.decode("utf-8", "replace")


def decode_column(df: DataFrame, data: str, charset: str | None, key: str, out: str = "html") -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def fn(b, _):
        return {"key": b.column(0).to_pylist(), "text": [decode_bytes(d, c) for d, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]}

    src = df.select(F.col(key).alias("key"), F.col(data).alias("d"), (F.col(charset) if charset else F.lit(None).cast("string")).alias("c"))
    return map_arrow(src, fn, f"key {kind}, text string").toDF(key, out)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, html`` of files, decoded by their own marks."""
    return decode_column(spark.read.format("binaryFile").load(path).select("path", "content"), "content", None, "path")


# ---- robots.txt


def robots(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """``key, line, directive, value, group, agents`` of each directive; a user agent after a rule opens a new group.

    Comments, blank lines and lines without a colon are skipped. Directives before any user agent are in group 0.
    """
    lines = files.select(key, F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), "\r\n|\r|\n")).alias("pos", "raw"))
    x = F.trim(F.regexp_replace("raw", "#.*$", ""))
    d = lines.select(key, (F.col("pos") + 1).alias("line"), F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("directive"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"), F.instr(x, ":").alias("_c")).where("_c > 0").drop("_c")
    w = Window.partitionBy(key).orderBy("line")
    agent = F.col("directive") == "user-agent"
    d = d.withColumn("_new", (agent & (F.coalesce(F.lag("directive").over(w), F.lit("")) != "user-agent")).cast("int"))
    d = d.withColumn("group", F.sum("_new").over(w)).drop("_new")
    return d.withColumn("agents", F.collect_list(F.when(agent, F.lower("value"))).over(Window.partitionBy(key, "group")))


def robots_rules(directives: DataFrame, key: str, agent: str) -> DataFrame:
    """``key, allow, pattern`` that apply to a crawler: groups of the longest agent token its name contains, else of '*'."""
    g = directives.where(F.col("directive").isin("allow", "disallow"))
    token = F.array_max(F.transform(F.filter("agents", lambda a: (a != "*") & F.lit(agent.lower()).contains(a) & (a != "")), F.length))
    fit = F.coalesce(token, F.when(F.array_contains("agents", "*"), F.lit(0)))
    g = g.withColumn("_fit", fit).where("_fit is not null")
    best = g.groupBy(key).agg(F.max("_fit").alias("_best"))
    return g.join(best, key).where(F.col("_fit") == F.col("_best")).select(key, (F.col("directive") == "allow").alias("allow"), F.col("value").alias("pattern"))


# ---- XML


def _xml(text: str | None):
    """Root of an XML text with local names; None if it can't be read or declares entities."""
    if not text or "<!ENTITY" in text:
        return None
    try:
        root = ET.fromstring(text.lstrip("﻿ \t\r\n"))
    except ET.ParseError:
        return None
    for n in root.iter():
        if isinstance(n.tag, str):
            n.tag = n.tag.rsplit("}", 1)[-1]
    return root


def _child(n, *names: str) -> str:
    for name in names:
        c = n.find(name)
        if c is not None and (c.text or "").strip():
            return c.text.strip()
    return ""


def sitemap_rows(text: str, base: str | None) -> list[dict]:
    root = _xml(text)
    if root is None:
        return []
    index = root.tag == "sitemapindex"
    out = []
    for n in root.findall("sitemap" if index else "url"):
        u = resolve(_child(n, "loc"), base)
        if u:
            out.append({"url": u, "lastmod": _child(n, "lastmod") or None, "is_sitemap": index})
    return out


def sitemaps(files: DataFrame, key: str, text: str = "content", url: str | None = "url") -> DataFrame:
    """``key, url, lastmod, is_sitemap``; unreadable files give no rows, addresses repeat as they stand."""
    return _file_rows(files, key, text, url, sitemap_rows, "url string, lastmod string, is_sitemap boolean").withColumn("lastmod", web_date(F.col("lastmod")))


def sitemap_urls(rows: DataFrame) -> DataFrame:
    """Addresses distinct but for case; the least spelling stays."""
    return rows.where("not is_sitemap").groupBy(F.lower("url").alias("_k")).agg(F.min("url").alias("url")).select("url")


def feed_rows(text: str, base: str | None) -> list[dict]:
    root = _xml(text)
    if root is None:
        return []
    chan = root.find("channel") if root.tag in ("rss", "RDF") else root
    chan = root if chan is None else chan
    title = _child(chan, "title")
    items = root.findall(".//item") if root.tag in ("rss", "RDF") else root.findall("entry")
    out = []
    for i, n in enumerate(items):
        link = _child(n, "link")
        for x in n.findall("link"):
            if x.get("href") and x.get("rel", "alternate") == "alternate":
                link = x.get("href")
                break
        out.append(
            {
                "item_ix": i, "feed": title, "title": normal(_child(n, "title")), "url": resolve(link, base), "id": _child(n, "guid", "id"), "summary": _child(n, "description", "summary", "content", "encoded"),
                "published": _child(n, "pubDate", "published", "issued", "date") or None, "updated": _child(n, "updated", "modified") or None, "author": _child(n, "author", "creator") or (_child(n.find("author"), "name") if n.find("author") is not None else ""),
                "categories": list(dict.fromkeys(c for x in n.findall("category") if (c := (x.get("term") or x.text or "").strip()))),
            }
        )
    return out


def feeds(files: DataFrame, key: str, text: str = "content", url: str | None = "url") -> DataFrame:
    """Items of RSS and Atom feeds with their dates as instants; a key named like one of their columns becomes ``source_<key>``."""
    schema = "item_ix int, feed string, title string, url string, id string, summary string, published string, updated string, author string, categories array<string>"
    f = _file_rows(files, key, text, url, feed_rows, schema)
    return f.withColumn("published", web_date(F.col("published"))).withColumn("updated", web_date(F.col("updated")))


def _file_rows(files: DataFrame, key: str, text: str, url: str | None, rows, schema: str) -> DataFrame:
    kind = files.schema[key].dataType.simpleString()
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def fn(b, _):
        out: dict = {"_key": [], **{n: [] for n in names}}
        for k, t, u in zip(*(b.column(i).to_pylist() for i in range(3))):
            for r in rows(t, u) if t else ():
                out["_key"].append(k)
                for n in names:
                    out[n].append(r[n])
        return out

    src = files.select(F.col(key).alias("_key"), F.col(text).alias("_t"), (F.col(url) if url else F.lit(None).cast("string")).alias("_u"))
    clash = [n for n in names if n == key]
    got = map_arrow(src, fn, f"_key {kind}, {schema}")
    return got.withColumnRenamed("_key", "source_" + key if clash else key)


# ---- JSON


def manifests(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Web app manifests: name, start url, display and icons."""
    schema = "name string, short_name string, start_url string, scope string, display string, theme_color string, icons array<struct<src:string,sizes:string,type:string,purpose:string>>, screenshots array<struct<src:string,sizes:string>>, related_applications array<struct<platform:string,url:string,id:string>>"
    return files.select(key, F.from_json(F.col(text), schema).alias("m")).select(key, "m.*")


def har_entries(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Requests of HAR logs: start, method, url, status, type, size and time."""
    schema = "log struct<entries: array<struct<startedDateTime:string,time:double,request:struct<method:string,url:string>,response:struct<status:int,content:struct<mimeType:string,size:bigint>>>>>"
    e = files.select(key, F.posexplode(F.from_json(F.col(text), schema)["log"]["entries"]).alias("entry_ix", "e"))
    return e.select(
        key, "entry_ix", F.try_to_timestamp("e.startedDateTime").alias("started"), F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"), F.col("e.response.status").alias("status"),
        F.col("e.response.content.mimeType").alias("content_type"), F.col("e.response.content.size").alias("size"), F.col("e.time").alias("millis"),
    )


def network_data_sources(entries: DataFrame) -> DataFrame:
    """Entries that carry data: JSON or XML answers of successful requests."""
    return entries.where(F.col("status").between(200, 299) & F.col("content_type").rlike(r"(?i)json|xml") & ~F.col("content_type").rlike("(?i)html"))


def well_known(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """``key, line, section, name, value`` of security.txt, humans.txt and ads.txt lines.

    '/* X */' opens a section; lines without a colon keep their text as value.
    """
    l = files.select(key, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "raw")).select(key, (F.col("pos") + 1).alias("line"), F.trim("raw").alias("x"))  # noqa: E741
    l = l.withColumn("_s", F.regexp_extract("x", r"^/\*\s*(.*?)\s*\*/$", 1)).where("x <> '' and not startswith(x, '#')")  # noqa: E741
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = l.withColumn("section", F.last(F.when(F.col("_s") != "", F.col("_s")), ignorenulls=True).over(w)).where("_s = ''")  # noqa: E741
    named = F.col("x").rlike(r"^[A-Za-z][\w -]*:")
    return l.select(key, "line", "section", F.when(named, F.trim(F.split_part("x", F.lit(":"), F.lit(1)))).alias("name"), F.when(named, F.trim(F.regexp_replace("x", "^[^:]*:", ""))).otherwise(F.col("x")).alias("value"))


def ads_entries(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Seller lines of ads.txt: domain, account, relation, authority."""
    r = well_known(files, key, text).where("name is null").select(key, "line", F.transform(F.split(F.regexp_replace("value", "#.*$", ""), ","), lambda x: F.trim(x)).alias("p")).where(F.size("p") >= 3)
    return r.select(key, "line", F.lower(F.col("p")[0]).alias("domain"), F.col("p")[1].alias("account"), F.upper(F.col("p")[2]).alias("relation"), F.try_element_at("p", F.lit(4)).alias("authority"))


# ---- cookies

COOKIE = "struct<name:string,value:string,domain:string,path:string,expires:bigint,http_only:boolean,secure:boolean,same_site:string>"


def netscape_cookies(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Cookies of a tab-separated cookie file; '#HttpOnly_' marks http-only ones, other '#' lines and short lines are skipped."""
    l = files.select(key, F.explode(F.split(text, "\r\n|\r|\n")).alias("raw"))  # noqa: E741
    l = l.select(key, F.startswith("raw", F.lit("#HttpOnly_")).alias("http_only"), F.split(F.regexp_replace("raw", "^#HttpOnly_", ""), "\t").alias("p"), "raw").where((~F.startswith("raw", F.lit("#")) | F.col("http_only")) & (F.size("p") >= 7))  # noqa: E741
    p = F.col("p")
    return l.select(key, p[5].alias("name"), p[6].alias("value"), p[0].alias("domain"), p[2].alias("path"), p[4].try_cast("bigint").alias("expires"), "http_only", (F.upper(p[3]) == "TRUE").alias("secure"), F.lit(None).cast("string").alias("same_site"))


def to_netscape(cookies: DataFrame) -> DataFrame:
    """One line per cookie, as ``netscape_cookies`` reads it."""
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    host = F.concat(F.when(F.col("http_only"), "#HttpOnly_").otherwise(""), F.col("domain"))
    return cookies.select(F.concat_ws("\t", host, flag(F.startswith("domain", F.lit("."))), "path", flag(F.col("secure")), F.coalesce(F.col("expires").cast("string"), F.lit("0")), "name", "value").alias("value"))


def set_cookie(header: Column) -> Column:
    """Struct of a Set-Cookie header; null without a name."""
    parts = F.transform(F.split(header, ";"), lambda x: F.trim(x))
    attrs = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.slice(parts, 2, 100), lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1))))), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(F.slice(parts, 2, 100), lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1))) == k), -1).alias("v"))))
    get = lambda k: F.trim(F.regexp_replace(F.try_element_at(attrs, F.lit(k)), "^[^=]*=?", ""))
    name = F.trim(F.split_part(parts[0], F.lit("="), F.lit(1)))
    s = F.struct(
        name.alias("name"), F.trim(F.regexp_replace(parts[0], "^[^=]*=?", "")).alias("value"), get("domain").alias("domain"), F.coalesce(get("path"), F.lit("/")).alias("path"),
        F.coalesce(get("expires").try_cast("bigint"), F.unix_timestamp(web_date(F.regexp_replace(get("expires"), r"(\d)-([A-Za-z]{3})-(\d)", "$1 $2 $3")))).alias("expires"),
        F.array_contains(F.map_keys(attrs), "httponly").alias("http_only"), F.array_contains(F.map_keys(attrs), "secure").alias("secure"), get("samesite").alias("same_site"),
    )
    return F.when((name != "") & (F.instr(parts[0], "=") > 0), s)


def browser_cookies(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Cookies of a JSON array or object as browsers export them."""
    one = "struct<name:string,value:string,domain:string,path:string,expires:double,expirationDate:double,httpOnly:boolean,secure:boolean,sameSite:string>"
    arr = F.when(F.startswith(F.ltrim(F.col(text)), F.lit("[")), F.from_json(F.col(text), f"array<{one}>")).otherwise(F.array(F.from_json(F.col(text), one)))
    c = files.select(key, F.explode(arr).alias("c")).where("c.name is not null")
    return c.select(key, "c.name", "c.value", "c.domain", "c.path", F.coalesce("c.expires", "c.expirationDate").cast("bigint").alias("expires"), F.col("c.httpOnly").alias("http_only"), "c.secure", F.col("c.sameSite").alias("same_site"))


# ---- SAML


def saml_rows(text: str, _base=None) -> list[dict]:
    import base64
    import binascii

    try:
        xml = base64.b64decode(re.sub(r"\s+", "", text), validate=True).decode("utf-8", "replace") if not text.lstrip().startswith("<") else text
    except binascii.Error:
        return []
    root = _xml(xml)
    if root is None or not root.tag.endswith("Response"):
        return []
    cond = root.find(".//Conditions")
    code = root.find(".//StatusCode")
    return [
        {
            "issuer": _child(root, "Issuer"), "status": (code.get("Value") or "").rsplit(":", 1)[-1] if code is not None else "", "destination": root.get("Destination") or "", "subject_present": root.find(".//NameID") is not None,
            "audiences": [a.text.strip() for a in root.iter("Audience") if (a.text or "").strip()], "not_before": cond.get("NotBefore") if cond is not None else None, "not_after": cond.get("NotOnOrAfter") if cond is not None else None,
            "attributes": [a.get("Name") or "" for a in root.iter("Attribute")],
        }
    ]


def saml_responses(rows: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Summary of SAML responses; values of attributes and the subject are not shown."""
    schema = "issuer string, status string, destination string, subject_present boolean, audiences array<string>, not_before string, not_after string, attributes array<string>"
    return _file_rows(rows, key, text, None, saml_rows, schema)


def json_shape(value) -> str:
    """Structural signature of JSON: sorted keys and kinds."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{json_shape(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + "|".join(sorted({json_shape(v) for v in value})) + "]"
    return "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def json_shapes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, shape`` of JSON texts; unreadable ones give no row."""

    def one(t, _):
        try:
            return [{"shape": json_shape(json.loads(t))}]
        except (ValueError, RecursionError):
            return []

    return _file_rows(rows, key, text, None, one, "shape string")
