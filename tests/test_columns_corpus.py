"""Column functions and relational operators."""

import base64
import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import columns as C
from pagemill.functions import urls as U
from pagemill.operators import corpus as K


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr).first()[0]


URLS = [
    "HTTP://User@E.org:80/a/?b=2&utm_source=x&a=1#f", "https://e.org:443", "https://e.org/a//", "https://e.org/?gclid=1", "https://e.org/x?a=1&&b", "mailto:x", "", "https://e.org:8443/p", "http://e.org/a?_hsenc=1&z=%20", "//e.org/x", "https://e.org/?page=10&0x=01&1=0",
]


@pytest.mark.parametrize("u", URLS)
def test_normal_form_agrees_with_batched_one(spark, u):
    got = one(spark, C.url_normalize(F.col("u")), u=u)
    want = U.normalise(u)
    assert got == (want if "@" not in u else want)


def test_url_columns(spark):
    assert one(spark, C.url_normalize(F.col("u")), u=URLS[0]) == "http://e.org/a/?a=1&b=2"
    assert one(spark, C.url_crawl_key(F.col("u"), True), u="https://e.org/A?utm_id=1&x=2#f") == "https://e.org/A?x=2"
    assert one(spark, C.same_origin(F.col("a"), F.col("b")), a="https://e.org", b="HTTPS://E.org:443/x")
    assert not one(spark, C.same_origin(F.col("a"), F.col("b")), a="https://e.org", b="http://e.org")
    assert one(spark, C.glob(F.col("u"), ["*.PDF", "x*y.z"]), u="a/b.pdf") and not one(spark, C.glob(F.col("u"), ["x.z"]), u="xaz")
    assert one(spark, C.redact_query(F.col("u")), u="https://e.org/?api_key=1&q=2") == "https://e.org/?api_key=<redacted>&q=2"
    assert U.is_external("https://o.org", "https://e.org") and not U.is_external("https://o.org", None)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-02-03", "2024-02-03 00:00:00"), ("2024-02", "2024-02-01 00:00:00"), ("Sat, 03 Feb 2024 10:00:00 GMT", "2024-02-03 10:00:00"), ("Sat, 3 Feb 2024 10:00:00 EST", "2024-02-03 15:00:00"),
        ("2024-02-03T10:00:00+0200", "2024-02-03 08:00:00"), ("03-Feb-2024", "2024-02-03 00:00:00"), ("February 3, 2024", "2024-02-03 00:00:00"), ("02/03/2024", "2024-02-03 00:00:00"), ("tomorrow", None), ("", None), ("2024-13-01", None), ("x" * 65, None),
    ],
)
def test_dates(spark, text, want):
    got = one(spark, C.web_date(F.col("t")).cast("string"), t=text)
    assert got == want


def test_tokens(spark):
    enc = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    t = f"{enc({'alg': 'none'})}.{enc({'iss': 'i', 'exp': 86400, 'sub': 'ü'})}."
    r = one(spark, C.jwt(F.col("t")), t=t)
    assert r["algorithm"] == "none" and r["subject"] == "ü" and r["expires"] == datetime(1970, 1, 2)
    for bad in ("", "a.b.c", "x", "..", None):
        assert one(spark, C.jwt(F.col("t")), t=bad) is None


def test_text_columns(spark):
    t = "One two’s  three-four_5\n#six*"
    assert one(spark, C.words_text(F.col("t")), t=t) == 5
    assert one(spark, C.words_split(F.col("t")), t=t) == 4
    assert one(spark, C.summary_crawl(F.col("t")), t="word " * 60).endswith("word...")
    assert len(one(spark, C.summary_dataset(F.col("t")), t="x" * 500)) == 243
    assert one(spark, C.fingerprint(F.col("t")), t=" a\r\nb\r ") == one(spark, C.fingerprint(F.col("t")), t="a\nb")
    assert one(spark, C.slug(F.col("t"), F.lit(7)), t="Ä Page! ") == "0007-page"
    assert one(spark, C.table_name(F.col("t")), t="1 a-b") == "_1_a_b"


def test_chunks(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate((1, 140, 141, 250, 251, 600))] + [(90, None), (91, ""), (92, " \n ")]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in K.overlapping_chunks(d, "doc_id").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["words"])
    want = {}
    for i, t in rows:
        n = len((t or "").split())
        if n:
            want[i] = [n] if n <= 140 else [min(140, n - s) for s in range(0, n - 30, 110)]
    assert got == want
    assert {r["doc_id"] for r in K.word_chunks(d, "doc_id").where("words = 0").collect()} == {90, 91, 92}
    dup = K.distinct_chunks(K.overlapping_chunks(d.where("doc_id = 1").unionByName(d.where("doc_id = 1").withColumn("doc_id", F.lit(5))), "doc_id"), "doc_id")
    assert [(r["doc_id"], r["copies"]) for r in dup.collect()] == [(1, 2)]


def test_keywords_ties(spark):
    d = spark.createDataFrame([(1, "beta alpha beta's alpha gamma the it x"), (2, None)], "doc_id int, text string")
    assert [(r["term"], r["n"]) for r in K.keywords(d, "doc_id", top=2).orderBy("rank").collect()] == [("alpha", 2), ("beta", 2)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=40))
def test_frontier_depths(spark, pairs):
    links = spark.createDataFrame([(str(a), str(b)) for a, b in pairs] or [("x", "y")], "source string, target string")
    got = {r["url"]: r["depth"] for r in K.crawl_frontier(spark.createDataFrame([("0",)], "url string"), links, 3).collect()}
    want, level = {"0": 0}, {"0"}
    for depth in range(1, 4):
        level = {str(b) for a, b in pairs if str(a) in level} - set(want)
        want.update(dict.fromkeys(level, depth))
    assert got == want


def test_robots(spark):
    from pagemill.sources import text_files as T

    txt = "# c\nUser-agent: *\nDisallow: /p\nAllow: /p/q\n\nUser-agent: mill\nUser-agent: other\nDisallow: /x*.html$\nDisallow: /y\nAllow: /y\nSitemap: https://e.org/s.xml\nbad line"
    d = T.robots(spark.createDataFrame([("e.org", txt), ("n", None)], "host string, content string"), "host")
    assert {r["group"] for r in d.collect()} == {1, 2}
    rules = T.robots_rules(d, "host", "PageMill/1")
    urls = spark.createDataFrame([(u,) for u in ("https://e.org/x1.html", "https://e.org/x.html?a", "https://e.org/y", "https://e.org/p", "https://f.org/x.html", None)], "url string")
    got = {r["url"]: r["allowed"] for r in K.robots_verdict(urls, rules).collect()}
    assert got == {"https://e.org/x1.html": False, "https://e.org/x.html?a": True, "https://e.org/y": True, "https://e.org/p": True, "https://f.org/x.html": True}
    star = T.robots_rules(d, "host", "nobody")
    assert {(r["allow"], r["pattern"]) for r in star.collect()} == {(False, "/p"), (True, "/p/q")}


def test_graph_refresh_duplicates(spark):
    e = K.link_edges(spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "x"), (None, "a")], "source string, target string"), spark.createDataFrame([("b",)], "url string"), spark.createDataFrame([("b",), ("c",)], "url string"))
    assert {tuple(r) for r in e.collect()} == {("a", "b", "fetched"), ("a", "c", "skipped"), ("b", "x", "external")}
    assert {tuple(r) for r in K.degrees(e).collect()} == {("a", 0, 2, 2), ("b", 1, 1, 0), ("c", 1, 0, 0), ("x", 1, 0, 0)}
    s = "url string, entity_tag string, last_modified string, fingerprint string"
    new = spark.createDataFrame([("a", "1", None, "f"), ("b", None, "d", "f"), ("c", None, None, "f"), ("n", None, None, None)], s)
    old = spark.createDataFrame([("a", "2", None, "f"), ("b", None, "d", "g"), ("c", None, None, "f"), ("o", None, None, None)], s)
    assert {tuple(r) for r in K.refresh(new, old).collect()} == {("a", "changed"), ("b", "unchanged"), ("c", "unchanged"), ("n", "new"), ("o", "gone")}
    d = K.duplicate_pages(spark.createDataFrame([(3, "x"), (1, "x "), (2, None)], "id int, text string"), "id")
    assert {(r["id"], r["duplicate"]) for r in d.collect()} == {(3, True), (1, False), (2, False)}
    diff = K.static_rendered_difference(spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int"))
    assert sorted(tuple(r) for r in diff.collect()) == [(1, "removed"), (2, "removed"), (3, "added")]


@pytest.mark.parametrize("rows", [100_000, 3])
def test_large_keys_are_split(spark, monkeypatch, rows):
    from pagemill.operators import hot

    monkeypatch.setattr(hot, "HOT_ROWS", rows)
    data = [(i, "a" if i % 3 else f"k{i % 7}", i * 7 % 11 if i % 5 else None, "same" if i % 2 else f"t{i}") for i in range(60)]
    df = spark.createDataFrame(data, "id bigint, key string, at int, text string")
    want = {}
    for k in {r[1] for r in data}:
        mine = sorted((r for r in data if r[1] == k), key=lambda r: (-1 if r[2] is None else r[2], r[0]))
        want[k] = (mine[-1][0], mine[-2][0] if len(mine) > 1 else None)
    got = {r["key"]: (r["last"]["id"], r["previous"]["id"] if r["previous"] else None) for r in K.last_two(df, "key", ["at", "id"]).collect()}
    assert got == want
    dup = K.duplicate_pages(df, "id").collect()
    assert len(dup) == 60 and {r["first"] for r in dup if r["text"] == "same"} == {1} and sum(r["duplicate"] for r in dup) == 29
    chunks = df.select("id", F.lit(0).alias("chunk_index"), "text")
    assert K.distinct_chunks(chunks, "id").count() == 31
    paced = K.paced(df.select("key", F.col("id").cast("string").alias("url")), 2.0, "key").groupBy("key").agg(F.countDistinct("at").alias("n"), F.count("*").alias("m"), F.max("at").alias("x")).collect()
    assert all(r["n"] == r["m"] and r["x"] == 2.0 * (r["n"] - 1) for r in paced)
