"""Formatting, minifying, inlining, rewriting, comparing."""

from pagemill.functions import formats as F
from pagemill.functions.dom import parse, serialise
from pagemill.functions.text import fragment_text


def test_html_formats_keep_content():
    html = "<div><p>a  <b>b</b></p><!-- c --><pre> x\n  y</pre><ul> <li>1</li> <li>2</li></ul></div>"
    assert F.format_html(html).split("\n") == ["<div>", "  <p>a <b>b</b></p>", "  <!-- c -->", "  <pre> x", "  y</pre>", "  <ul>", "    <li>1</li>", "    <li>2</li>", "  </ul>", "</div>"]
    small = F.minify_html(html)
    assert small == "<div><p>a <b>b</b></p><pre> x\n  y</pre><ul><li>1</li><li>2</li></ul></div>"
    assert F.minify_html(small) == small and F.minify_html("") == ""
    assert fragment_text(parse(small)) == fragment_text(parse(html))


def test_css_formats():
    sheet = "/* c */ p , b > i { margin : 0 ; width: calc(1px + 2px); content: 'a  ;b' !important }\n@media print { a { color: red } }"
    assert F.minify_css(sheet) == "p,b>i{margin :0;width:calc(1px + 2px);content:'a  ;b' !important}@media print{a{color:red}}"
    assert "  width: calc(1px + 2px);" in F.format_css(sheet).split("\n") and F.format_css(sheet).endswith("  }\n}")


def test_inlining():
    got = F.inline_css("<style>p{color:red;margin:0}.x{color:blue}p{top:1px!important}@media print{p{color:black}}</style><p class=x style='top:2px;left:0'>t</p>")
    assert 'style="color:blue;left:0;margin:0;top:1px"' in got and "@media print{p{color:black}}" in got


def test_rewrite_and_remove():
    got = F.local_links("<a href='/a#f'>x</a><img src=b.png srcset='b.png 1x, c.png 2x'><p style='background:url(b.png)'>", {"https://e.org/a": "a.html", "https://e.org/b.png": "img/b.png"}, "https://e.org/")
    assert got == '<a href="a.html#f">x</a><img src="img/b.png" srcset="img/b.png 1x, c.png 2x"><p style="background:url(img/b.png)"></p>'
    assert F.without("<div><p class=ad>x</p><p>y</p></div>", [".ad", ".none"]) == "<div><p>y</p></div>"


def test_compare():
    assert F.compare("<p>a</p>", "<p>a</p>") == []
    got = F.compare("<p id=a class=x>one</p><i>z</i>", "<p id=a class=y>two</p><b>n</b><i>z</i>")
    assert [(d["kind"], d["old"], d["new"]) for d in got] == [("attribute", "x", "y"), ("changed", "one", "two"), ("added", None, "<b>n</b>")]
    assert F.entitize("<é>") == "&lt;é&gt;" and F.deentitize("&eacute;") == "é" and serialise(parse("")) == ""


def test_columns(spark):
    from pagemill.operators import transform as T

    df = spark.createDataFrame([(1, "<p>a</p>", "<p>b</p>"), (2, None, "<p>x</p>"), (3, "", "")], "id int, html string, later string")
    assert {r["id"]: r["minify_html"] for r in T.transform(df, "minify_html", "id").collect()} == {1: "<p>a</p>", 2: None, 3: ""}
    assert [(r["id"], r["kind"]) for r in T.differences(df, "id", "html", "later").orderBy("id").collect()] == [(1, "changed"), (2, "added")]
    calls = spark.createDataFrame([(1, "GET", "/a", "", ["x"], 50, True), (2, "GET", "/a", "sum", ["y"], 70, True), (3, "POST", "/a", "", [], 20, False)], "page_id int, method string, path string, summary string, parameters array<string>, score int, promoted boolean")
    got = {(r["method"], r["path"]): r for r in T.api_catalog(calls).collect()}
    assert got["GET", "/a"]["summary"] == "sum" and got["GET", "/a"]["parameters"] == ["x", "y"] and got["GET", "/a"]["pages"] == 2 and got["GET", "/a"]["mean_score"] == 60
