"""Script tokens, XPath, schemas and exports."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import scripts
from pagemill.functions.dom import parse
from pagemill.functions.xpath import XPathError, compile_xpath
from pagemill.operators import corpus, schema
from pagemill.sources import sinks

SCRIPT = st.lists(st.sampled_from(["var", "a", "b1", " ", "\n", "=", "+", "++", "(", ")", "{", "}", "'s t'", '"q"', "`x ${a+`y`} z`", "/r e/g", "/", "// c\n", "/* d */", ";", ",", ".", "1.5e3", "return", "[", "]", "é", "\\"]), max_size=30).map("".join)


def code(text):
    return [t for k, t in scripts.tokens(text) if k not in ("space", "line", "comment")]


@settings(max_examples=300, deadline=None)
@given(SCRIPT)
def test_tokens_join_to_the_script(text):
    assert "".join(t for _, t in scripts.tokens(text)) == text


@pytest.mark.parametrize("text", ["var a = 1, b = a + + 1;\nlet c = a - -b\nreturn /x y/.test(c) // end", "if (a) { b() } else c()\n`t ${ a + `u ${b}` } v`", "a = b\n(c)\nd = x / y / z", "for (let i = 0; i < 3; i++) { f(i) }", "const re = /[/]\\//g, s = 'it\\'s';"])
def test_minify_and_format_keep_every_token(text):
    assert code(scripts.minify_js(text)) == code(text) == code(scripts.format_js(text))
    assert len(scripts.minify_js(text)) <= len(text) and scripts.minify_js(scripts.minify_js(text)) == scripts.minify_js(text)


def test_xpath_reads_or_refuses():
    root = parse("<a id=x><b>1</b><b>2</b></a><c><b>3</b></c>")
    one = lambda e: [x if isinstance(x, str) else x.text() for x in compile_xpath(e)(root)]
    assert one("//b") == ["1", "2", "3"] and one("/a/b[2]") == ["2"] and one("//b[. > 1 and . < 3]") == ["2"] and one("//b[last()]") == ["2", "3"] and one("//b/../@id") == ["x"]
    assert one("//b[not(preceding-sibling::b)]") == ["1", "3"] and one("//*[count(b) = 2]/@*") == ["x"] and one("//b[. = '3']/ancestor::c/b") == ["3"] and one(".//b[position() = 2]") == ["2"]
    for bad in ("", "//", "//b[", "b[@]", "foo(1)", "b::c", "//b]", "a b"):
        with pytest.raises(XPathError):
            compile_xpath(bad)


value = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.floats(-1, 1) | st.text("ab", max_size=2), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("xy", min_size=1, max_size=1), c, max_size=2), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(value, value, value)
def test_schemas_merge_in_any_order(a, b, c):
    x, y, z = map(schema.schema_of, (a, b, c))
    m = schema.merge_schemas
    assert m(m(x, y), z) == m(x, m(y, z)) and m(x, y) == m(y, x) and m(x, x) == x


def test_exports_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "Success", None, "T"), (2, "u2", "Skipped", "AssetPath", None), (3, "u3", "Skipped", "OutsideHost", None)], "page_id bigint, url string, status string, skip_reason string, title string")
    d = str(tmp_path / "x")
    sinks.export_crawl(d, pages)
    assert sinks.read_export(spark, d, "pages", "page_id bigint, url string").count() == 3 and sinks.read_export(spark, d, "skipped-assets").count() == 1
    edges = corpus.link_edges(spark.createDataFrame([("u1", "u2")], "source string, target string"), pages.select("url"))
    sinks.write_graph(d, edges, corpus.degrees(edges))
    assert spark.read.text(f"{d}/graph").where("part = 'node'").count() == 2
    sinks.write_index(d, pages)
    assert "<li>" in "".join(r[0] for r in spark.read.text(f"{d}/index").collect())
    doc = schema.openapi_documents(spark.createDataFrame([("h", "GET", '/a"b', "s", ["p"], True), ("h", "GET", "/z", "s", [], False)], "host string, method string, path string, summary string, parameters array<string>, promoted boolean"), "host").first()
    assert list(json.loads(doc["document"])["paths"]) == ['/a"b'] and doc["operations"] == 1
