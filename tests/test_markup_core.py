"""Tree builder, selectors, blocks, text."""

import pytest

from pagemill.functions import blocks, css, dom, text


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<ul><li>a<li>b</ul>c", "<ul><li>a</li><li>b</li></ul>c"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"),
        ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
        ("<b>x<p>y</p></b>", "<b>x<p>y</p></b>"),
        ("<script>if(a<b)'</p>'</script>z", "<script>if(a<b)'</p>'</script>z"),
        ("<p>a<div>b</div>", "<p>a</p><div>b</div>"),
        ("<a href=x>1<a href=y>2", '<a href="x">1</a><a href="y">2</a>'),
        ("a &lt; b &amp; &eacute;", "a &lt; b &amp; é"),
        ("<img alt='a>b'><br/>", '<img alt="a>b"><br>'),
        ("", ""),
    ],
)
def test_tree(html, want):
    assert dom.serialise(dom.parse(html)) == want


def test_labels_and_null():
    r = dom.parse("<div><p>a<b>c</b></p><i>d</i></div>")
    div, p, b, i = r.first("div"), r.first("p"), r.first("b"), r.first("i")
    assert b.within(p) and b.within(div) and not i.within(p)
    assert dom.parse(None).children == []


PAGE = '<div id=m class="x y"><ul><li class=a>1</li><li>2</li><li class="a b" data-k="K1">3 <a href="/u">l</a></li></ul><p>t</p></div><p lang=en-GB>q</p>'


@pytest.mark.parametrize(
    ("sel", "n"),
    [("li", 3), ("ul > li.a", 2), ("#m li", 3), ("li + li", 2), ("li ~ li", 2), ("li:nth-child(odd)", 2), ("li:not(.a)", 1), ("[data-k]", 1), ("[data-k='k1' i]", 1), ("[lang|=en]", 1), ("p, a", 3), ("li:last-child a", 1), ("div > p", 1), ("li:has(a)", 1), ("[class~=y]", 1), ("a[href^='/']", 1), ("*", 8)],
)
def test_selectors(sel, n):
    assert len(css.select(dom.parse(PAGE), sel)) == n


@pytest.mark.parametrize("bad", ["", "li >", "> li", "li[", "a::b:nope(", ":unheard"])
def test_bad_selectors(bad):
    with pytest.raises(css.SelectorError):
        css.select(dom.parse(PAGE), bad)


def test_value_selectors_and_sheets():
    assert css.split_value_selector("li a::attr(href)") == ("li a", "attr", "href")
    assert css.split_value_selector("li > ::text") == ("li *", "text", "")
    with pytest.raises(css.SelectorError):
        css.split_value_selector("a, b::text")
    r = css.rules("/*x*/@media print{a{color:red}} p{margin:0 !important;--v:1;background:url(a.png)}")
    assert [x["condition"] for x in r] == ["@media print", ""] and r[1]["declarations"][0] == ("margin", "0", True)
    assert css.urls("@import 'a.css'; p{b:url( 'x.png' )}") == ["a.css", "x.png"]
    assert css.specificity("#a .b[c] d") == (1, 2, 1)


def test_blocks():
    html = "<head><title>T</title></head><body><p>a<b>b</b> c<br>d<!-- x -->e</p><script>no</script><p>&lt;b&gt; &nbsp; x</p><template>no</template><p> \xa0 </p><noscript>no</noscript><td>z"
    assert blocks.visible_blocks(html) == ["ab c", "de", "<b> x", "z"]
    assert blocks.title_text(html) == "T"
    assert blocks.visible_blocks(None) == [] == blocks.visible_blocks("")
    assert blocks.split_blocks(blocks.without_code("a<code>x</code>b<pre>y</pre>c")) == ["a b", "c"]
    big = "<p>" + "w " * 200_000
    assert len(blocks.visible_blocks(big)[0]) == 399_999


def test_text():
    r = dom.parse("<div>a<p>b</p>c <i>d</i>e<pre> x\n  y</pre><br>f</div>")
    assert text.fragment_text(r) == "a b c de x y f"
    assert text.fragment_lines(r).split("\n")[:3] == ["a", "b", "c de"] and "  y" in text.fragment_lines(r)
    md = text.markdown(dom.parse("<h2>T</h2><p>a <b>b</b> <a href='/x'>l</a></p><ol><li>1<li>2</ol><pre><code class=language-js>x</code></pre><table><tr><th>h<tr><td>v</table>"), "https://e.org/")
    assert md == "## T\n\na **b** [l](https://e.org/x)\n\n1. 1\n2. 2\n\n```js\nx\n```\n\n| h |\n| --- |\n| v |"
    page = "<title>t</title><nav>" + "<a href=x>menu</a> " * 20 + "</nav><article><h1>Head</h1><p>" + "word " * 40 + "</p></article><div class=cookie>we use cookies</div>"
    got = text.readable(dom.parse(page))
    assert got["title"] == "Head" and got["selector"] == "article" and "menu" not in got["text"] and got["words"] == 41
