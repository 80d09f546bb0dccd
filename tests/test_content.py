"""Content selection, page records and redaction on odd pages."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.dom import parse
from pagemill.functions.redact import has_sensitive_query, redact_structured, redact_url, sensitive_name
from pagemill.operators import content as K

PAGES = [(1, None, "a"), (2, "", "b"), (3, "  ", "c"), (4, "<p>x", "d"), (5, "<div>" * 3000 + "deep", "e"), (6, "<article><p>" + "word " * 100_000, "f"), (4, "<p>x", "d")]


def test_every_operator_on_odd_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, html string, mode string")
    for mode in K.MODES:
        got = K.content_selection(df, mode)
        assert got.count() == len(PAGES) and got.where("reason_code = 'None'").count() == 3
    assert K.content_comparison(df).count() == 12 and K.content_winners(df).count() == 4
    assert K.page_reader(df).count() == 5 and K.dataset_chunks(df).where("page_id = 6").count() == 286
    for f in (K.content_selection, K.content_comparison, K.content_winners, K.page_reader, K.dataset_chunks):
        assert f(df.limit(0)).count() == 0


def test_measures_match_a_count_of_each_subtree():
    root = parse("<div>on<b>e</b> two<p>three <a href=x>fo</a>ur</p>five<ul><li>six<li><a href=y>seven 8</a></ul></div><p>ni<i>ne</i></p>")
    m = K.Measures(root)
    for n in root.elements():
        assert m.words(n) == K.count_words(n.text()), n.tag
        assert m.linked(n) == sum(K.count_words(a.text()) for a in n.elements("a"))
        assert m.count(n, "li") == sum(1 for _ in n.elements("li"))


@settings(max_examples=200, deadline=None)
@given(st.text("ab=&?#/:@%3Dtoken_ -", max_size=40))
def test_redaction_hides_and_repeats(u):
    once = redact_url(u)
    assert redact_url(once).count("<redacted>") >= once.count("<redacted>") - 1
    redact_structured(u)
    has_sensitive_query(u)


def test_sensitive_names():
    assert all(map(sensitive_name, ("token", "access_token", "myToken", "X-API_KEY", "session-id", "userPassword")))
    assert not any(map(sensitive_name, ("monkey", "author", "tokens", "codebook", "page", "pinned", "")))
