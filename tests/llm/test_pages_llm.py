"""Operators on cached pages: encoding, markup, main content, residue, repeated lines."""

import random
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.blocks import visible_blocks
from pagemill.llm import encoding, main_content, markup, residue, site_lines

CACHE = "page_id bigint, html string, byte_length int, url string"
PAGES = "page_id bigint, host string, url string, title string, status string"

CLEAN = [
    "Café résumé déjà vu, naïve façade: l’été à Paris. Ça va très bien, merci à tous les élèves.", "Größe und Länge müssen übereinstimmen; die Prüfung läuft täglich für alle Straßen.",
    "El niño comió piñas en la montaña mañana; ¿cuántos años? Así será según él.", "Обходчик карты сайта проверяет ответы сервера и удаляет пустые абзацы для каждого узла.",
    "Příliš žluťoučký kůň úpěl ďábelské ódy; čeština má háčky a čárky.", "表の解析器は文書の順番どおりに空の段落を数えます。", "表格解析器会统计重复的段落，直到队列为空。",
] * 6


@pytest.fixture(scope="module")
def repairer():
    return encoding.Repairer(encoding.BigramModel(CLEAN))


@pytest.mark.parametrize("text", CLEAN[:7])
def test_clean_text_is_left_alone(repairer, text):
    assert repairer.examine([text])[0] == 0 and repairer.repair(text) == text


@pytest.mark.parametrize("enc", ["cp1252", "cp437", "cp1250", "cp1251", "mac_roman", "latin-1"])
@pytest.mark.parametrize("text", CLEAN[:6])
def test_round_trip_of_misread_utf8(repairer, text, enc):
    raw, table = text.encode(), {b: c for c, b in encoding._to_bytes_table(enc).items()}
    bad = "".join(chr(b) if b < 128 else chr(table.get(b, b)) for b in raw)
    assert repairer.examine([bad])[0] > 0
    assert repairer.repair(bad) == text
    assert repairer.examine(["plain text", bad, "more"])[0] > 0


def test_code_pages_and_lost_text(repairer):
    bad = CLEAN[3].encode("cp1251").decode("latin-1")
    assert repairer.examine([bad])[0] > 0 and repairer.repair(bad) == CLEAN[3]
    assert repairer.examine(["r�sum�"])[0] > 0
    assert repairer.examine(["5 µs ± 3 % © 2024 – “x” €"])[0] == 0


@pytest.mark.parametrize("enc", ["cp932", "gb18030", "cp949", "big5", "euc_jp"])
def test_spans_under_multibyte_code_pages(repairer, enc):
    bad = CLEAN[1].encode().decode(enc, "replace")
    if "\ufffd" not in bad:
        assert repairer.repair(bad) == CLEAN[1]
    assert repairer.examine([bad])[0] > 0


def test_pages_are_repaired_as_they_are_found(repairer):
    bad = CLEAN[0].encode().decode("cp1252", "replace").replace("\ufffd", "x")
    refs = "".join(c if c < "\x80" else f"&#{ord(c)};" for c in bad)
    html = f"<title>{bad}</title><p title='{bad}'>{refs} &lt;b&gt;</p><pre>{bad}</pre><p>see <code>{bad}</code> <!-- {bad} --></p>"
    new = repairer.repair_page(html)
    assert new.count(bad) == 4 and "&#" not in new and "&lt;b&gt;" in new and new.count("Café") == 2
    assert not repairer.examine(visible_blocks(new.replace(f"<pre>{bad}</pre>", "").replace(f"<code>{bad}</code>", "")))[0]
    assert repairer.repair_page(new) == new and repairer.repair_page("<p>plain &amp; simple</p>") == "<p>plain &amp; simple</p>"


def test_one_run_alone(repairer):
    bad = CLEAN[6].encode("gb18030").decode("latin-1")
    run = "".join(c for c in bad if c > "\x80")[:16]
    assert repairer.examine([f"Title {run}"])[0] > 0 and repairer.examine(["Title ±§"])[0] == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_spans_never_fail_and_keep_ascii(text):
    r = encoding.Repairer(encoding.BigramModel(CLEAN))
    r.examine([text])
    out = r.repair(text)
    assert [c for c in out if c < "\x80"] == [c for c in text if c < "\x80"]


def test_garbled_pages(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(CLEAN)], "doc_id bigint, text string, page_id string")
    bad = CLEAN[0].encode().decode("cp1252", "replace").replace("�", "x")
    rows = [(1, f"<p>{CLEAN[0]}</p>", 0, ""), (2, f"<p>{bad}</p>", 0, ""), (3, f"<p>ok</p><code>{bad}</code>", 0, ""), (4, None, 0, ""), (5, "", 0, ""), (6, f"<title>{bad}</title>", 0, ""), (2, f"<p>{bad}</p>", 0, ""), (7, "<p>" + "é " * 100_000, 0, "")]
    df = spark.createDataFrame(rows, CACHE)
    assert {r["page_id"] for r in encoding.garbled_pages(df, docs).collect()} == {2, 6}
    fixed = {r["page_id"]: r for r in encoding.repaired_pages(df, docs).collect()}
    assert "Café" in fixed[2]["html"] and not fixed[1]["changed"] and fixed[4]["html"] is None
    assert encoding.garbled_pages(df.limit(0), docs).count() == 0
    assert encoding.garbled_pages(df, docs.limit(0)).count() >= 0


def test_bigrams_come_from_all_documents(spark):
    texts = [f"é{chr(0x4E00 + i)} façade {i}" for i in range(5000)] + ["долгий текст " * 2000, "ñu", "", None]
    model = encoding.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    pairs = Counter()
    for t in filter(None, texts):
        for run in encoding._RUN.findall(t):
            s = model._fold(run)
            pairs.update(s[i : i + 2] for i in range(len(s) - 1))
    assert set(model.two) == set(pairs) and model.common == {p for p, n in pairs.items() if n >= 2} and model.seen == {p[0] for p in pairs}
    whole = encoding.BigramModel([t for t in texts if t], scale=4000 / 5002)
    assert model.two == whole.two and model.floor == whole.floor and model.known("долгий")


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("a <b>x</b>", "html"), ("x &nbsp; y", "html"), ("&#8212;", "html"), ("<!-- c -->", "html"), ("## Head", "markdown"), ("a **b** c", "markdown"), ("[t](http://x)", "markdown"), ("```sh ls```", "markdown"),
        ("see [[Page|p]]", "wiki"), ("'''b'''", "wiki"), ("== H ==", "wiki"), ("{{cite web|a=b}}", "wiki"), ("__NOTOC__ x", "wiki"), (r"\emph{x}", "latex"), (r"$x_{1} \leq 2$", "latex"), (r"\begin{itemize} \item a", "latex"), (r"{\it x} y", "latex"),
        ("costs $5, or $12", ""), (r"C:\temp\new", ""), ("List<String> x", ""), ("a < b and c > d", ""), ("3 * 4 * 5", ""), ("{{ title }}", ""), ("max_depth_of_x", ""), ("Home | Blog | Docs", ""), ("C# and #12", ""), ("it's a 'quote'", ""), ("${name}", ""), ("[1] and [2]", ""), ("AT&T; R&D", ""), ("", ""),
    ],
)
def test_residue_kinds(text, kinds):
    assert markup.residue_kinds(text) == (tuple(kinds.split()) if kinds else ())


def test_clean_line():
    assert markup.clean_line("a <b>x</b> &amp; [t](u) **s** `c` $a_{1} = b$ [[P|q]] \\emph{e}") == "a x & t s `c` $a_{1} = b$ q e"
    assert markup.clean_line("plain") == "plain"


def test_markup_over_pages(spark):
    nav = "<div id=n><a href=/>Home {{cite web|x=1}}</a></div>"
    rows = [(i, f"<body>{nav}<h1>T{chr(97 + i)}</h1><ul><li>a{chr(97 + i)}<li>b{chr(97 + i)}</ul><pre>**no{chr(97 + i)}**</pre><p>text {chr(97 + i)}</p>", 0, "") for i in range(6)] + [(9, "<p>x **y** z</p>", 0, ""), (10, None, 0, ""), (11, "", 0, "")]
    pages = [(i, "h", f"u{i}", t, "") for i, t in ((0, "a **b**"), (1, None), (2, ""), (3, "ok"), (4, "x &amp; y"), (5, r"\title{x}"))] + [(0, "h", "u0", "a **b**", "")]
    c, p = spark.createDataFrame(rows, CACHE), spark.createDataFrame(pages, PAGES)
    got = {tuple(r) for r in markup.found(c, p).collect()}
    assert got == {(i, "html", "wiki") for i in range(6)} | {(9, "html", "markdown"), (0, "title", "markdown"), (4, "title", "html"), (5, "title", "latex")}
    text = {r["page_id"]: r["text"] for r in markup.clean_pages(c, p).collect()}
    assert text[2] == "# Tc\n- ac\n- bc\n```\n**noc**\n```\ntext c" and text[9] == "x y z" and text[10] == "" == text[11]
    assert {r["page_id"]: r["clean"] for r in markup.clean_titles(p).collect()}[0] == "a b"
    assert markup.found(c.limit(0), p.limit(0)).count() == 0


def test_subtrees_are_hashed_once():
    from time import perf_counter

    deep = "<div>" * 4000 + "x" + "</div>" * 4000
    at = perf_counter()
    assert len(markup.subtrees(deep)) == 4000 and perf_counter() - at < 0.5
    a, b = markup.subtrees("<div><p>Page 3</p><p>b</p></div>"), markup.subtrees("<ul><div>\n<p>Page  12</p> <p>b</p></div></ul>")
    assert [h for _, _, h in a] == [h for _, _, h in b][:3] and len({h for _, _, h in b}) == 4


def test_lines_know_the_subtrees_around_them():
    m = "<div><h2>Head</h2><ul><li>one<li>two <b>x</b></ul></div><table><tr><td>a<td>b<tr><td>c</table><pre>p <div>q</div></pre><p>end <math>x</math>"
    trees = markup.subtrees(m)
    name = lambda i: m[trees[i][0] :].split(">")[0][1:] if i >= 0 else ""
    got = [(t, name(i)) for t, i in markup.to_lines(m, trees)]
    assert got == [("## Head", "h2"), ("- one", "li"), ("- two x", "li"), ("| a | b", "tr"), ("| c", "tr"), ("```\np q\n```", "pre"), ("end $x$", "p")]
    place, last, hashes = markup.in_order(trees)
    tags = {place[i]: name(i) for i in range(len(trees))}
    assert [tags[k] for k in range(5)] == ["div", "h2", "ul", "li", "li"] and last[:5] == [4, 1, 4, 3, 4] and hashes[0] == trees[place.index(0)][2]
    assert markup.to_text(m) == "\n".join(t for t, _ in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "a", " b ", "<pre>", "</pre>", "<table>", "<tr>", "<td>", "</table>", "<math>", "</math>", "\x03", "**c**", "&amp;"]), max_size=25).map("".join))
def test_marks_leave_no_trace(m):
    m = markup._unmarked(m)
    trees = markup.subtrees(m)
    lines = markup.to_lines(m, trees)
    assert "\n".join(t for t, _ in lines) == markup.to_text(m)
    assert all(-1 <= i < len(trees) for _, i in lines)
    place, last, _ = markup.in_order(trees)
    for i, (a, b, _) in enumerate(trees):
        inside = {place[j] for j, (c, d, _) in enumerate(trees) if j != i and c >= a and d <= b and (c, d) != (a, b)}
        assert inside <= set(range(place[i], last[place[i]] + 1))


def test_own_text_of_an_address_fetched_often_is_no_template(spark):
    rows = [(i, f"<body><p>own text {i // 5 * 'x'}</p><div>menu</div>", 0, "") for i in range(30)]
    pages = [(i, "h", f"u{i // 5}", None, "") for i in range(30)]
    c, p = spark.createDataFrame(rows, CACHE), spark.createDataFrame(pages, PAGES)
    assert {r["text"] for r in markup.clean_pages(c, p).collect()} == {f"own text {k * 'x'}".strip() for k in range(6)}


def test_template_verdicts_match_page_by_page(spark):
    rnd = random.Random(8)
    bits = ["a **b** c", "plain | menu", "x &amp;amp; y", "[[Page]]", "text", r"\emph{x}", "# 3", "<code>**n**</code>"]
    rows, pages = [], []
    for i in range(150):
        shared = f"<nav><p>{bits[0] if i % 2 else bits[4]}</p></nav>"
        own = "".join(f"<div><p>{rnd.choice(bits)} {i}</p></div>" for _ in range(3))
        rows.append((i, f"<body>{shared}<section>{own}</section>", 0, ""))
        pages.append((i, "big" if i % 3 else f"h{i % 9}", f"u{i}", None, ""))
    c, p = spark.createDataFrame(rows, CACHE), spark.createDataFrame(pages, PAGES)
    want = {(i, k) for i, h, _, _ in rows for b in visible_blocks(h.replace("<code>**n**</code>", "")) for k in markup.residue_kinds(b)}
    assert {(r["page_id"], r["kind"]) for r in markup.found(c, p).collect()} == want


def page(i, words):
    body = "".join(f"<p>{' '.join(words.choices(WORDS, k=14)).capitalize()}.</p>" for _ in range(4))
    chrome = "<div id=menu>" + "".join(f"<li><a href=/{k}>{w}</a></li>" for k, w in enumerate(("Home", "Docs", "Blog", "About"))) + "</div>"
    side = "<div class=x1><h3>Related</h3><ul>" + "".join(f"<li><a href=/r>{' '.join(words.choices(WORDS, k=4))}</a></li>" for _ in range(3)) + "</ul></div>"
    consent = "<div class=x2><p>We use cookies.</p><div><button>Accept</button></div></div>"
    foot = f"<div id=ft><p>© {2000 + i % 20} Site. All rights reserved.</p><p>Privacy</p></div>"
    return f"<body>{chrome}<div class=z><h1>{' '.join(words.choices(WORDS, k=4))}</h1>{body}</div>{side}{consent}{foot}"


WORDS = "crawler parser stores reads page header table list order queue deep link value index cache record".split()


def test_field_on_held_out_pages(spark):
    rnd = random.Random(5)
    field = main_content.train([page(i, rnd) for i in range(150)], epochs=6)
    lab = main_content.Labeller(field)
    right = total = 0
    for i in range(60):
        html = page(i, rnd).replace("id=menu", "class=q7").replace("id=ft", "class=q8")
        want = ["menu"] * 4 + ["main"] * 5 + ["sidebar"] * 4 + ["consent"] * 2 + ["footer"] * 2
        got = [main_content.ROLES[r] for _, r in lab.pages([html])[0]]
        right += sum((a == "main") == (b == "main") for a, b in zip(want, got))
        total += len(want)
        assert [t for t, _ in lab.pages([html])[0]] == visible_blocks(html)
    assert right / total > 0.95


def test_boxes_count_what_stands_below_them():
    rnd = random.Random(9)
    tags = ["<div>", "</div>", "<nav>", "</nav>", "<ul>", "<li>", "</ul>", "<h1>", "</h1>", "<h3>", "</h3>", "<button>", "</button>", "<a>", "</a>", "<p>", "Word", "A sentence that is long enough to be counted as one."]
    for _ in range(300):
        page = main_content.leaves("".join(rnd.choices(tags, k=40)))
        below = defaultdict(list)
        for x in page:
            b = x.box
            while b is not None:
                below[b].append(x)
                b = b.parent
        for b, xs in below.items():
            assert (b.n, b.links, b.prose) == (len(xs), sum(x.link > 0.5 for x in xs), sum(main_content._sentence(x.text) for x in xs))


def test_parsing_takes_as_long_as_the_page_however_deep():
    def lines(depth):
        n = 0

        def trace(frame, event, _):
            nonlocal n
            n += event == "line" and frame.f_code.co_filename == main_content.__file__
            return trace

        old = sys.gettrace()
        sys.settrace(trace)
        try:
            assert len(main_content.leaves("<div>text" * depth)) == depth
        finally:
            sys.settrace(old)
        return n

    assert lines(800) < 2.2 * lines(400)


def test_viterbi_is_exact():
    import numpy as np

    rnd = np.random.default_rng(1)
    k = len(main_content.ROLES)
    f = main_content.Field(np.zeros((2, k)), rnd.normal(size=(k, k)))
    lengths = [3, 0, 1, 4]
    s = rnd.normal(size=(8, k))
    got = f.decode(s, lengths)
    at = 0
    from itertools import product

    for n in lengths:
        best = max(product(range(k), repeat=n), key=lambda p: sum(s[at + i, r] for i, r in enumerate(p)) + sum(f.moves[a, b] for a, b in zip(p, p[1:]))) if n else ()
        assert tuple(got[at : at + n]) == best
        at += n


def test_main_content_cases(spark):
    rnd = random.Random(7)
    rows = [(i, page(i, rnd), 0, "") for i in range(80)] + [(100, None, 0, ""), (101, "", 0, ""), (102, page(1, rnd).replace("<h1>", "<p>Privacy</p><h1>"), 0, ""), (103, page(2, rnd).replace("</h1>", "</h1><p>" + "Long text of words. " * 20_000 + "</p>"), 0, "")]
    df = spark.createDataFrame(rows, CACHE)
    got = defaultdict(set)
    for r in main_content.chrome_blocks(df).collect():
        got[r["page_id"]].add(r["block_crc"])
    crc = lambda t: zlib.crc32(t.encode())
    assert crc("Home") in got[3] and crc("Accept") in got[3] and crc("Privacy") in got[3] and crc("Privacy") not in got[102]
    assert not {100, 101} & set(got) and len(got[103]) == len(got[3])
    text = {r["page_id"]: r["text"] for r in main_content.main_text(df).collect()}
    assert text[100] == "" and "Accept" not in text[5] and len(text[5].split("\n")) == 5
    assert main_content.chrome_blocks(df.limit(0)).count() == 0


def test_residue_pages(spark):
    rnd = random.Random(3)
    ok = "".join(f"<p>{' '.join(rnd.choices(WORDS, k=14)).capitalize()}.</p>" for _ in range(3))
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(WORDS, k=60)) + ". Some pages require a browser.") for i in range(200)], "doc_id bigint, text string")
    wrap = lambda b, t="T": f"<head><title>{t}</title></head><body><main>{b}</main>"
    rows = [
        (1, wrap("<h1>404</h1><p>The page you requested could not be found.</p>")), (2, wrap("<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit.</p><p>Ut enim ad minim veniam, quis nostrud exercitation.</p>")),
        (3, wrap("", "App").replace("<main>", "<noscript>You need to enable JavaScript to run this app.</noscript><main>")), (4, wrap(f"<h1>Hi {{{{ user.name }}}}</h1>{ok}")), (5, wrap(ok)), (6, wrap(ok + "<p>The message “Page not found” was counted 3 times by the crawler in this list of pages.</p>")),
        (7, wrap(f"<noscript>Please enable JavaScript.</noscript><h1>Head</h1>{ok}")), (8, wrap(f"{ok}<code>{{{{ x }}}}</code>")), (9, None), (10, ""), (11, wrap(ok, "${title}")), (12, wrap(f"<p>Total: NaN of undefined rows</p>{ok}")), (5, wrap(ok)), (13, wrap("<p>" + "word " * 60_000)),
    ]
    df = spark.createDataFrame([(i, h, 0, "") for i, h in rows], CACHE)
    got = {(r["page_id"], r["kind"]) for r in residue.residue_pages(df, docs).collect()}
    assert got == {(1, "error"), (2, "filler"), (3, "script"), (4, "placeholder"), (11, "placeholder"), (12, "placeholder")}
    assert residue.residue_pages(df.limit(0), docs).count() == 0
    assert {r["page_id"] for r in residue.without_residue(df, docs).collect()} == {5, 6, 7, 8, 9, 10, 13}


def test_residue_models_come_from_all_documents(spark):
    import numpy as np

    texts = [f"the crawler reads page {WORDS[i % 16]} {chr(0x4E00 + i)}" for i in range(4500)] + ["a longer guide 12 " * 40_000, "kurz", "ab", "", None]
    ratios, letters = residue.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    counts = np.zeros(residue.SLOTS)
    for t in filter(None, texts):
        np.add.at(counts, residue._hashes(t), 1)
    seeds = {k: v.strip().split("\n") for k, v in (("error", residue.ERROR_SEEDS), ("script", residue.SCRIPT_SEEDS), ("filler", residue.FILLER_SEEDS))}
    assert (ratios.table == residue.Ratios(counts * (4000 / 4503), seeds).table).all() and letters.seen >= {chr(0x4E00 + i) for i in range(4500)}
    # However many documents there are, the seeds of prose weigh what they weigh beside 4,000.
    many = residue.fit(spark.range(40_000).selectExpr("id as doc_id", "'the crawler reads every page in order' as text"))[0]
    assert np.allclose(many.table, residue.Ratios(["the crawler reads every page in order"] * 4000, seeds).table, atol=1e-5)


def test_field_of_residue_comes_from_all_pages(spark, monkeypatch):
    rnd = random.Random(6)
    long = page(0, rnd) + "".join(f"<p>zyzzyva {'x' * 30}{i}</p>" for i in range(6000))
    df = spark.createDataFrame([(i, page(i, rnd), 0, "") for i in range(120)] + [(500, long, 0, ""), (501, None, 0, ""), (502, "", 0, ""), (3, page(3, rnd), 0, "")], CACHE)
    field = residue.fit_field(df)
    assert field.weights[main_content._slot("w:zyzzyva")].any()
    assert (field.weights == residue.fit_field(df.repartition(3)).weights).all()
    monkeypatch.setattr(main_content, "VISITS", 1200)  # two groups, whose fields are averaged
    many = spark.createDataFrame([(i, page(i, rnd), 0, "") for i in range(2600)], CACHE)
    lab, right, total = main_content.Labeller(residue.fit_field(many)), 0, 0
    for i in range(40):
        got = [main_content.ROLES[r] == "main" for _, r in lab.pages([page(i, rnd)])[0]]
        right += sum(a == b for a, b in zip(got, [False] * 4 + [True] * 5 + [False] * 8))
        total += len(got)
    assert right / total > 0.95
    assert not residue.fit_field(df.limit(0)).weights.any()


@pytest.mark.parametrize("body, kind", [("<noscript>You need to enable JavaScript to run this app.</noscript>", "script"), ("<p>Not found</p>", "error"), ("<p>Bad gateway</p>", "error"), ("<p>Lorem ipsum</p>", "filler"), ("<p>Deep list</p>", None)])
def test_residue_under_much_chrome(body, kind):
    rnd = random.Random(3)
    prose = [" ".join(rnd.choices(WORDS, k=60)) for _ in range(200)]
    seeds = {k: v.strip().split("\n") for k, v in (("error", residue.ERROR_SEEDS), ("script", residue.SCRIPT_SEEDS), ("filler", residue.FILLER_SEEDS))}
    main = body[3:-4] if body.startswith("<p>") else ""

    class Roles:
        def pages(self, htmls):
            return [[(main, residue.MAIN)] if main else [] for _ in htmls]

    judge = residue.Judge(residue.Ratios(prose, seeds), Roles(), encoding.Repairer(encoding.BigramModel(prose)))
    menu = "".join(f"<li>{' '.join(rnd.choices(WORDS, k=3))}</li>" for _ in range(60))
    assert judge.kinds([f"<body><ul>{menu}</ul>{body}"]) == [kind]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["page not found", "lorem ipsum dolor", "javascript", "the crawler reads", "é 12", "x", "服务暂时不可用"]), max_size=8).map(" ".join), max_size=12))
def test_blocks_judged_together_as_alone(texts):
    r = residue.Ratios(["the crawler reads every page in order"] * 20, {k: v.strip().split("\n") for k, v in (("error", residue.ERROR_SEEDS), ("script", residue.SCRIPT_SEEDS), ("filler", residue.FILLER_SEEDS))})
    for (k, x), t in zip(r.many(texts), texts):
        a, b = r.windows(t)
        assert (k, round(x, 6)) == (a, round(b, 6))


@pytest.mark.parametrize("t", ["{{ a.b }}", "${x}", "%PAGE_TITLE%", "[Insert title here]", "<<NAME>>", "{% block x %}", "[object Object]", "{0} of {1} items", "#{a.b}", "undefined | undefined"])
def test_placeholders(t):
    assert residue.placeholders("x " + t)


@pytest.mark.parametrize("t", ["{{cite web|a=b}}", "costs 5 %", "$x_{1}$", r"\emph{x}", "a << b", "an undefined behaviour", "[1]", "100% sure", r"\begin{x}", "{a: 1}"])
def test_no_placeholders(t):
    assert not residue.placeholders(t)


def brute_lines(cache, pages):
    where = {}
    for pid, host, url, *_ in pages:
        if host is not None and url is not None and pid is not None:
            where[pid] = min(where.get(pid, (host, url)), (host, url))
    urls, lines, rows = defaultdict(set), defaultdict(set), []
    for pid, html, *_ in cache:
        if pid in where:
            host, url = where[pid]
            urls[host].add(url)
            for b in visible_blocks(html):
                n = site_lines.normal_line(b)
                lines[host, n].add(url)
                rows.append((pid, host, n, zlib.crc32(b.encode())))
    return {(p, c) for p, h, n, c in rows if len(lines[h, n]) >= max(4, 0.2 * len(urls[h]))}


def test_repeated_lines_match_brute_force(spark):
    rnd = random.Random(11)
    cache, pages = [], []
    for i in range(120):
        host = rnd.choice("aaab") + ".example"
        pages.append((i, host, f"https://{host}/{rnd.randint(0, 60)}", None, ""))
        parts = [rnd.choice(("Share this", "SHARE  this", "Page 12 of 40", "page 3 of 9", "By A", "Légal §1", f"only {i} x", "rare line")) for _ in range(5)]
        cache.append((i, "".join(f"<p>{x}</p>" for x in parts), 0, ""))
    pages += pages[:5] + [(500, None, "u", None, ""), (501, "z", None, None, "")]
    cache += [(500, "<p>Share this</p>", 0, ""), (600, "<p>Share this</p>", 0, ""), (601, None, 0, ""), (602, "", 0, "")]
    c, p = spark.createDataFrame(cache, CACHE), spark.createDataFrame(pages, PAGES)
    got = [tuple(r) for r in site_lines.found(c, p).collect()]
    assert set(got) == brute_lines(cache, pages) and len(got) == len(set(got)) and got
    clean = {r["page_id"]: r for r in site_lines.without_repeated(c, p).collect()}
    assert len(clean) == len(cache) and clean[601]["text"] == "" and clean[600]["text"] == "Share this"
    assert site_lines.found(c.limit(0), p).count() == 0 == site_lines.found(c, p.limit(0)).count()


def test_template_trees_merge():
    a, b = "By Jo #".split(), "By Al #".split()
    assert site_lines.merge_template(site_lines.merge_template(None, a), b) == ["By", "<*>", "#"]
    assert site_lines.template_path("page # of #") == (4, "page", "<*>", "of")


@pytest.mark.parametrize("rows", [100_000, 7])
def test_templates_and_hot_hosts_match_brute_force(spark, monkeypatch, rows):
    from pagemill.operators import hot

    monkeypatch.setattr(hot, "HOT_ROWS", rows)
    rnd = random.Random(12)
    cache, pages = [], []
    for i in range(90):
        host = "big" if i % 3 else f"h{i % 6}"
        pages.append((i, host, f"u{rnd.randint(0, 50)}", None, ""))
        cache.append((i, f"<p>Written on {i} March by {rnd.choice(WORDS)}</p><p>Share this</p><p>{' '.join(rnd.choices(WORDS, k=3))}</p>", 0, ""))
    c, p = spark.createDataFrame(cache, CACHE), spark.createDataFrame(pages, PAGES)
    got = {tuple(r) for r in site_lines.templates(c, p).collect()}
    by, urls = defaultdict(set), defaultdict(set)
    where = defaultdict(set)
    for (i, host, url, *_), (_, html, *_) in zip(pages, cache):
        urls[host].add(url)
        for b in visible_blocks(html):
            n = site_lines.normal_line(b)
            by[host, site_lines.template_path(n)].add(n)
            where[host, site_lines.template_path(n)].add(url)
    want = set()
    for (host, path), lines in by.items():
        if len(where[host, path]) >= max(4, 0.2 * len(urls[host])):
            t = None
            for n in sorted(lines):
                t = site_lines.merge_template(t, n.split(" "))
            want.add((host, " ".join(t), len(lines), len(where[host, path])))
    assert got == want and any("<*>" in t for _, t, _, _ in got)
    assert {tuple(r) for r in site_lines.found(c, p).collect()} == brute_lines(cache, pages)
    assert markup.clean_pages(c, p).count() == 90


def test_declared_charsets(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN)], "doc_id bigint, text string")
    bad = CLEAN[0].encode().decode("cp1252", "replace").replace("\ufffd", "x")
    c = spark.createDataFrame([(i, f"<p>{bad}</p>") for i in (1, 2, 3)], "page_id bigint, html string")
    p = spark.createDataFrame([(1, "text/html; charset=Windows-1252"), (2, None), (3, "text/html;charset=utf-8"), (1, None)], "page_id bigint, content_type string")
    got = {r["page_id"]: (r["declared"], r["told"]) for r in encoding.declared_charsets(c, docs, p).collect()}
    assert got == {1: ("windows-1252", True), 2: (None, None), 3: ("utf-8", False)}
