"""Operators on documents: packing, leakage, languages."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import language, leakage, packing

needs_tokenizer = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_bounds_are_optimal(hist, k):
    from itertools import combinations

    size = np.array(sorted(hist))
    count = np.array([hist[s] for s in size])

    def pad(bounds):
        return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(size, count))

    got = packing.bucket_bounds(size, count, k)
    best = min(pad([*c, size[-1]]) for n in range(min(k, len(size))) for c in combinations(size[:-1], n))
    assert len(got) <= max(k, 1) and got[-1] == size[-1] and pad(got) == best


def test_bounds_of_many_sizes(monkeypatch):
    monkeypatch.setattr(packing, "MOST_SIZES", 100)
    size = np.arange(1, 1001)
    got = packing.bucket_bounds(size, np.ones(1000, np.int64), 20)
    assert len(got) == 20 and got[-1] == 1000 and np.searchsorted(got, size).max() == 19


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), min_size=1, max_size=12))
def test_patterns_use_all_counts(hist):
    bounds = np.array(sorted(hist))
    left = Counter(dict(enumerate(hist[b] for b in bounds)))
    for times, take in packing.batch_patterns(bounds, np.array([hist[b] for b in bounds]), 50):
        assert sum(bounds[b] * n for b, n in take) <= 50 and times > 0
        for b, n in take:
            left[b] -= times * n
    assert not any(left.values())


@needs_tokenizer
@pytest.mark.parametrize("across", [True, False])
def test_containers(spark, monkeypatch, across):
    monkeypatch.setattr(packing, "RANK_GROUP", 50)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "gamma"], k=rnd.randint(1, 300))), "x") for i in range(300)]
    rows += [(1000, None, ""), (1001, "", ""), (1002, "word " * 900, ""), (1003, "word " * 900, ""), (None, "null id", ""), (7, "again", ""), (7, "again", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    got = packing.containers(df, capacity=256, buckets=20, across=across)
    enc = packing.load_tokenizer()
    per = defaultdict(int)
    by = Counter()
    pieces = defaultdict(list)
    for r in got.collect():
        per[r["container"]] += r["tokens"]
        by[r["doc_id"]] += r["tokens"]
        pieces[r["doc_id"]].append((r["piece"], r["tokens"], r["container"]))
    want = Counter()
    for i, t, _ in rows:
        want[i] += len(enc.encode_ordinary(t)) if t else 0
    assert by == want and max(per.values()) <= 256
    assert sorted(per) == list(range(len(per)))
    assert all(len(p) == 1 for i, p in pieces.items() if want[i] <= 256 and i != 7)
    assert [p[:2] for p in sorted(pieces[1002])[:-1]] == [(k, 256) for k in range(len(pieces[1002]) - 1)]
    assert packing.containers(df.limit(0), capacity=256).count() == 0
    rep = packing.fill_report(got, 256).first()
    assert rep["overfull"] == 0 and rep["unused_share"] < (0.1 if across else 0.5)


def item_text(rnd, n=8):
    name = lambda: "".join(rnd.choices("bcdfgklmnprstvz", k=1) + rnd.choices("aeiou", k=1) + rnd.choices("klmnrst", k=1) + rnd.choices("aeiou", k=1) + rnd.choices("lnrst", k=1)).capitalize()
    return " ".join(f"According to {name()} {name()}, the {rnd.choice(('parser', 'crawler', 'reader'))} keeps {rnd.choice(('each list', 'the header', 'all links'))} in {rnd.randint(10, 9999)} of the runs." for _ in range(n))


def test_leaks_against_alignment_of_all_pairs(spark):
    rnd = random.Random(9)
    items = [(100 + i, item_text(rnd), None) for i in range(12)]
    docs, want = [], set()
    for d in range(60):
        base = item_text(rnd, 6).split()
        if d % 3 == 0:
            i = rnd.randrange(12)
            ws = items[i][1].split()
            n = len(ws)
            part = ws[: n // 2 + 4] if d % 2 else ws[n // 3 :]
            part = [w.upper() if rnd.random() < 0.1 else w for w in part]
            for _ in range(len(part) // 25):
                part[rnd.randrange(len(part))] = "édité"
            base = base[:20] + part + base[20:]
            want.add((d, items[i][0]))
        elif d % 3 == 1:
            i = rnd.randrange(12)
            base = base[:20] + items[i][1].split()[:15] + base[20:]
        docs.append((d, "\n".join(base) if d % 5 == 0 else " ".join(base), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "你好。", 1), (903, docs[0][1], 1), (904, "filler " * 50_000 + items[0][1], 1)]
    want |= {(903, i) for d, i in want if d == 0} | {(904, 100)}
    D = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    items += [items[0], (500, None, None), (501, "", None)]
    E = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(D, E).collect()}
    assert got == want
    assert leakage.leaks(D.limit(0), E).count() == 0 == leakage.leaks(D, E.limit(0)).count()


def test_leaks_of_popular_passages(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.choices(words, k=100))) for i in range(30)]
    docs, want = [], set()
    for d in range(1500):
        base = rnd.choices(words, k=150)
        if d % 2 == 0:
            i = d // 2 % 30
            part = items[i][1].split()[20:62]
            for at in (6, 15, 24, 33):
                part[at] = "edited"
            base[40:40] = part
            want.add((d, i))
        docs.append((d, " ".join(base)))
    D = spark.createDataFrame(docs, "doc_id bigint, text string")
    E = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(D, E).collect()} == want


def test_windows_of_an_item_in_a_third_of_the_documents():
    vocabulary = [f"w{i:03}" for i in range(160)]
    weights = np.where(np.arange(160) % 8 == 0, np.log(3) + 0.1, 0.0)
    basis = (weights / np.linalg.norm(weights))[:, None]
    space = leakage.Space([5], [" ".join(vocabulary)], vocabulary, weights, float(np.log(99_901) + 0.1), basis)
    doc = np.array([-1] * 30 + list(range(160)) + [-1] * 30, np.int32)
    assert space.candidates(doc, np.array([len(doc)])) == {(0, 0)}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 3)
    rnd = random.Random(4)
    items = [(i, item_text(rnd)) for i in range(7)]
    D = spark.createDataFrame([(i, t) for i, t in items], "doc_id bigint, text string")
    E = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(D, E).collect()} == {(i, i) for i in range(7)}


def test_recall_of_the_latent_space(spark):
    """Pairs that an alignment of every document with every item finds, among the candidates of truncated spaces."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    docs = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("text").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{d}/eval_items.parquet").where("text is not null").orderBy("item_id").collect()]
    words = [leakage.words_of(t) for t in texts]
    vocabulary = sorted({w for ws in words for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    numbers = leakage.Numbers(number)
    docs = [[numbers[w] for w in leakage._tokens(t)] for t in docs]
    df, held = Counter(x for t in docs for x in set(t)), Counter(w for ws in words for w in set(ws))
    stats = {w: (df[number[w]], held[w]) for w in vocabulary}
    weights = leakage.item_weights(words, vocabulary, stats, len(docs), len(texts))
    rows = [leakage._unit(p, weights) for ws in words for p in leakage.passages_of([number[w] for w in ws])]
    _, basis = leakage.randomised_svd(spark.createDataFrame(rows, "ix array<int>, val array<double>"), len(vocabulary), leakage.RANK)
    assert basis.shape[1] < len(rows) / 4
    recall, truth = {}, None
    flat, ends = np.array([x for t in docs for x in t], np.int32), np.cumsum([len(t) for t in docs])
    for rank in (64, 192, leakage.RANK):
        space = leakage.Space(list(range(len(texts))), texts, vocabulary, weights, float(np.log(len(docs) + 1) + 0.1), basis[:, :rank])
        if truth is None:
            truth = {(k, i) for k, t in enumerate(docs) if t for pairs in [space.shared_pairs(t)] for i in range(len(texts)) if space.verify(t, i, pairs)}
        recall[rank] = len(truth & space.candidates(flat, ends)) / len(truth)
    assert recall[leakage.RANK] >= 0.97 and recall[64] < recall[leakage.RANK], recall


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert leakage.lcs(a, b) == t[-1][-1]


def test_randomised_svd(spark):
    a = np.random.default_rng(0).normal(size=(9, 4)) @ np.random.default_rng(1).normal(size=(4, 30))
    rows = spark.createDataFrame([(i, list(range(30)), r.tolist()) for i, r in enumerate(a)], "item_id bigint, ix array<int>, val array<double>")
    s, v = leakage.randomised_svd(rows, 30, 4, tasks=3)
    assert np.allclose(a @ v @ v.T, a) and np.allclose(s, np.linalg.svd(a)[1][:4]) and np.allclose(v.T @ v, np.eye(4))
    assert leakage.randomised_svd(rows, 30, 9)[1].shape == (30, 4)
    assert leakage.answers("Q? (A) One two (B) Three") == ["one two", "three"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=5), st.text("abcd", max_size=8))
def test_cross_parsing_is_greedy_longest_match(words, text):
    a = language.Automaton(words)
    subs = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    n = at = 0
    while at < len(text):
        k = max((j for j in range(at + 1, len(text) + 1) if text[at:j] in subs), default=at + 1)
        n, at = n + 1, k
    assert a.phrases(text) == n


EN = ["The crawler reads every page in order.", "A parser keeps the list of links for each host.", "The cache stores all pages before the next run.", "Every reader checks the order of the list."]
DE = ["Der Sammler liest jede Seite in der richtigen Folge.", "Das Werkzeug bewahrt die Liste der Verweise für jeden Rechner.", "Der Speicher hält alle Seiten vor dem nächsten Lauf.", "Jeder Leser prüft die Folge der Liste."]
JA = ["表の解析器は文書の順番どおりに空の段落を数えます。", "リンク抽出器は更新のたびに転送の経路を集めます。"]


def test_languages(spark):
    rnd = random.Random(1)
    train = [(i, " ".join(rnd.choices(s, k=6)), lab) for i, (s, lab) in enumerate([(EN, "en"), (DE, "German"), (JA, "ja-JP")] * 40)]
    train += [(500 + i, " ".join(rnd.choices(EN, k=6)), "de") for i in range(5)]
    cases = [
        (1000, " ".join(EN), None), (1001, " ".join(EN), " EN-gb "), (1002, " ".join(EN), "deu"), (1003, " ".join(EN + DE[:2]), "en"), (1004, " ".join(EN + DE[:1]), "en"), (1005, "".join(JA), "und"), (1006, None, None), (1007, "", "en"), (1008, "  \n", None),
        (1009, EN[0] + ' The reader found "die Liste der Verweise" there.', "en"), (1010, "\n".join(EN) + "\nvar x = new Reader();\n", "English"), (1011, " ".join(EN * 2000), "eng"), (1000, " ".join(EN), None),
    ]
    df = spark.createDataFrame([(*r, 1.0) for r in train + cases], "doc_id bigint, text string, lang string, confidence double")
    got = {(r["doc_id"], r["lang"]) for r in language.mislabelled(df).collect() if r["doc_id"] >= 1000}
    assert got == {(1000, "en"), (1002, "en"), (1003, "en"), (1003, "de"), (1005, "ja")}
    assert {r["doc_id"] for r in language.mislabelled(df).collect() if r["doc_id"] < 1000} == {500 + i for i in range(5)}
    main = {r["doc_id"]: r for r in language.document_languages(df).collect()}
    assert main[1004]["lang"] == "en" and main[1004]["sentences"] == {"en": 4, "de": 1} and main[1006]["lang"] is None and 0 < main[1000]["confidence"] <= 1
    seg = [(r["segment"], r["lang"], r["sentences"]) for r in language.segments(df).where("doc_id = 1003").orderBy("segment").collect()]
    assert seg == [(0, "en", 4), (1, "de", 2)]
    assert language.mislabelled(df.limit(0)).count() == 0
    assert [language.language_code(x) for x in ("EN", "pt_BR", "Japanese", "zho", "xx", "", None, "??", "fi", "Korean", "und")] == ["en", "pt", "ja", "zh", None, None, None, None, "fi", "ko", None]


FI = ["Hakija lukee jokaisen sivun oikeassa järjestyksessä.", "Työkalu säilyttää linkkien luettelon jokaiselle palvelimelle.", "Välimuisti pitää kaikki sivut ennen seuraavaa ajoa.", "Jokainen lukija tarkistaa luettelon järjestyksen."]


def test_languages_are_those_of_the_labels(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(s, k=6)), lab) for i, (s, lab) in enumerate([(EN, "en"), (DE, "de")] * 300)]
    rows += [(1000 + i, " ".join(rnd.choices(FI, k=6)), "fi") for i in range(12)]
    rows += [(2000 + i, " ".join(rnd.choices(EN, k=6)), "tr") for i in range(12)] + [(3000, " ".join(FI), "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df)
    assert model.codes == ["de", "en", "fi"]
    got = {(r["doc_id"], r["lang"]) for r in language.mislabelled(df).collect()}
    assert got == {(2000 + i, "en") for i in range(12)} | {(3000, "fi")}


def test_samples_are_filled_or_told(spark):
    from pagemill.llm.samples import SHORTEST_ROWS, sample_groups, sample_rows

    df = spark.range(20_000).selectExpr("id", "repeat('x', if(id % 10 = 0, 30, 500)) as t", "if(id < 3, 'rare', if(id < 19000, 'a', 'b')) as g")
    assert len(sample_rows(df, "id", ["t"], "t", 1000, 100)) == 1000
    assert len(sample_rows(df, "id", ["t"], "t", 1000, 25)) == SHORTEST_ROWS
    assert len(sample_rows(df.limit(0), "id", ["t"], "t", 1000, 100)) == 0
    got = Counter(r["_g"] for r in sample_groups(df, "id", df["g"], ["t"], "t", 300, 1000))
    assert got == {"a": 100, "b": 100, "rare": 3}
