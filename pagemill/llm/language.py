"""Language of documents and of their segments by cross-parsing (problem 10).

Suffix automata of labelled text, one per language, give the longest match from any place of
a text. Parsing a text greedily into longest matches cuts it into phrases; the language that
needs fewest phrases for the text's length wins. Parsing starts anew at each word, so a word
form is parsed once and its phrase counts are looked up from then on; scripts without spaces
are parsed by whole runs. Languages are those the labels of the data name. Labels of the training
text may be wrong: word profiles of all labels, a document's own words left out of its own, first
drop each sentence that its label explains worse than another, and each language with too few left.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.llm.samples import sample_groups

#: Two-letter codes of ISO 639-1. Any of them can be a label; a language is told if enough text of the sample bears it out.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it "
    "iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm "
    "sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
#: Three-letter codes and English names of common languages.
LANGUAGES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "es": ("spa", "spanish"), "fr": ("fra", "fre", "french"),
    "ru": ("rus", "russian"), "pl": ("pol", "polish"), "cs": ("ces", "cze", "czech"), "it": ("ita", "italian"),
    "uk": ("ukr", "ukrainian"), "pt": ("por", "portuguese"), "zh": ("zho", "chi", "chinese"), "sv": ("swe", "swedish"),
    "nl": ("nld", "dut", "dutch"), "ja": ("jpn", "japanese"), "fi": ("fin", "finnish"), "tr": ("tur", "turkish"), "ar": ("ara", "arabic"),
    "ko": ("kor", "korean"), "da": ("dan", "danish"), "no": ("nor", "norwegian"), "hu": ("hun", "hungarian"), "ro": ("ron", "rum", "romanian"),
    "el": ("ell", "gre", "greek"), "he": ("heb", "hebrew"), "hi": ("hin", "hindi"), "th": ("tha", "thai"), "vi": ("vie", "vietnamese"),
    "id": ("ind", "indonesian"), "bg": ("bul", "bulgarian"), "hr": ("hrv", "croatian"), "sk": ("slk", "slo", "slovak"), "sl": ("slv", "slovenian"),
    "lt": ("lit", "lithuanian"), "lv": ("lav", "latvian"), "et": ("est", "estonian"), "fa": ("fas", "per", "persian"), "ca": ("cat", "catalan"), "sr": ("srp", "serbian"),
}
_NAME = {c: c for c in CODES} | {n: k for k, names in LANGUAGES.items() for n in names}

#: Word forms per language that go into its automaton, most frequent first, and characters of unspaced text. Bounds of the model.
MAX_WORDS = 3000
MAX_RUN_CHARS = 20_000
#: A language of the sample is told apart if so many documents bear it and so large a share of their sentences is explained best by the other documents of its label.
LEAST_DOCS = 4
LEAST_AGREEING = 0.5
#: Pseudo-count of a word in a language's profile.
SMOOTHING = 0.3
#: A full sentence has so many words, or characters of an unspaced script.
FULL_WORDS = 3
FULL_CHARS = 6
#: Phrases by which another language must beat the document's main language in a sentence.
MARGIN = 1.5
#: A capitalised word that takes so many phrases in every language is a name and doesn't count.
NAME_PHRASES = 2
#: Phrases per word (per character of unspaced script) beyond which a sentence is in no known language.
STRANGE_WORD = 1.9
STRANGE_CHAR = 0.7

_CJK = "぀-ヿ㐀-䶿一-鿿々ー"
_TOKEN = re.compile(rf"[{_CJK}]+|[^\W\d_{_CJK}]+|[。！？]+|[.!?…]+(?=[\s\"”’»)\]]|$)|\n+")
#: A short quotation: foreign words in it say nothing of the text around it.
_QUOTED = re.compile(r"\"[^\"\n.!?]{1,80}\"|“[^”\n.!?]{1,80}”|«[^»\n.!?]{1,80}»|„[^“”\n.!?]{1,80}[“”]|‘[^’\n.!?]{1,80}’(?!\w)")
_IS_CJK = re.compile(f"[{_CJK}]")


def language_code(label: str | None) -> str | None:
    """Two-letter code of a label in any usual spelling (case, region, three letters or English name of a common language); None if it is no language."""
    if not label:
        return None
    return _NAME.get(re.split(r"[-_]", label.strip().lower())[0])


class Automaton:
    """Suffix automaton of a set of strings, as one transition table ``state << 21 | character -> state``."""

    def __init__(self, strings):
        nxt: list[dict] = [{}]
        link, length = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                p = last
                if c in nxt[p]:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        last = q
                        continue
                    last = self._clone(nxt, link, length, p, c, q)
                    continue
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[p] + 1)
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(nxt, link, length, p, c, q)
                last = cur
        self.moves = {s << 21 | ord(c): t for s, d in enumerate(nxt) for c, t in d.items()}
        self.alphabet = frozenset(nxt[0])

    @staticmethod
    def _clone(nxt, link, length, p, c, q) -> int:
        n = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = n
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = n
            p = link[p]
        return n

    def phrases(self, text: str) -> int:
        """Number of longest matches into which ``text`` is cut; an unseen character is a phrase of its own."""
        moves, state, n = self.moves, 0, 0
        for c in text:
            o = ord(c)
            t = moves.get(state << 21 | o)
            if t is None:
                n += state > 0
                t = moves.get(o)
                if t is None:
                    n += 1
                    t = 0
            state = t
        return n + (state > 0)


def _mark(word: str) -> str:
    return word if _IS_CJK.match(word) else "^" + word.lower() + "$"


def sentences(text: str) -> list[tuple[list[str], bool]]:
    """(words, ended by a full stop) of each sentence or line."""
    out: list[tuple[list[str], bool]] = []
    words: list[str] = []
    for t in _TOKEN.findall(text):
        if t[0] in ".!?…。！？\n":
            if words:
                out.append((words, t[0] != "\n"))
                words = []
        else:
            words.append(t)
    if words:
        out.append((words, False))
    return out


class Model:
    """Automata of all languages the labelled rows bear out, fitted on (label, text) rows.

    ``sizes`` tells how many rows of the table bear each language's label, where the rows are a sample.
    """

    def __init__(self, rows, sizes: dict[str, int] | None = None):
        by: dict[str, list[list[list[str]]]] = defaultdict(list)
        for label, text in rows:
            code = language_code(label)
            if code and text:
                doc = [w for w, _ in sentences(text) if len(w) > 2 or _IS_CJK.match(w[0])]
                if doc:
                    by[code].append(doc)
        kept = self._agreeing({c: by[c] for c in sorted(by)}, sizes or {})
        self.codes = sorted(kept)
        self.automata = []
        for code in self.codes:
            words: Counter = Counter()
            runs, size = [], 0
            for s in kept[code]:
                for w in s:
                    if not _IS_CJK.match(w):
                        words[_mark(w)] += 1
                    elif size < MAX_RUN_CHARS:
                        runs.append(w)
                        size += len(w)
            common = [w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:MAX_WORDS] if n > 1]
            self.automata.append(Automaton(common + list(dict.fromkeys(runs))))

    @staticmethod
    def _agreeing(by: dict[str, list[list[list[str]]]], sizes: dict[str, int]) -> dict[str, list[list[str]]]:
        """Per language the sentences that the other documents of their label explain best; languages with too few are left out."""
        numbers: dict[str, int] = {}

        def units(s: list[str]) -> list[int]:
            us = [u for w in s for u in ([w[i : i + 2] for i in range(len(w))] if _IS_CJK.match(w) else [w.lower()])]
            return [numbers.setdefault(u, len(numbers)) for u in us]

        docs = [(k, [(s, np.array(units(s))) for s in d]) for k, c in enumerate(by) for d in by[c]]
        counts = np.zeros((len(numbers), len(by)))
        for k, d in docs:
            np.add.at(counts[:, k], np.concatenate([u for _, u in d]), 1)
        total = counts.sum(0) + SMOOTHING * len(numbers)
        logs = np.log(counts + SMOOTHING)
        # Where two labels explain a sentence alike, the one that more documents bear is the language's name.
        prior = np.log([max(1, sizes.get(c, len(d))) for c, d in by.items()])
        out: dict[str, list] = {c: [] for c in by}
        seen = Counter()
        codes = list(by)
        for k, d in docs:
            mine = np.concatenate([u for _, u in d])
            at, n = np.unique(mine, return_counts=True)
            own = dict(zip(at.tolist(), np.log(counts[at, k] - n + SMOOTHING).tolist()))
            size = total[k] - len(mine)
            for s, u in d:
                v = prior + logs[u].sum(0) - len(u) * np.log(total)
                v[k] = prior[k] + sum(map(own.__getitem__, u.tolist())) - len(u) * log(size)
                seen[codes[k]] += 1
                if v[k] >= v.max() - 1e-9:
                    out[codes[k]].append(s)
        return {c: x for c, x in out.items() if len(by[c]) >= LEAST_DOCS and len(x) >= LEAST_AGREEING * seen[c]}


class Identifier:
    """Assigns languages to whole batches of texts; one per task."""

    def __init__(self, model: Model):
        self.model, self.k = model, len(model.codes)
        self._reset()

    def _reset(self) -> None:
        #: word -> row; rows 0 and 1 are the end of a full sentence and of a line.
        self.rows: dict[str, int] = {}
        self.vectors = np.zeros((1 << 14, self.k + 2), np.float32)
        self.used = 2

    def _row(self, token: str) -> int:
        if token[0] in ".!?…。！？\n":
            n = 1 if token[0] == "\n" else 0
        else:
            if self.used == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            n, marked = self.used, _mark(token)
            cjk = marked is token
            chars = frozenset(marked)
            for i, a in enumerate(self.model.automata):
                inner = len(marked) if cjk else len(marked) - 1
                self.vectors[n, i] = a.phrases(marked) if len(chars & a.alphabet) > (0 if cjk else 2) else inner
            if not cjk and token[0].isupper() and self.vectors[n, : self.k].min() >= NAME_PHRASES:
                self.vectors[n, : self.k] = 0
            else:
                self.vectors[n, self.k] = 0 if cjk else 1
            self.vectors[n, self.k + 1] = len(token) if cjk else 0
            self.used += 1
        self.rows[token] = n
        return n

    def judge(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per text: full sentences by language, phrases by language over all text, and words."""
        if self.used > 400_000:
            self._reset()
        ids: list[int] = []
        ends = np.empty(len(texts), np.int64)
        rows, row = self.rows, self._row
        for i, t in enumerate(texts):
            if t:
                if '"' in t or "“" in t or "«" in t or "„" in t or "‘" in t:
                    t = _QUOTED.sub(" ", t)
                tokens = _TOKEN.findall(t)
                try:
                    ids += [rows[x] for x in tokens]
                except KeyError:
                    ids += [rows[x] if x in rows else row(x) for x in tokens]
            ids.append(1)
            ends[i] = len(ids)
        flat = np.array(ids, np.int32)
        stops = np.flatnonzero(flat < 2)
        starts = np.concatenate([[0], stops[:-1] + 1])
        sums = np.add.reduceat(self.vectors[flat], np.minimum(starts, len(flat) - 1), axis=0)
        phrases, words, chars = sums[:, : self.k], sums[:, self.k], sums[:, self.k + 1]
        doc = np.searchsorted(ends, stops, side="right")
        allowed = STRANGE_WORD * words + STRANGE_CHAR * chars
        some = ((words > 1) | (chars > 3)) & (phrases.min(1) <= allowed)
        full = some & (flat[stops] == 0) & ((words >= FULL_WORDS) | (chars >= FULL_CHARS))
        lead = np.where(full, phrases.argmin(1), -1)
        weight = words + chars / 2
        n = len(texts)
        mass = np.zeros((n, self.k))
        ok = np.flatnonzero(some)
        np.add.at(mass, (doc[ok], phrases[ok].argmin(1)), weight[ok])
        main = np.where(mass.max(1) > 0, mass.argmax(1), -1)
        m = main[doc]
        near = full & (m >= 0) & (phrases[np.arange(len(m)), np.maximum(m, 0)] - phrases.min(1) < MARGIN)
        lead = np.where(near, m, lead)
        per = np.zeros((n, self.k), np.int64)
        f = np.flatnonzero(lead >= 0)
        np.add.at(per, (doc[f], lead[f]), 1)
        total = np.zeros((n, self.k))
        np.add.at(total, doc[ok], phrases[ok])
        size = np.zeros(n)
        np.add.at(size, doc[ok], weight[ok])
        self.last = (stops, starts, doc, lead, phrases, weight)
        return per, main, total, size

    def confidence(self, total: np.ndarray, main: int) -> float:
        """1 - phrases of the winner / phrases of the best other language."""
        if main < 0:
            return 0.0
        rest = np.delete(total, main)
        return float(max(0.0, 1 - total[main] / rest.min())) if len(rest) and rest.min() > 0 else 0.0


def fit(documents: DataFrame) -> Model:
    """Automata from a bounded sample of labelled documents, an equal share for each language the labels name."""
    names = F.create_map(*[F.lit(x) for pair in _NAME.items() for x in pair])
    code = F.try_element_at(names, F.split_part(F.translate(F.lower(F.trim("lang")), "_", "-"), F.lit("-"), F.lit(1)))
    rows = sample_groups(documents, "doc_id", code, ["lang", "text"], "text")
    return Model(((r["lang"], r["text"]) for r in rows), {r["_g"]: r["_s"] for r in rows})


def _identifier(documents: DataFrame):
    model = documents.sparkSession.sparkContext.broadcast(fit(documents))
    return lambda: Identifier(model.value)


def document_languages(documents: DataFrame) -> DataFrame:
    """``doc_id, label, lang, confidence, sentences``: the main language of each document and its full sentences by language.

    A null or blank text, or one in which no sentence can be told, has a null language and confidence 0.
    """

    def fn(b, ident: Identifier):
        ids, texts, labels = (b.column(i).to_pylist() for i in range(3))
        per, main, total, _ = ident.judge(texts)
        codes = ident.model.codes
        return {
            "doc_id": ids, "label": labels,
            "lang": [codes[m] if m >= 0 else None for m in main],
            "confidence": [round(ident.confidence(total[i], main[i]), 4) for i in range(len(ids))],
            "sentences": [[(codes[j], int(p[j])) for j in np.flatnonzero(p)] for p in per],
        }

    schema = "doc_id bigint, label string, lang string, confidence double, sentences map<string,int>"
    return map_arrow(documents.select("doc_id", "text", "lang"), fn, schema, _identifier(documents))


def mislabelled(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence``: one row per language with a full sentence, for each document whose label is
    missing, no language or not its main language, or that holds two full sentences in a second language."""

    def fn(b, ident: Identifier):
        ids, texts, labels = (b.column(i).to_pylist() for i in range(3))
        per, main, total, _ = ident.judge(texts)
        codes = ident.model.codes
        known = {x: language_code(x) for x in set(labels)}
        own = np.array([codes.index(c) if (c := known[x]) in codes else -1 for x in labels], np.int64)
        second = per.copy()
        second[np.arange(len(main)), np.maximum(main, 0)] = 0
        case = (per.sum(1) > 0) & ((own != main) | (second.max(1) >= 2))
        i, j = np.nonzero((per > 0) & case[:, None])
        return {
            "doc_id": [ids[x] for x in i], "lang": [codes[x] for x in j],
            "confidence": [round(ident.confidence(total[x], main[x]), 4) for x in i],
        }

    return map_arrow(documents.select("doc_id", "text", "lang"), fn, "doc_id bigint, lang string, confidence double", _identifier(documents))


def segments(documents: DataFrame) -> DataFrame:
    """``doc_id, segment, lang, sentences, confidence``: maximal runs of full sentences in one language, in order."""

    def fn(b, ident: Identifier):
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        ident.judge(texts)
        _, _, doc, lead, phrases, _ = ident.last
        out: dict = {"doc_id": [], "segment": [], "lang": [], "sentences": [], "confidence": []}
        at = np.flatnonzero(lead >= 0)
        if not len(at):
            return out
        new = np.flatnonzero(np.concatenate([[True], (doc[at][1:] != doc[at][:-1]) | (lead[at][1:] != lead[at][:-1])]))
        sums = np.add.reduceat(phrases[at], new, axis=0)
        size = np.diff(np.append(new, len(at)))
        last, n = -1, 0
        for s, p, k in zip(new, sums, size):
            d, g = int(doc[at[s]]), int(lead[at[s]])
            n = n + 1 if d == last else 0
            last = d
            out["doc_id"].append(ids[d])
            out["segment"].append(n)
            out["lang"].append(ident.model.codes[g])
            out["sentences"].append(int(k))
            out["confidence"].append(round(ident.confidence(p, g), 4))
        return out

    return map_arrow(documents.select("doc_id", "text"), fn, "doc_id bigint, segment int, lang string, sentences int, confidence double", _identifier(documents))
