"""Garbled text from wrong character encodings (problem 1).

Characters are mapped back to the bytes of a legacy encoding; an automaton over byte classes
finds the maximal spans that are well-formed UTF-8, and only those spans are decoded. Text of
one legacy code page read as another has no byte structure to find, so there the same mapping
is judged by a character-bigram model fitted on clean documents; the model also confirms each
decoded span, since short well-formed spans occur by chance.
"""

from __future__ import annotations

import re
from collections import Counter
from html import escape, unescape
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.functions.blocks import _ATTRS, body_markup, split_blocks, title_text, without_code
from pagemill.llm.memo import Memo

#: Encodings under which UTF-8 bytes are commonly misread.
SINGLE = ("cp1252", "cp437", "cp850", "cp852", "cp1250", "cp1251", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "latin-1", "cp1253")
MULTI = ("gb18030", "cp932", "big5", "euc_jp", "cp949")
#: Encodings of the bytes themselves, when they are not UTF-8.
LEGACY = ("cp1252", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "iso8859-5")
LEGACY_MULTI = ("gb18030", "cp932", "euc_jp", "big5")

#: Nats by which a reading must beat the text as it stands: for one UTF-8 span, and for a page under one pair of code pages.
SPAN_GAIN = 3.0
PAGE_GAIN = 14.0
#: Nats by which a page's only odd run must gain, and its least characters: one run shows no pattern, so it needs more.
RUN_GAIN = 24.0
RUN_CHARS = 5
#: Documents to whose mass the counts of more are scaled: smoothing, seeds and gains were set for it.
MASS_DOCS = 4000
#: Share of the odd characters that the pair must turn into known text.
EXPLAINED = 0.5
STRANGE_EXPLAINED = 0.7

#: Well-formed UTF-8 over characters that stand for bytes.
_WELL_FORMED = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: A run of non-ASCII characters with one neighbour on either side.
_RUN = re.compile(r"[A-Za-z0-9]?[^\x00-\x7f]+[A-Za-z0-9]?")
_DIGIT = re.compile(r"[0-9]")
#: What of a page is no text to judge: comments, declarations, hidden elements and code with their content, and tags.
_NOT_TEXT = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(script|style|template|noscript|pre|code)(?=[\s/>])(?:" + _ATTRS + r").*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:" + _ATTRS + ")", re.S | re.I
)


def _to_bytes_table(enc: str) -> dict[int, int]:
    """Character -> byte (as a code point); characters the encoding lacks map outside the byte range."""
    t = {}
    for b in range(0x80, 0x100):
        try:
            t[ord(bytes([b]).decode(enc))] = b
        except UnicodeDecodeError:
            t.setdefault(b, b)
    return t


class _ByteMap(dict):
    """``str.translate`` table: known characters to their byte, ASCII kept, all others to U+FFFF."""

    def __missing__(self, k):
        v = self[k] = k if k < 0x80 else 0xFFFF
        return v


def _ascii(text: str) -> str:
    return "".join(c for c in text if c < "\x80")


def _has_letter(run: str) -> bool:
    """Whether a run has a non-ASCII letter, or a sign other than an apostrophe inside a word; ordinal and micro signs are no letters."""
    if any(c.isalpha() and c not in "ªºµ" for c in run if c > "\x7f"):
        return True
    return len(run) == 3 and run[0].isalpha() and run[2].isalpha() and run[1] not in "’‘"


def byte_text(text: str, table: dict[int, int]) -> str:
    return text.translate(table)


def mass_scale(docs: int) -> float:
    """What brings counts of ``docs`` documents to the mass of ``MASS_DOCS``; fewer are left as they are."""
    return min(1.0, MASS_DOCS / max(1, docs))


class BigramModel:
    """Character bigrams of clean text, case-folded, digits as one class; from texts, or from their counts.

    Counts are multiplied by ``scale``; what is known and common is told by the counts as they are.
    """

    def __init__(self, texts, counts: dict[str, int] | None = None, scale: float = 1.0):
        raw = self.counts(texts) if counts is None else counts
        two = raw if scale == 1 else {p: n * scale for p, n in raw.items()}
        one = Counter()
        for p, n in two.items():
            one[p[0]] += n
        self.seen = frozenset(one)
        for c in map(chr, (*range(0xA1, 0xC0), *range(0x2010, 0x203B))):
            one[c] += 1
        total = sum(one.values()) + 1
        self.base = {c: log((n + 0.1) / (total * 1.5)) for c, n in one.items()}
        self.floor = log(0.02 / (total * 1.5 + 1e5))
        self.two = {p: log(0.9 * n / one[p[0]] + 0.1 * one[p[1]] / total) for p, n in two.items()}
        self.common = frozenset(p for p, n in raw.items() if n >= 2)

    @classmethod
    def counts(cls, texts) -> Counter:
        """Bigrams of the runs of texts; a run that recurs is taken apart once."""
        runs, two = Counter(), Counter()
        for t in texts:
            if not t.isascii():
                runs.update(_RUN.findall(t))
        for run, n in runs.items():
            s = cls._fold(run)
            for p in map("".join, zip(s, s[1:])):
                two[p] += n
        return two

    @staticmethod
    def _fold(run: str) -> str:
        return ("" if run[0] < "\x80" else "^") + _DIGIT.sub("0", run.lower()) + ("" if run[-1] < "\x80" else "^")

    def known(self, run: str) -> bool:
        s = self._fold(run)
        return self.common.issuperset(map("".join, zip(s, s[1:])))

    def familiar(self, run: str) -> bool:
        """Whether each non-ASCII character occurs in the clean text or is a Latin-1 sign."""
        return all(c in self.base or "\xa1" <= c <= "\xbf" for c in run.lower() if c > "\x7f")

    def score(self, run: str) -> float:
        """Log-likelihood of a run and its two ends."""
        s, total = self._fold(run), 0.0
        for a, b in zip(s, s[1:]):
            v = self.two.get(a + b)
            total += self.base.get(b, self.floor) - 2.3 if v is None else v
        for a, b in zip(run, run[1:]):
            if a.islower() and b.isupper():
                total -= 4.0
        return total


class _Bytes(dict):
    """Character -> its bytes in an encoding, None where it has none."""

    def __init__(self, enc: str):
        super().__init__()
        self.enc = enc

    def __missing__(self, c: str):
        try:
            v = c.encode(self.enc)
        except UnicodeEncodeError:
            v = None
        self[c] = v
        return v


def _contains(part: str, whole: str) -> bool:
    """Whether ``part`` is a subsequence of ``whole``."""
    it = iter(whole)
    return all(c in it for c in part)


def _substitute(text: str, judged: str, fixes: dict[str, str]) -> str:
    """``text`` with the runs of ``judged``, a text of equal length, replaced."""
    out, at = [], 0
    for m in _RUN.finditer(judged):
        if m[0] in fixes:
            out += text[at : m.start()], fixes[m[0]]
            at = m.end()
    return "".join(out) + text[at:]


class Repairer:
    """Finds and repairs wrongly decoded spans; one per task."""

    def __init__(self, model: BigramModel):
        self.model = model
        self.tables = {e: _ByteMap(_to_bytes_table(e)) for e in SINGLE}
        self.multi = {e: _Bytes(e) for e in MULTI}
        self.runs = Memo(self._judge)
        self.pairs = Memo(self._pair_gains)

    def utf8_spans(self, text: str, enc: str) -> str:
        """``text`` with its maximal well-formed multibyte spans under ``enc`` decoded; the rest untouched."""
        if enc in MULTI:
            return self._multi_spans(text, self.multi[enc])
        mapped = text.translate(self.tables[enc])
        out, at = [], 0
        for m in _WELL_FORMED.finditer(mapped):
            out += text[at : m.start()], m[0].encode("latin-1").decode("utf-8")
            at = m.end()
        return text if not at else "".join(out) + text[at:]

    @staticmethod
    def _multi_spans(text: str, table: _Bytes) -> str:
        """As ``utf8_spans``, where a character may stand for several bytes.

        A span begins and ends with a character; the last one may have swallowed an ASCII letter
        as its second byte, which is given back.
        """
        parts = [table[c] for c in text]
        raw = b"".join(b"\xff" if p is None else p for p in parts).decode("latin-1")
        if not _WELL_FORMED.search(raw):
            return text
        starts, ends, n = {}, {}, 0
        for i, p in enumerate(parts):
            starts[n] = i
            n += len(p) if p else 1
            ends[n] = i + 1
        out, at = [], 0
        for m in _WELL_FORMED.finditer(raw):
            stop, tail = m.end(), ""
            if stop not in ends and stop + 1 in ends and raw[stop] < "\x80":
                tail, stop = raw[stop], stop + 1
            if m.start() in starts and stop in ends and starts[m.start()] >= at:
                out += text[at : starts[m.start()]], m[0].encode("latin-1").decode("utf-8"), tail
                at = ends[stop]
        return "".join(out) + text[at:]

    def _judge(self, run: str) -> tuple[str, float, str] | None:
        """Best UTF-8 reading of a run as (encoding, gain, reading), two layers deep; None when it reads well as it is."""
        if self.model.known(run):
            return None
        old, best = self.model.score(run), ("", 0.0, run)
        for enc in SINGLE + MULTI:
            new = self.utf8_spans(run, enc)
            for layer in range(3):
                if new == run or not new:
                    break
                gain = self.model.score(new) - old
                same = _contains(_ascii(run), _ascii(new)) if enc in MULTI else _ascii(new) == _ascii(run)
                if gain > best[1] and same and "�" not in new and (len(run) - len(new) > 1 or self.model.familiar(new)):
                    best = (enc, gain, new)
                deeper = self.utf8_spans(new, enc)
                if deeper == new:
                    break
                new = deeper
        return best

    def _pair_gains(self, run: str) -> dict[tuple[str, str], float]:
        """Gain of each reading of a run as another code page's bytes; a reading the model doesn't know wholly gains nothing."""
        old, out = self.model.score(run), {}
        for wrong in SINGLE:
            mapped = run.translate(self.tables[wrong])
            if "￿" in mapped:
                continue
            raw = mapped.encode("latin-1", "replace")
            for right in LEGACY + LEGACY_MULTI:
                if right == wrong:
                    continue
                try:
                    new = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if new and new != run and _ascii(new) == _ascii(run):
                    gain = self.model.score(new) - old
                    fits = self.model.known(new) and _has_letter(new)
                    out[wrong, right] = gain if gain < 0 or fits else 0.0
        return out

    def verdict(self, blocks: list[str], repair: bool = True) -> tuple[int, str | None, dict[str, str]]:
        """(wrong runs, likeliest encoding, run -> restored run) over a page's blocks; without ``repair`` only what tells whether there are any."""
        wrong, encs, odd, fixes = 0, Counter(), [], {}
        for b in blocks:
            if b.isascii():
                continue
            if "�" in b:
                wrong += 1
            for run in _RUN.findall(b):
                v = self.runs[run]
                if v is None:
                    continue
                # The only foreign characters of a line need less proof: there is no text of their script around them.
                if v[1] >= SPAN_GAIN or v[1] > 0 and b.replace(run, "").isascii():
                    wrong += 1
                    encs[v[0]] += 1
                    fixes[run] = v[2]
                    # Readings the model doesn't know wholly may be chance; one pair of code pages for all odd runs outweighs them.
                    if repair and _has_letter(run) and not self.model.known(v[2]):
                        odd.append(run)
                elif _has_letter(run):
                    odd.append(run)
        if odd and (repair or not wrong):
            pair = self.best_pair(odd)
            if pair:
                if not wrong:
                    wrong, encs = len(odd), Counter({f"{pair[1]} as {pair[0]}": 1})
                for r in odd if repair else ():
                    try:
                        fixes[r] = byte_text(r, self.tables[pair[0]]).encode("latin-1").decode(pair[1])
                    except (UnicodeEncodeError, UnicodeDecodeError):
                        continue
        return wrong, encs.most_common(1)[0][0] if encs else None, fixes

    def examine(self, blocks: list[str]) -> tuple[int, str | None]:
        """(wrong runs, likeliest encoding) over a page's blocks."""
        return self.verdict(blocks, False)[:2]

    def best_pair(self, odd) -> tuple[str, str] | None:
        """The pair of code pages that explains a page's odd runs together, or None.

        Most characters of the odd runs, or nearly all of those runs with characters foreign to
        clean text, must turn into text the model knows.
        """
        runs = set(odd)
        strange = {r for r in runs if not all(c in self.model.seen for c in r.lower() if c > "\x7f")}
        gains: Counter = Counter()
        solved: dict = {}
        for run in runs:
            for pair, g in self.pairs[run].items():
                gains[pair] += g
                if g > 0:
                    solved.setdefault(pair, set()).add(run)
        if not gains:
            return None
        pair, gain = gains.most_common(1)[0]
        mine = solved.get(pair, set())
        if gain < PAGE_GAIN or len(mine) < 2 and (len(runs) > 1 or gain < RUN_GAIN or max(map(len, mine), default=0) < RUN_CHARS):
            return None
        size = lambda x: sum(map(len, x))
        whole = size(mine) >= EXPLAINED * size(runs)
        return pair if whole or (len(mine & strange) > 1 and size(mine & strange) >= STRANGE_EXPLAINED * size(strange)) else None

    def repair(self, text: str) -> str:
        """``text`` with every confirmed span decoded; the rest as it was."""
        if text.isascii():
            return text
        fixes = self.verdict([text])[2]
        return _RUN.sub(lambda m: fixes.get(m[0], m[0]), text) if fixes else text

    def repair_page(self, html: str, rounds: int = 3) -> str:
        """Markup whose wrongly decoded title and text are restored by the verdict of ``examine``.

        Only text is touched: tags, comments, scripts, styles and code stay as they are. Text whose
        characters are written as references is judged decoded; where it changes, it is written
        with the references that markup needs. What is joined over inline tags is judged joined. A
        repaired page is judged again, ``rounds`` times at most: what a second wrong reading hid shows then.
        """
        for _ in range(rounds):
            new = self._repair_once(html)
            if new == html:
                break
            html = new
        return html

    def _repair_once(self, html: str) -> str:
        if html.isascii() and "&" not in html:
            return html
        parts: list[str] = []
        at = 0
        for m in _NOT_TEXT.finditer(html):
            parts += html[at : m.start()], m[0]
            at = m.end()
        parts.append(html[at:])
        plain = [unescape(p) if "&" in p else p for p in parts[::2]]
        fixes = self.verdict([title_text(html), *split_blocks(without_code(body_markup(html))), *(p for p in plain if not p.isascii())])[2]
        if not fixes:
            return html
        for i, p in enumerate(plain):
            if not p.isascii():
                new = _RUN.sub(lambda m: fixes.get(m[0], m[0]), p)
                if "\xa0" in new:  # blocks are judged with plain spaces
                    new = _substitute(new, new.replace("\xa0", " "), fixes)
                if new != p:
                    parts[2 * i] = escape(new, False)
        return "".join(parts)


def fit(documents: DataFrame) -> BigramModel:
    """Character model from the bigrams of all documents: counted where they are read, only the sums come to the driver.

    The sums are scaled to ``MASS_DOCS`` documents: gains in nats mean the same however large the table.
    """

    def fn(b, _):
        texts = [t for t in b.column(0).to_pylist() if t]
        two = BigramModel.counts(texts)
        return {"pair": ["", *two], "n": [len(texts), *two.values()]}

    sums = map_arrow(documents.select("text"), fn, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    two = dict(zip(sums["pair"].to_pylist(), sums["n"].to_pylist()))
    return BigramModel((), two, mass_scale(two.pop("", 0)))


def _setup(spark, documents: DataFrame):
    model = spark.sparkContext.broadcast(fit(documents))
    return lambda: Repairer(model.value)


def garbled_pages(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """``page_id, runs, encoding`` of pages whose title or visible text outside code is wrongly decoded.

    Null or empty html gives no row. Text that is lost (U+FFFD) counts, with a null encoding if
    nothing else is wrong. Repeated rows are judged alike.
    """

    def fn(b, r: Repairer):
        out: dict = {"page_id": [], "runs": [], "encoding": []}
        for pid, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not html or (html.isascii() and "&" not in html):
                continue
            n, enc = r.examine([title_text(html), *split_blocks(without_code(body_markup(html)))])
            if n:
                out["page_id"].append(pid)
                out["runs"].append(n)
                out["encoding"].append(enc)
        return out

    return map_arrow(cache.select("page_id", "html"), fn, "page_id bigint, runs int, encoding string", _setup(cache.sparkSession, documents))


def repaired_pages(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """``page_id, html, changed``: each page with its wrongly decoded spans restored where that is possible."""

    def fn(b, r: Repairer):
        ids, pages = b.column(0).to_pylist(), b.column(1).to_pylist()
        new = [r.repair_page(h) if h else h for h in pages]
        return {"page_id": ids, "html": new, "changed": [a != c for a, c in zip(pages, new)]}

    return map_arrow(cache.select("page_id", "html"), fn, "page_id bigint, html string, changed boolean", _setup(cache.sparkSession, documents))


def declared_charsets(cache: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, runs, encoding, declared, told``: wrongly decoded pages with the character set of their content type.

    ``told`` says whether the declared set names the wrong reading; null where none is declared or
    no reading was found. Only the found rows are joined, never page bodies.
    """
    charset = F.regexp_extract(F.lower("content_type"), r"charset\s*=\s*[\"']?\s*([\w.:-]+)", 1)
    own = pages.where("page_id is not null").groupBy("page_id").agg(F.min(F.when(charset != "", charset)).alias("declared"))
    got = garbled_pages(cache, documents).distinct().join(own, "page_id", "left")
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "windows-", "cp"), "[^a-z0-9]", "")
    return got.withColumn("told", plain(F.col("declared")) == plain(F.regexp_replace("encoding", "^.* as ", "")))
