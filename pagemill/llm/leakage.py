"""Evaluation texts leaking into documents, by latent semantic retrieval (problem 9).

The passages of all evaluation items are TF-IDF vectors over the items' vocabulary, weighted by
document counts over the whole corpus. A distributed randomised SVD of these passages, truncated
far below their number, gives a latent space; windows of every document are folded into it and
compared with the items by cosine. Runs of four words shared with an item are counted beside it,
so that no leak is lost because its words are frequent. Each candidate pair is then aligned word by
word: chains of shared word runs, their longest common subsequence, and the share of the item they
hold together decide. Items are a stated query set, taken in blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow

#: Items of one block: a bound of what is broadcast. A block of 240 items holds some 2,500 passages.
BLOCK_ITEMS = 2048
#: Latent rank, spare columns of the sketch, and rounds that sharpen it.
RANK = 384
OVERSAMPLE = 10
POWER = 1
#: Passages that one task sketches.
TASK_PASSAGES = 4000
#: Words in more than this share of documents have no weight, save an item's rarest ones.
MAX_SHARE = 0.01
RAREST = 20
#: Words of a window, words between passages of an item, and the cosine from which a window makes its document a candidate.
WINDOW = 24
STEP = 12
MIN_COSINE = 0.12
#: Weighted words of a window.
LEAST_WORDS = 2
#: A passage has so many words in a row; the passages together this share of the item; an alignment this share of equal words.
MIN_PASSAGE = 20
MIN_SHARE = 0.4
MIN_LCS = 0.78
#: Words of a shared run, and edits of a leaked word up to which shared runs alone make every leak a candidate.
RUN = 4
EDITS = 0.12
#: Edits among some ``MIN_PASSAGE`` words in a row of such a leak.
PASSAGE_EDITS = 2
#: Equal words of an alignment that no cosine backs: frequent words alone align texts of one pattern, such as lists with other names.
MIN_LCS_FREQUENT = 0.86

_WORD = re.compile(r"[^\W_]+")
_CHOICE = re.compile(r"\(([A-H])\)\s*([^()]+)")


def plain(word: str) -> str:
    """Case and accents removed."""
    w = word.casefold()
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    """Words of a text with case, accents, punctuation, quotes and line breaks ignored."""
    return _WORD.findall(plain(text))


class Numbers(dict):
    """Lower-cased token -> number of its plain form in a vocabulary; -1 for all others. Tokens that fold to two words keep the first."""

    def __init__(self, vocabulary: dict[str, int], limit: int = 500_000):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = self.vocabulary.get(token, -1)
        if v < 0 and not token.isascii():
            v = self.vocabulary.get(plain(token), -1)
        self[token] = v
        return v


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())


def corpus_counts(documents: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """Documents that hold each vocabulary word, and documents with text, over the whole corpus."""
    size = len(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches):
        numbers = Numbers(shared.value)
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    total[size] += 1
                    got = {numbers[x] for x in set(_tokens(t))}
                    got.discard(-1)
                    total[list(got)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(size + 1, np.int64)
    for r in documents.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out[:size], int(out[size])


def randomised_svd(rows: DataFrame, width: int, rank: int, tasks: int = 1, power: int = POWER, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (width x rank) of sparse rows ``ix array<int>, val array<double>``.

    The range of the rows is sketched from their right side, sharpened ``power`` times and
    orthogonalised; the rows folded into it give a small Gram matrix, whose eigenvectors turn the
    sketch into singular vectors. Each pass sends sums of width x (rank + OVERSAMPLE) from each of
    ``tasks`` tasks, whatever the number of rows.
    """
    n = min(width, max(1, rank) + OVERSAMPLE)
    sc = rows.sparkSession.sparkContext
    src = rows.select("ix", "val").repartition(tasks).persist()

    def total(q: np.ndarray, fold) -> np.ndarray:
        """Sum over the rows of ``fold(indices, values, row folded into q)``, each a (places, values) addend."""
        shared = sc.broadcast(q)

        def run(batches):
            acc = None
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if i:
                        at = np.asarray(i, np.int64)
                        w = np.asarray(v)
                        y = w @ shared.value[at]
                        if acc is None:
                            acc = np.zeros((width if fold == "range" else n, n))
                        if fold == "range":
                            acc[at] += np.outer(w, y)
                        else:
                            acc += np.outer(y, y)
            if acc is not None:
                yield pa.RecordBatch.from_pydict({"m": pa.array([acc.tobytes()], pa.binary())})

        out = np.zeros((width if fold == "range" else n, n))
        for r in src.mapInArrow(run, "m binary").toLocalIterator():
            out += np.frombuffer(bytes(r["m"])).reshape(out.shape)
        shared.unpersist()
        return out

    q = np.random.default_rng(seed).standard_normal((width, n))
    for _ in range(power + 1):
        q, _ = np.linalg.qr(total(q, "range"))
    values, vectors = np.linalg.eigh(total(q, "gram"))
    src.unpersist()
    s = np.sqrt(np.maximum(values[::-1], 0.0))
    keep = s[:rank] > 1e-7 * max(float(s[0]), 1e-12)
    return s[:rank][keep], (q @ vectors[:, ::-1])[:, :rank][:, keep]


def runs_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``RUN`` words from each position on, and whether all of them are in the vocabulary."""
    n = max(0, len(numbers) - RUN + 1)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(RUN):
        x = numbers[k : n + k]
        h = (h ^ (x.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ok &= x >= 0
    return h, ok


def least_runs(words: int) -> int:
    """Positions of an item whose run must stand in a document that leaks it: an edit breaks ``RUN`` runs, a passage's end the rest."""
    held = int(np.ceil(MIN_SHARE * words))
    return max(1, held - (RUN - 1) * max(1, held // MIN_PASSAGE) - RUN * int(np.ceil(EDITS * held)))


class Space:
    """Latent space of a block of items, and what aligning needs of them."""

    def __init__(self, ids: list[int], texts: list[str], vocabulary: list[str], weights: np.ndarray, unseen: float, basis: np.ndarray):
        self.ids, self.vocabulary, self.unseen = ids, {w: i for i, w in enumerate(vocabulary)}, unseen
        self.weights = weights.astype(np.float32)
        self.basis = basis.astype(np.float32)
        self.words = [words_of(t) for t in texts]
        self.numbers = [[self.vocabulary[w] for w in ws] for ws in self.words]
        lat = np.zeros((len(ids), basis.shape[1]), np.float32)
        for i, ns in enumerate(self.numbers):
            u, c = np.unique(np.array(ns, np.int64), return_counts=True)
            x = self.weights[u] * c
            lat[i] = (x @ self.basis[u]) / max(1e-9, float(np.linalg.norm(x)))
        self.items = lat
        self.folded = self.basis * self.weights[:, None]
        self.seeds: list[dict] = []
        for ns in self.numbers:
            d: dict = defaultdict(list)
            for j in range(len(ns) - 1):
                d[ns[j], ns[j + 1]].append(j)
            self.seeds.append(dict(d))
        pairs = [np.unique(np.array([a * len(self.vocabulary) + b for a, b in d], np.int64)) for d in self.seeds]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.has = np.zeros((len(ids), len(self.pairs)), bool)
        for i, x in enumerate(pairs):
            self.has[i, np.searchsorted(self.pairs, x)] = True
        runs = [runs_of(np.array(ns, np.int64))[0] for ns in self.numbers]
        self.runs = np.unique(np.concatenate([np.zeros(0, np.uint64), *runs]))
        cell = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(self.runs, r) * len(ids) + i for i, r in enumerate(runs))])
        cell, self.times = np.unique(cell, return_counts=True)
        self.holders = cell % max(1, len(ids))
        self.starts = np.searchsorted(cell // max(1, len(ids)), np.arange(len(self.runs) + 1))
        self.least = np.array([least_runs(len(ns)) for ns in self.numbers])
        self.lines = [np.searchsorted(self.runs, r) for r in runs]

    def sharing(self, flat: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share enough runs of words, however frequent these are."""
        h, ok = runs_of(flat)
        at = np.flatnonzero(ok)
        if not len(at) or not len(self.runs):
            return set()
        run = np.minimum(np.searchsorted(self.runs, h[at]), len(self.runs) - 1)
        doc = np.searchsorted(ends, at, side="right")
        hit = (self.runs[run] == h[at]) & (at + RUN <= ends[doc])
        key = np.unique(doc[hit] * len(self.runs) + run[hit])
        doc, run = key // len(self.runs), key % len(self.runs)
        found: set[tuple[int, int]] = set()
        at = 0
        while at < len(doc):
            # Some thousand documents at a time bound the table of counts.
            stop = int(np.searchsorted(doc, doc[at] + 2048))
            n = self.starts[run[at:stop] + 1] - self.starts[run[at:stop]]
            rows = np.repeat(self.starts[run[at:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(doc[at:stop] - doc[at], n) * len(self.ids) + self.holders[rows]
            count = np.bincount(cell, weights=self.times[rows], minlength=2048 * len(self.ids)).reshape(2048, -1)
            d, i = np.nonzero(count >= self.least)
            lo, hi = np.searchsorted(doc[at:stop], doc[at] + d), np.searchsorted(doc[at:stop], doc[at] + d + 1)
            held = np.zeros(len(self.runs), bool)
            last = -1
            for x, item, a, b in zip(d.tolist(), i.tolist(), lo.tolist(), hi.tolist()):
                if x != last:
                    held[:] = False
                    held[run[at + a : at + b]] = True
                    last = x
                if self.dense(held, item):
                    found.add((x + int(doc[at]), item))
            at = stop
        return found

    def dense(self, held: np.ndarray, item: int) -> bool:
        """Whether some ``MIN_PASSAGE`` words in a row of the item hold the runs that ``PASSAGE_EDITS`` edits leave."""
        c = np.cumsum(held[self.lines[item]])
        w = MIN_PASSAGE - RUN + 1
        most = int(c[-1]) if len(c) <= w else max(int(c[w - 1]), int((c[w:] - c[:-w]).max()))
        return most >= min(w, len(c)) - RUN * PASSAGE_EDITS

    def candidates(self, flat: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs with a window whose cosine to the item is high enough."""
        w = np.where(flat >= 0, self.weights[np.maximum(flat, 0)], np.float32(0))
        hot = np.flatnonzero(w > 0)
        if not len(hot):
            return set()
        sq = np.where(flat >= 0, w * w, np.float32(self.unseen**2)).astype(np.float64)
        c = np.concatenate([[0.0], np.cumsum(sq)])
        doc = np.searchsorted(ends, hot, side="right")
        stop = np.minimum(hot + WINDOW, ends[doc])
        norm = np.sqrt(c[stop] - c[hot])
        last = np.searchsorted(hot, stop)
        count = last - np.arange(len(hot))
        own = np.concatenate([[0.0], np.cumsum((w[hot] ** 2).astype(np.float64))])
        energy = np.sqrt(own[last] - own[:-1])
        ok = np.flatnonzero((count >= LEAST_WORDS) & (energy >= MIN_COSINE * norm))
        found: set[tuple[int, int]] = set()
        step = 4096
        for s in range(0, len(ok), step):
            part = ok[s : s + step]
            lo, n = part, count[part]
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            x = np.add.reduceat(self.folded[flat[hot[rows]]], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
            sim = (x @ self.items.T) / norm[part][:, None].astype(np.float32)
            a, i = np.nonzero(sim >= MIN_COSINE)
            found.update(zip(doc[part[a]].tolist(), i.tolist()))
        return found

    def shared_pairs(self, doc: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a document where a word pair of any item stands, and the numbers of these pairs."""
        x = np.array(doc, np.int64)
        at = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0)) if len(self.pairs) else np.zeros(0, np.int64)
        code = x[at] * len(self.vocabulary) + x[at + 1] if len(at) else at
        pair = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        hit = self.pairs[pair] == code if len(at) else np.zeros(0, bool)
        return at[hit], pair[hit]

    def passages(self, doc: list[int], item: int, shared: tuple[np.ndarray, np.ndarray] | None = None, min_lcs: float = MIN_LCS) -> list[tuple[int, int, int, int]]:
        """(document start, end, item start, end) of the aligned passages, ends exclusive."""
        seeds, open_, done, limit = self.seeds[item], [], [], 8
        at, pair = shared or self.shared_pairs(doc)
        at = at[self.has[item, pair]]
        # Chains don't bridge more than 7 words, and a passage of enough equal words holds so many shared pairs at least.
        least = np.ceil(MIN_PASSAGE * (3 * min_lcs - 2) - 1)
        part = np.cumsum(np.diff(at, prepend=at[:1]) > 7)
        at = at[np.bincount(part)[part] >= least] if len(at) else at
        for p in at.tolist():
            for j in seeds[doc[p], doc[p + 1]]:
                best = None
                for ch in open_:
                    dp, dj = p - ch[1], j - ch[3]
                    if 0 < dp <= 7 and 0 < dj <= 7 and abs(dp - dj) <= 3 and (best is None or ch[3] - ch[2] > best[3] - best[2]):
                        best = ch
                if best is not None:
                    best[1], best[3] = p, j
                else:
                    open_.append([p, p, j, j])
            if len(open_) > limit:
                done += [c for c in open_ if p - c[1] > 7 and max(c[1] - c[0], c[3] - c[2]) + 2 >= MIN_PASSAGE - 2]
                open_ = [c for c in open_ if p - c[1] <= 7]
                limit = max(8, 2 * len(open_))
        out = []
        for a, b, i, j in done + open_:
            if max(b - a, j - i) + 2 >= MIN_PASSAGE - 2:
                out.append((a, b + 2, i, j + 2))
        return out

    def verify(self, doc: list[int], item: int, shared: tuple[np.ndarray, np.ndarray] | None = None, min_lcs: float = MIN_LCS) -> tuple[float, int] | None:
        """(share of the item held, passages) if the document leaks the item."""
        ns = self.numbers[item]
        held = np.zeros(len(ns), bool)
        n = 0
        for a, b, i, j in self.passages(doc, item, shared, min_lcs):
            if max(b - a, j - i) < MIN_PASSAGE:
                continue
            common = lcs(doc[a:b], ns[i:j])
            if common >= min_lcs * max(b - a, j - i):
                held[i:j] = True
                n += 1
        share = held.mean() if len(ns) else 0.0
        return (float(share), n) if share >= MIN_SHARE else None


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    mask, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def answers(text: str) -> list[str]:
    """Answer options of a choice item, plain words; [] for other items."""
    return [" ".join(words_of(m[1])) for m in _CHOICE.findall(text) if m[1].strip()]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, share, passages, answers``: documents that leak an item.

    A leak holds passages of the item, each at least ``MIN_PASSAGE`` words in a row up to small
    edits, that together are ``MIN_SHARE`` of the item's words; ``answers`` counts the answer
    options of the item that stand in the document too. Null and blank texts leak nothing;
    repeated item rows count once (least text), copies of a document each count.
    """
    rows = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    ids, held = [], Counter()
    for r in rows.orderBy("item_id").toLocalIterator():
        ids.append(r["item_id"])
        held.update(set(words_of(r["text"])))
    schema = "doc_id bigint, item_id bigint, share double, passages int, answers int"
    if not held:
        return documents.sparkSession.createDataFrame([], schema)
    # Counts and weights are of all items and all documents; a block only bounds what is broadcast.
    vocabulary = sorted(held)
    df, n = corpus_counts(documents, vocabulary)
    stats = {w: (int(f), held[w]) for w, f in zip(vocabulary, df)}
    out = None
    for s in range(0, len(ids), BLOCK_ITEMS):
        part = ids[s : s + BLOCK_ITEMS]
        got = _block_leaks(documents, rows.where(F.col("item_id").between(part[0], part[-1])), stats, n, len(ids))
        out = got if out is None else out.unionByName(got)
    return out


def passages_of(numbers: list[int]) -> list[list[int]]:
    """Overlapping windows of an item's words, the last one whole."""
    return [numbers[a : a + WINDOW] for a in range(0, max(1, len(numbers) - STEP), STEP)]


def _unit(numbers: list[int], weights: np.ndarray) -> tuple[list[int], list[float]]:
    """Sparse TF-IDF vector of unit length."""
    u, c = np.unique(np.array(numbers, np.int64), return_counts=True)
    x = c * weights[u]
    x = x / max(1e-9, float(np.linalg.norm(x)))
    return u.tolist(), x.tolist()


def item_weights(words: list[list[str]], vocabulary: list[str], stats: dict[str, tuple[int, int]], n: int, items: int) -> np.ndarray:
    """Weight of each vocabulary word, from the documents and the items of the whole tables that hold it."""
    number = {w: i for i, w in enumerate(vocabulary)}
    df = np.array([stats[w][0] for w in vocabulary])
    idf = np.log((n + 1) / (df + 1)) + 0.1
    weights = np.where(df <= max(1, MAX_SHARE * n), idf, 0.0)
    for ws in words:
        rare = sorted({number[w] for w in ws}, key=lambda k: (df[k], vocabulary[k]))[:RAREST]
        weights[rare] = idf[rare]
    # Words that many items share, such as those of a common instruction, don't tell items apart.
    shared = np.array([stats[w][1] for w in vocabulary])
    return weights * np.log((items + 1) / np.maximum(shared, 1)) / max(1e-9, np.log(items + 1))


def _block_leaks(documents: DataFrame, block: DataFrame, stats: dict[str, tuple[int, int]], n: int, items: int) -> DataFrame:
    spark = documents.sparkSession
    texts = {r["item_id"]: r["text"] for r in block.collect()}
    ids = sorted(texts)
    words = [words_of(texts[i]) for i in ids]
    vocabulary = sorted({w for ws in words for w in ws})
    weights = item_weights(words, vocabulary, stats, n, items)
    number = {w: i for i, w in enumerate(vocabulary)}
    matrix = [_unit(p, weights) for ws in words for p in passages_of([number[w] for w in ws]) if p]
    basis = np.zeros((len(vocabulary), 1))
    if matrix:
        rows = spark.createDataFrame(matrix, "ix array<int>, val array<double>")
        _, basis = randomised_svd(rows, len(vocabulary), min(RANK, len(matrix)), -(-len(matrix) // TASK_PASSAGES))
    unseen = float(np.log(n + 1) + 0.1)
    shared = spark.sparkContext.broadcast((Space(ids, [texts[i] for i in ids], vocabulary, weights, unseen, basis), {i: answers(texts[i]) for i in ids}))

    def fn(b, state):
        space, options, numbers = state
        out: dict = {"doc_id": [], "item_id": [], "share": [], "passages": [], "answers": []}
        flat: list[int] = []
        doc_ids, docs = b.column(0).to_pylist(), b.column(1).to_pylist()
        ends = np.empty(len(docs), np.int64)
        for i, t in enumerate(docs):
            if t:
                tokens = _tokens(t)
                try:
                    flat += map(numbers.__getitem__, tokens)
                except KeyError:
                    flat += [numbers[x] for x in tokens]
            ends[i] = len(flat)
        arr = np.array(flat, np.int32)
        if not len(arr) or not space.ids:
            return out
        by: dict = defaultdict(list)
        like = space.candidates(arr, ends)
        for d, i in like | space.sharing(arr, ends):
            by[d].append(i)
        for d, its in by.items():
            mine = flat[ends[d - 1] if d else 0 : ends[d]]
            pairs = space.shared_pairs(mine)
            for i in its:
                v = space.verify(mine, i, pairs, MIN_LCS if (d, i) in like else MIN_LCS_FREQUENT)
                if v:
                    out["doc_id"].append(doc_ids[d])
                    out["item_id"].append(space.ids[i])
                    out["share"].append(v[0])
                    out["passages"].append(v[1])
                    there = options[space.ids[i]]
                    body = " " + " ".join(words_of(docs[d])) + " " if there else ""
                    out["answers"].append(sum(f" {x} " in body for x in there))
        return out

    def setup():
        space, options = shared.value
        return space, options, Numbers(space.vocabulary)

    return map_arrow(documents.select("doc_id", "text"), fn, "doc_id bigint, item_id bigint, share double, passages int, answers int", setup)
