"""Main content of pages by a linear-chain CRF over DOM leaf blocks (problem 3).

A page is a chain of leaf blocks. Each block has features of its ancestor tags, of the boxes it
stands in and of its text; a conditional random field gives it one of six roles, decoded by
Viterbi over whole batches of pages. The field is trained on a bounded sample of pages (``fit``)
or, for problem 4, on all of them (``fit_all``); their labels come from the pages' own conventions (``role_of``): semantic elements, naming habits of
class and id, buttons of consent boxes, headed link lists. During training the features that
state such a convention are dropped at random, so the field learns to do without them.
"""

from __future__ import annotations

import gc
import re
from html import unescape
from itertools import chain, islice
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow, pieces
from pagemill.functions.blocks import _ATTRS, INLINE, body_markup, crc, squeeze
from pagemill.llm.memo import Memo
from pagemill.llm.samples import PAGE_CHARS, sample_rows

ROLES = ("main", "menu", "crumb", "consent", "sidebar", "footer")
MAIN = 0
SAMPLE_PAGES = 1500
#: Blocks of the longest page that ``fit`` trains on: a bound of the driver's memory. ``fit_all`` trains on every page, and every page is decoded, however long.
MAX_BLOCKS = 5000
MOST_WORDS = 96
FEATURES = 1 << 14
EPOCHS = 12
#: Pages that the training of a field over all pages sees at least before fields are averaged, and the unit of its sums.
VISITS = EPOCHS * SAMPLE_PAGES
FIXED = 1 << 20

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRS + ")")
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_PRICE = re.compile("[€$£¥]")
_INLINE = frozenset(INLINE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOXES = frozenset("body div nav aside footer header main article section table td ul ol center form dl".split())
_CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Naming habits for class and id that tell a box's role.
_HABITS = {
    "menu": ("nav", "menu", "navbar", "topnav"), "crumb": ("crumb", "crumbs", "breadcrumb", "breadcrumbs"),
    "consent": ("cc", "consent", "cookie", "cookies", "gdpr"), "sidebar": ("side", "sidebar", "related", "ad", "ads", "promo", "newsletter"),
    "footer": ("ft", "foot", "footer", "legal"),
}
_HABIT = {w: k for k, ws in _HABITS.items() for w in ws}
_FLAGS = {"h1": 1, "h3": 2, "button": 4}
_SEPARATORS = re.compile(r" (?:[|»>/·•→›:-]|>>) ")


class Box:
    """An element that groups blocks, with what its subtree holds."""

    __slots__ = ("button", "h1", "h3", "habit", "links", "n", "name", "parent", "prose", "seen")

    def __init__(self, name: str, parent: Box | None, habit: str):
        self.name, self.parent, self.habit = name, parent, habit
        self.n = self.links = self.prose = 0
        self.h1 = self.h3 = self.button = False
        self.seen: tuple | None = None


class Leaf:
    __slots__ = ("box", "link", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], box: Box, link: float):
        self.text, self.path, self.box, self.link = text, path, box, link


def _sentence(text: str) -> bool:
    return len(text) > 40 and text[-1] in ".!?。！？…"


def _habit(attrs: str) -> str:
    names = _NAMES.findall(attrs)
    return next((h for w in names and re.split(r"[^a-z]+", " ".join(names).lower()) if (h := _HABIT.get(w))), "")


#: What tags and attributes say, looked up by how they are written.
_LOWER, _HABIT_OF = Memo(str.lower, 10_000), Memo(_habit, 10_000)


def leaves(html: str | None) -> list[Leaf]:
    """Leaf blocks of a page in order; the same texts as ``functions.blocks.visible_blocks``."""
    if not html:
        return []
    root = Box("body", None, "")
    boxes, out = [root], []
    # Open elements: name, box, names of the last four, and which of h1, h3 and button are open (1, 2, 4).
    stack: list[tuple[str, Box, tuple[str, ...], int]] = []
    top = bottom = ("", root, (), 0)
    link_depth = linked = 0
    *split, last = _TAG.split(body_markup(html))
    split = iter(split)
    parts = [x for x in (next(split, ""),) if x]
    # What follows the last tag stands outside links; the markup's end ends a block like a tag that opens nothing.
    for slash, written, attrs, piece in chain(zip(split, split, split, chain(split, ("",))), (("/", "a", "", last), ("", "hr", "", ""))):
        name = _LOWER[written]
        if name in _INLINE:
            if name == "a":
                link_depth = 0 if slash else 1
        else:
            if parts:
                raw = parts[0] if len(parts) == 1 else "".join(parts)
                text = squeeze(unescape(raw) if "&" in raw else raw)
                if text:
                    _, box, path, flags = top
                    share = min(1.0, linked / len(raw)) if linked else 0.0
                    out.append(Leaf(text, path, box, share))
                    box.n += 1
                    if share > 0.5:
                        box.links += 1
                    if _sentence(text):
                        box.prose += 1
                    if flags:
                        box.h1, box.h3, box.button = box.h1 or flags & 1 > 0, box.h3 or flags & 2 > 0, box.button or flags & 4 > 0
                parts, linked = [], 0
            if slash:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        top = stack[-1] if stack else bottom
                        break
            elif name not in _VOID:
                if name in _CLOSES and top[0] in _CLOSES[name]:
                    stack.pop()
                    top = stack[-1] if stack else bottom
                _, box, path, flags = top
                if name in _BOXES and name != "body":
                    box = Box(name, box, _HABIT_OF[attrs] if len(attrs) < 200 else _habit(attrs))
                    boxes.append(box)
                top = (name, box, (*path[-3:], name), flags | _FLAGS.get(name, 0))
                stack.append(top)
        if piece:
            parts.append(piece)
            if link_depth:
                linked += len(piece)
    # A box comes after the one it stands in.
    for b in boxes[:0:-1]:
        up = b.parent
        up.n += b.n
        up.links += b.links
        up.prose += b.prose
        up.h1, up.h3, up.button = up.h1 or b.h1, up.h3 or b.h3, up.button or b.button
    return out


# ---- labels of the training pages


def role_of(leaf: Leaf) -> int:
    """Role of a block by the conventions its page shows; main where none speaks."""
    b = leaf.box
    while b is not None:
        if b.h1:
            break
        if b.name == "nav" or b.habit == "menu":
            return 1
        if b.name == "footer" or b.habit == "footer":
            return 5
        if b.name == "aside" or b.habit == "sidebar":
            return 4
        if b.habit == "crumb":
            return 2
        if b.habit == "consent" or (b.button and b.name in ("div", "section", "form") and b.parent is not None and not b.h3):
            return 3
        if b.name == "div" and b.h3 and b.links >= 1:
            return 4
        if b.name == "div" and b.n == 1 and len(_SEPARATORS.findall(leaf.text)) > 0 and not _sentence(leaf.text) and len(leaf.text) < 160:
            return 1 if leaf.link > 0.5 else 2
        if b.name in ("ul", "div", "table") and b.parent is not None and b.parent.name == "body" and b.links >= 3 and b.links >= 0.8 * b.n:
            return 1
        b = b.parent
    return MAIN


def labels(page: list[Leaf]) -> list[int]:
    return [role_of(x) for x in page]


# ---- features


#: Bins of 0 to 63, from which on all is one bin.
_BINS = tuple(min(9, int(log2(n + 1) * 1.5)) for n in range(64))


def _bin(n: int) -> int:
    return _BINS[n] if n < 64 else 9


def _text_features(text: str) -> list[str]:
    # The largest bin begins below MOST_WORDS, so counting stops there; words are looked for in the whole text.
    # Where the beginning holds that many, the last of them may be cut: only their number is used then.
    words = _WORD.findall(text, 0, 16 * MOST_WORDS)[:MOST_WORDS]
    if len(words) < MOST_WORDS and len(text) > 16 * MOST_WORDS:
        words = [m[0] for m in islice(_WORD.finditer(text), MOST_WORDS)]
    out = [f"len{_bin(len(text))}", f"words{_bin(len(words))}"]
    if _sentence(text):
        out.append("sentence")
    elif text[-1] in ".!?。！？":
        out.append("stop")
    seps = len(_SEPARATORS.findall(text))
    if seps:
        out.append(f"sep{min(seps, 4)}")
    if "©" in text:
        out.append("copyright")
    if _PRICE.search(text):
        out.append("price")
    if _DIGIT.search(text):
        out.append("digit")
    if text.isupper():
        out.append("upper")
    if len(words) <= 12:
        out += ["w:" + w for w in dict.fromkeys(map(str.lower, words))]
    return out


def _slot(name: str) -> int:
    return crc(name) % (FEATURES - 1) + 1


def _box_key(box: Box) -> tuple:
    """What the features see of a box and the boxes around it, inner ones first."""
    key, b = [], box
    while b is not None and len(key) < 5:
        if b.seen is None:
            b.seen = (b.name, _bin(b.n), int(4 * b.links / b.n), b.h1, b.h3, b.button, _bin(b.prose), b.habit)
        key.append(b.seen)
        b = b.parent
    return tuple(key)


def _level_slots(key: tuple) -> tuple[list[int], list[int]]:
    """Slots of a box at its place in the chain."""
    plain, stated = [], []
    d, (name, n, links, h1, h3, button, prose, habit) = key
    plain.append(f"{name}{d}")
    plain.append(f"{'box' if d else 'own'}:{name}:n{n}:l{links}:{h1:d}{h3:d}{button:d}")
    plain.append(f"{d}:{h1:d}{h3:d}{button:d}:p{prose}:l{links}")
    if button and not h1:
        plain.append("buttonbox")
    if h3 and not h1:
        plain.append("h3box")
    if name in ("nav", "aside", "footer", "main", "article"):
        stated.append("a:" + name)
    if habit:
        stated.append("habit:" + habit)
    return [_slot(x) for x in plain], [_slot(x) for x in stated]


_LEVEL = Memo(_level_slots, 20_000)


def _box_slots(key: tuple) -> tuple[list[int], list[int]]:
    """Slots of a box chain: those of its shape, and those that state a convention (dropped at random in training)."""
    levels = [_LEVEL[x] for x in enumerate(key)]
    return [x for plain, _ in levels for x in plain], [x for _, stated in levels for x in stated]


def _leaf_slots(key: tuple) -> list[int]:
    path, lk, side, head, tail, sentence = key
    leaf = path[-1] if path else "body"
    return [
        _slot(x)
        for x in (
            "bias", lk, "pos:" + side, f"{side}:{lk}", "t:" + leaf, "p:" + ">".join(path), f"{leaf}:{lk}:{side}", f"first{head}", f"last{tail}",
            f"{lk}:{leaf}:s{sentence:d}",
        )
    ]


_SLOT = Memo(_slot, 50_000)


def _text_slots(text: str) -> list[int]:
    return [_SLOT[x] for x in _text_features(text)]


def block_keys(page: list[Leaf]) -> list[tuple]:
    """Per block its (box, leaf, text) keys; the block's features are the union of theirs."""
    n, out = len(page), []
    first = next((i for i, x in enumerate(page) if "h1" in x.path), -1)
    flags = [_sentence(x.text) for x in page]
    last = n - 1 - flags[::-1].index(True) if True in flags else -1
    boxes: dict[int, tuple] = {}
    for i, x in enumerate(page):
        box = boxes.get(id(x.box))
        if box is None:
            box = boxes[id(x.box)] = _box_key(x.box)
        side = "no" if first < 0 else "at" if i == first else "before" if i < first else "tail" if i > last else "in"
        lk = "L2" if x.link > 0.8 else "L1" if x.link > 0 else "L0"
        out.append((box, (x.path[-3:], lk, side, min(i, 3), min(n - 1 - i, 3), flags[i]), x.text))
    return out


# ---- the field


class Field:
    """Weights of a linear-chain CRF: per slot and role, and per pair of neighbouring roles."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights.astype(np.float32), moves.astype(np.float32)

    def decode(self, scores: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Viterbi over all pages at once: roles of the concatenated blocks."""
        lengths_ = np.asarray(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths_)[:-1]])
        order = np.argsort(-lengths_, kind="stable")
        starts, size = starts[order], lengths_[order]
        back = np.zeros((len(scores), len(ROLES)), np.int8)
        path = np.zeros(len(scores), np.int8)
        alive = int((size > 0).sum())
        best = scores[starts[:alive]].copy()
        final = best
        steps = int(size[0]) if len(size) else 0
        ends: list[np.ndarray] = []
        for t in range(1, steps):
            n = int((size > t).sum())
            if n < len(best):
                ends.append(best[n:])
                best = best[:n]
            cand = best[:, :, None] + self.moves
            back[starts[:n] + t] = cand.argmax(1)
            best = cand.max(1) + scores[starts[:n] + t]
        ends.append(best)
        final = np.concatenate(ends[::-1]) if alive else np.zeros((0, len(ROLES)))
        role = final.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = int((size > t).sum())
            at = starts[:n] + t
            path[at] = role[:n]
            if t:
                role[:n] = back[at, role[:n]]
        return path


def _marginals(scores: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of roles and the expected counts of moves, over padded pages (pages, steps, roles)."""
    p, t, k = scores.shape
    e = np.exp(moves)
    s = np.exp(scores - scores.max(2, keepdims=True))
    a = np.empty_like(s)
    z = np.empty((p, t, 1))
    a[:, 0] = s[:, 0]
    for i in range(t):
        if i:
            a[:, i] = np.where(mask[:, i, None], (a[:, i - 1] @ e) * s[:, i], a[:, i - 1])
        z[:, i] = a[:, i].sum(1, keepdims=True)
        a[:, i] /= z[:, i]
    b = np.ones((p, k))
    post = np.zeros_like(s)
    pairs = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        q = a[:, i] * b
        post[:, i] = q / q.sum(1, keepdims=True) * mask[:, i, None]
        if i:
            right = s[:, i] * b
            joint = a[:, i - 1, :, None] * e * right[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint[mask[:, i]].sum(0)
            b = np.where(mask[:, i, None], right @ e.T, b)
            b /= b.sum(1, keepdims=True)
    return post, pairs


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Field:
    """Fit by stochastic gradient (Adagrad) on the pages' own labels."""
    rng = np.random.default_rng(seed)
    box, leaf, text, data = Memo(_box_slots), Memo(_leaf_slots), Memo(_text_slots), []
    for html in pages:
        page = leaves(html)
        if 1 <= len(page) <= MAX_BLOCKS:
            keys = block_keys(page)
            data.append(([box[a][0] + leaf[b] + text[c] for a, b, c in keys], [box[a][1] for a, _, _ in keys], np.array(labels(page))))
    k, descent = len(ROLES), Descent()
    batch = 64
    data.sort(key=lambda d: len(d[2]))
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    for _ in range(epochs):
        for gi in rng.permutation(len(groups)):
            group = groups[gi]
            steps = max(len(y) for _, _, y in group)
            mask = np.zeros((len(group), steps), bool)
            slots, where = [], []
            gold = np.zeros((len(group), steps, k))
            pair_gold = np.zeros((k, k))
            for j, (plain, stated, y) in enumerate(group):
                keep = rng.random() < 0.5
                mask[j, : len(y)] = True
                gold[j, np.arange(len(y)), y] = 1
                np.add.at(pair_gold, (y[:-1], y[1:]), 1)
                for i in range(len(y)):
                    row = plain[i] + stated[i] if keep else plain[i]
                    slots += row
                    where += [j * steps + i] * len(row)
            descent.step(np.array(slots), np.array(where), mask, gold, pair_gold)
    return Field(descent.w, descent.moves)


class Descent:
    """Stochastic gradient (Adagrad) of the field's log-likelihood."""

    def __init__(self):
        k = len(ROLES)
        self.w, self.moves = np.zeros((FEATURES, k)), np.zeros((k, k))
        self.gw, self.gm = np.full((FEATURES, k), 1e-2), np.full((k, k), 1e-2)

    def step(self, slots: np.ndarray, where: np.ndarray, mask: np.ndarray, gold: np.ndarray, pair_gold: np.ndarray) -> None:
        """One step over a group of pages; ``where`` is the place in the padded group of each of the ``slots``."""
        k = len(ROLES)
        sc = np.zeros((mask.size, k))
        emit = self.w[slots]
        for c in range(k):
            sc[:, c] = np.bincount(where, emit[:, c], len(sc))
        post, pairs = _marginals(sc.reshape(*mask.shape, k), self.moves, mask)
        diff = ((gold - post) * mask[:, :, None]).reshape(-1, k)
        grad = np.empty((FEATURES, k))
        for c in range(k):
            grad[:, c] = np.bincount(slots, diff[where, c], FEATURES)
        grad -= 1e-3 * self.w
        self.gw += grad * grad
        self.w += 0.3 * grad / np.sqrt(self.gw)
        g = pair_gold - pairs - 1e-3 * self.moves
        self.gm += g * g
        self.moves += 0.3 * g / np.sqrt(self.gm)


def fit(cache: DataFrame, rows: int = SAMPLE_PAGES) -> Field:
    """Field trained on a bounded sample of cached pages (``rows`` pages of at most ``samples.PAGE_CHARS`` characters)."""
    return train([r["html"] for r in sample_rows(cache, "page_id", ["html"], "html", rows, PAGE_CHARS)])


def _raw(slots: list[int]) -> bytes:
    return np.array(slots, np.int16).tobytes()


def _example_memos() -> tuple[Memo, Memo, Memo]:
    """Slots as ``_examples`` writes them: plain and stated ones of boxes, those of leaves and of texts."""
    return Memo(lambda k: tuple(map(_raw, _box_slots(k)))), Memo(lambda k: _raw(_leaf_slots(k))), Memo(lambda k: _raw(_text_slots(k)))


def _examples(b, memos) -> dict:
    """Pages as training examples: per block its role, the numbers of its plain and stated slots, and these slots."""
    box, leaf, text = memos
    out: dict = {"h": [], "roles": [], "sizes": [], "slots": []}
    for html, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        page = leaves(html)
        if page:
            keys = block_keys(page)
            rows, stated, last = [], [], None
            for a, b, c in keys:
                if a is not last:  # blocks of one box have one key
                    last, (own, says) = a, box[a]
                rows.append(own + leaf[b] + text[c])
                stated.append(says)
            rows += stated
            out["h"].append(h)
            out["roles"].append(bytes(labels(page)))
            out["sizes"].append((np.fromiter(map(len, rows), np.int32, len(rows)) // 2).astype(np.int16).tobytes())
            out["slots"].append(b"".join(rows))
    return out


def _example(roles: bytes, sizes: bytes, slots: bytes) -> tuple:
    """(roles, plain slots, their blocks, stated slots, their blocks) of a page as ``_examples`` wrote it."""
    y, n, x = np.frombuffer(roles, np.uint8), np.frombuffer(sizes, np.int16), np.frombuffer(slots, np.int16)
    plain, stated = (np.repeat(np.arange(len(y), dtype=np.int32), part) for part in (n[: len(y)], n[len(y) :]))
    return y, x[: len(plain)], plain, x[len(plain) :], stated


def _descend(descent: Descent, data: list[tuple], epochs: int, rng: np.random.Generator) -> None:
    """Go over ``data`` in steps of 64 pages of like length, fewer where pages are very long."""
    k = len(ROLES)
    data = sorted(data, key=lambda d: len(d[0]))
    groups: list[list] = []
    for d in data:
        if not groups or len(groups[-1]) == 64 or (len(groups[-1]) + 1) * len(d[0]) > 64 * MAX_BLOCKS:
            groups.append([])
        groups[-1].append(d)
    for _ in range(epochs):
        for gi in rng.permutation(len(groups)):
            group = groups[gi]
            steps = len(group[-1][0])
            mask, gold, pair_gold = np.zeros((len(group), steps), bool), np.zeros((len(group), steps, k)), np.zeros((k, k))
            slots, where = [], []
            for j, (y, plain, at, stated, stated_at) in enumerate(group):
                mask[j, : len(y)] = True
                gold[j, np.arange(len(y)), y] = 1
                np.add.at(pair_gold, (y[:-1], y[1:]), 1)
                slots.append(plain)
                where.append(at + j * steps)
                if rng.random() < 0.5:
                    slots.append(stated)
                    where.append(stated_at + j * steps)
            descent.step(np.concatenate(slots), np.concatenate(where), mask, gold, pair_gold)


def fit_all(cache: DataFrame) -> Field:
    """Field trained on all cached pages, of any length.

    Pages fall by hash into groups of ``VISITS`` to twice as many. Each group is descended from
    nothing, in one pass; smaller tables in several, so that some ``VISITS`` pages are seen, but
    at most ``EPOCHS``. The field is the mean of the groups' fields, each slot weighted by how
    often a group holds it. Only slots are moved, never markup; sums are of whole numbers, so
    they don't depend on the order of the groups.
    """
    n = cache.count()
    groups, epochs = max(1, n // VISITS), max(1, min(EPOCHS, ceil(VISITS / max(1, n))))
    k = len(ROLES)

    def setup():
        gc.set_threshold(200_000, 20, 20)  # as for Labeller
        return _example_memos()

    def run(batches):
        descent, rng = Descent(), np.random.default_rng(7)
        seen, pages = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for piece in pieces(b):
                data = [_example(*r) for r in zip(*(piece.column(i).to_pylist() for i in (1, 2, 3)))]
                _descend(descent, data, epochs, rng)
                seen += np.bincount(np.concatenate([x for d in data for x in (d[1], d[3])]), minlength=FEATURES)
                pages += len(data)
        if pages:
            count = np.concatenate([seen, np.full(k, pages)])
            at = np.flatnonzero(count)
            whole = np.rint(np.concatenate([descent.w, descent.moves])[at] * count[at, None] * FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), *(pa.array(whole[:, c]) for c in range(k))], ["slot", "n", *(f"w{c}" for c in range(k))])

    some = cache.where("html is not null and html != ''").select("html", F.xxhash64("page_id", "html").alias("h"))
    rows = map_arrow(some, _examples, "h bigint, roles binary, sizes binary, slots binary", setup)
    parts = rows.repartitionById(groups, F.pmod("h", F.lit(groups)).cast("int")).sortWithinPartitions("h")
    fields = parts.mapInArrow(run, "slot int, n bigint, " + ", ".join(f"w{c} bigint" for c in range(k)))
    sums = fields.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(f"w{c}").alias(f"w{c}") for c in range(k))).toArrow()
    both = np.zeros((FEATURES + k, k))
    both[sums["slot"].to_numpy()] = np.stack([sums[f"w{c}"].to_numpy() for c in range(k)], 1) / sums["n"].to_numpy()[:, None] / FIXED
    return Field(both[:FEATURES], both[FEATURES:])


class Scores:
    """Score vectors of feature keys: a key's slots are summed once, then looked up by number."""

    def __init__(self, field: Field, limit: int = 300_000):
        self.field, self.limit = field, limit
        self.numbers: dict = {}
        self.table = np.zeros((0, len(ROLES)), np.float32)
        self.rows: list[list[int]] = []

    def number(self, key, slots) -> int:
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.numbers)
            self.rows.append(slots(key))
        return n

    def settle(self) -> np.ndarray:
        """The table, with the keys met since the last call added."""
        if self.rows:
            flat = np.fromiter((x for r in self.rows for x in r), np.int32)
            ends = np.cumsum([len(r) for r in self.rows])
            w = np.cumsum(self.field.weights[flat], axis=0, dtype=np.float64)
            total = w[ends - 1]
            total[1:] -= w[ends[:-1] - 1]
            self.table = np.concatenate([self.table, total.astype(np.float32)])
            self.rows = []
        return self.table

    def trim(self) -> None:
        if len(self.numbers) > self.limit:
            self.__init__(self.field, self.limit)


class Labeller:
    def __init__(self, field: Field):
        self.field, self.scores = field, Scores(field)
        # Trees of boxes hold no cycles: the collector would walk them again and again for nothing.
        gc.set_threshold(200_000, 20, 20)

    def roles(self, parsed: list[list[Leaf]]) -> list[list[int]]:
        """Roles of the blocks of each page, decoded together."""
        self.scores.trim()
        number, ids = self.scores.number, []
        both = lambda k: sum(_box_slots(k), [])
        for p in parsed:
            last = None
            for a, b, c in block_keys(p):
                if a is not last:
                    last, own = a, number(a, both)
                ids.append((own, number(b, _leaf_slots), number(c, _text_slots)))
        if not ids:
            return [[] for _ in parsed]
        score = self.scores.settle()[np.array(ids)].sum(1, dtype=np.float64)
        got = self.field.decode(score, [len(p) for p in parsed]).tolist()
        out, at = [], 0
        for p in parsed:
            out.append(got[at : at + len(p)])
            at += len(p)
        return out

    def pages(self, htmls: list[str | None]) -> list[list[tuple[str, int]]]:
        """(text, role) of each block of each page."""
        parsed = [leaves(h) for h in htmls]
        return [[(x.text, r) for x, r in zip(p, roles)] for p, roles in zip(parsed, self.roles(parsed))]


def _labeller(cache: DataFrame):
    field = cache.sparkSession.sparkContext.broadcast(fit(cache))
    return lambda: Labeller(field.value)


def chrome_blocks(cache: DataFrame) -> DataFrame:
    """``page_id, block_crc, role`` of blocks outside the main body.

    A block whose text also stands in the page's main body is left out. Null and empty html
    give no rows; repeated blocks of a page give one row per role.
    """

    def fn(b, lab: Labeller):
        out: dict = {"page_id": [], "block_crc": [], "role": []}
        for pid, page in zip(b.column(0).to_pylist(), lab.pages(b.column(1).to_pylist())):
            main = {t for t, r in page if r == MAIN}
            for t, r in dict.fromkeys(page):
                if r != MAIN and t not in main:
                    out["page_id"].append(pid)
                    out["block_crc"].append(crc(t))
                    out["role"].append(ROLES[r])
        return out

    return map_arrow(cache.select("page_id", "html"), fn, "page_id bigint, block_crc bigint, role string", _labeller(cache))


def main_text(cache: DataFrame) -> DataFrame:
    """``page_id, text``: the main body of each page, one block per line; '' for null and empty html."""

    def fn(b, lab: Labeller):
        pages = lab.pages(b.column(1).to_pylist())
        return {"page_id": b.column(0).to_pylist(), "text": ["\n".join(t for t, r in p if r == MAIN) for p in pages]}

    return map_arrow(cache.select("page_id", "html"), fn, "page_id bigint, text string", _labeller(cache))


def selection_check(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """How the recorded selection mode agrees with the main body found: per mode and reason, pages and mean share kept."""
    texts = main_text(cache).select("page_id", F.length("text").alias("kept"))
    modes = pages.where("page_id is not null").groupBy("page_id").agg(F.min(F.struct("content_mode_used", "content_selection_reason_code")).alias("m"))
    return (
        texts.join(modes, "page_id").groupBy(F.col("m.content_mode_used").alias("mode"), F.col("m.content_selection_reason_code").alias("reason"))
        .agg(F.count("*").alias("pages"), F.sum((F.col("kept") == 0).cast("long")).alias("without_body"), F.round(F.avg("kept"), 1).alias("mean_chars"))
    )
