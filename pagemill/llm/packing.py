"""Filling fixed-capacity containers with texts measured in tokens (problem 8).

Dynamic programming over the global histogram of sizes chooses bucket bounds that minimise
padding. Token-budget batches are then formed from the buckets: a batch is a pattern, so many
items of this bucket and so many of that, whose bounds fit the capacity, and it is repeated as
often as the buckets' counts allow. Planning sees the histogram only, whose size is bounded by the
capacity; items find their container by their rank in their bucket.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.session import materialise

CAPACITY = 2048
BUCKETS = 128
#: Distinct sizes that the dynamic programming takes as they are; beyond, sizes are rounded up to a grid of so many, which bounds its matrix (a capacity of 2,048 is never rounded).
MOST_SIZES = 4096
#: Rank files and the pattern they are used with; the path is a parameter of every function.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items ranked together in one sort.
RANK_GROUP = 200_000


def load_tokenizer(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens``; null and empty texts have 0."""

    def fn(b, enc):
        return {"doc_id": b.column(0).to_pylist(), "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]}

    return map_arrow(documents.select("doc_id", "text"), fn, "doc_id bigint, tokens bigint", lambda: load_tokenizer(tokenizer))


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct sizes, minimising total padding."""
    if len(sizes) > max(MOST_SIZES, buckets):
        step = -(-int(sizes[-1]) // MOST_SIZES)
        grid, at = np.unique(np.minimum(-(-sizes // step) * step, sizes[-1]), return_inverse=True)
        return bucket_bounds(grid, np.bincount(at, counts, len(grid)), buckets)
    n = len(sizes)
    if n <= buckets:
        return sizes.copy()
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    w = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(np.float64)
    # pad[i, j]: items of sizes[i..j] padded to sizes[j]
    pad = sizes[None, :] * (c[None, 1:] - c[:-1, None]) - (w[None, 1:] - w[:-1, None])
    pad[np.tril_indices(n, -1)] = np.inf
    best = pad[0].copy()
    choice = []
    for _ in range(1, buckets):
        cand = best[:-1, None] + pad[1:, :]
        at = cand.argmin(0)
        new = cand[at, np.arange(n)]
        take = new < best
        choice.append(np.where(take, at, -1))
        best = np.minimum(best, new)
    ends, j = [n - 1], n - 1
    for k in range(len(choice) - 1, -1, -1):
        i = choice[k][j]
        if i >= 0:
            j = int(i)
            ends.append(j)
    return sizes[np.array(sorted(set(ends)))]


def batch_patterns(bounds: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(bucket, items)]) of batches that use up all counts, each within the capacity by its bounds.

    The largest bucket left opens a batch; the room that remains takes the largest buckets that fit.
    """
    left = counts.astype(np.int64).copy()
    out = []
    while (alive := np.flatnonzero(left)).size:
        room, take = capacity, []
        for b in alive[::-1]:
            n = min(int(left[b]), room // int(bounds[b]))
            if n:
                take.append((int(b), n))
                room -= n * int(bounds[b])
            if room < bounds[alive[0]]:
                break
        times = min(int(left[b]) // n for b, n in take)
        for b, n in take:
            left[b] -= times * n
        out.append((times, take))
    return out


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, buckets: int = BUCKETS, across: bool = True) -> DataFrame:
    """``doc_id, piece, tokens, container``: where each document's tokens go.

    Only a document longer than a container is cut: into full containers of its own and a rest.
    A document without tokens needs no room and is put in container 0. Documents of null id are
    placed like others; repeated ids are separate items of equal name. ``across=False`` keeps the
    items of a batch to one bucket.
    """
    spark = documents.sparkSession
    sizes = materialise(token_counts(documents, tokenizer).withColumn("copy", F.monotonically_increasing_id()))
    full = F.floor(F.col("tokens") / capacity).cast("int")
    empty = sizes.where("tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("container"))
    rest = sizes.where(F.col("tokens") % capacity > 0).select("doc_id", "copy", full.alias("piece"), (F.col("tokens") % capacity).alias("tokens"))
    hist = rest.groupBy("tokens").agg(F.count("*").alias("n")).orderBy("tokens").collect()
    size = np.array([r["tokens"] for r in hist], np.int64)
    count = np.array([r["n"] for r in hist], np.int64)
    if not len(size):
        size, count = np.array([capacity]), np.array([0])
    bounds = bucket_bounds(size, count, buckets)
    bucket = np.searchsorted(bounds, size)
    per = np.bincount(bucket, count, len(bounds)).astype(np.int64)
    if across:
        patterns = batch_patterns(bounds, per, capacity)
    else:
        patterns = []
        for b in np.flatnonzero(per):
            n = max(1, capacity // int(bounds[b]))
            times, rest_ = divmod(int(per[b]), n)
            patterns += [(k, [(int(b), m)]) for k, m in ((times, n), (1, rest_)) if k and m]
    starts = np.zeros(len(bounds), np.int64)
    rows, base = [], 0
    for times, take in patterns:
        for b, n in take:
            rows.append((b, int(starts[b]), n, base))
            starts[b] += times * n
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    total = int(per.sum())
    groups = max(1, -(-total // RANK_GROUP))
    plan = spark.sparkContext.broadcast((bounds, table))
    salt = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(groups)).cast("int")
    by_size = spark.createDataFrame([(int(s), int(b)) for s, b in zip(size, bucket)], "tokens bigint, bucket int")  # at most one row per size below the capacity
    item = rest.join(F.broadcast(by_size), "tokens").withColumn("salt", salt)
    ahead = item.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    ahead = ahead.select("bucket", "salt", (F.sum("n").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("n")).alias("ahead"))
    ranked = item.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "copy")) - 1)
    ranked = ranked.join(ahead, ["bucket", "salt"]).select("doc_id", "piece", "tokens", "bucket", (F.col("rank") + F.col("ahead")).alias("rank"))

    def place(b, _):
        _, tab = plan.value
        bk, rk = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64), b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
        wide = 1 << 40
        at = np.searchsorted(tab[:, 0] * wide + tab[:, 1], bk * wide + rk, side="right") - 1
        box = tab[at, 3] + (rk - tab[at, 1]) // tab[at, 2]
        return {"doc_id": b.column(0).to_pylist(), "piece": b.column(1).to_pylist(), "tokens": b.column(2).to_pylist(), "container": box.tolist()}

    placed = map_arrow(ranked, place, "doc_id bigint, piece int, tokens bigint, container bigint")
    # Full containers are numbered after the others, by salted prefix counts.
    whole = sizes.where(F.col("tokens") >= capacity).select("doc_id", "copy", full.alias("k"), F.pmod(F.xxhash64("doc_id", "copy"), F.lit(groups)).cast("int").alias("salt"))
    before = whole.groupBy("salt").agg(F.sum("k").alias("n")).select("salt", (F.sum("n").over(Window.orderBy("salt")) - F.col("n")).alias("before"))
    seq = F.sum("k").over(Window.partitionBy("salt").orderBy("doc_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    whole = whole.withColumn("seq", seq).join(before, "salt").select("doc_id", F.posexplode(F.sequence(F.lit(1), F.col("k"))).alias("piece", "_n"), (F.col("seq") + F.col("before")).alias("seq"))
    whole = whole.select("doc_id", "piece", F.lit(capacity).cast("bigint").alias("tokens"), (F.col("seq") + F.col("piece") + base).cast("bigint").alias("container"))
    return placed.unionByName(whole).unionByName(empty)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, tokens, unused_share, overfull``."""
    per = placed.where("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("t"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(1 - F.sum("t") / (F.count("*") * capacity), 6).alias("unused_share"),
        F.sum((F.col("t") > capacity).cast("int")).alias("overfull"),
    )
