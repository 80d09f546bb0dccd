"""Bounded, deterministic samples of rows to fit small models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a model is fitted on, and the longest text or page taken into the sample. Bounds of the driver's memory.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
PAGE_CHARS = 200_000
#: Rows taken, shortest first, where every text is over the bound.
SHORTEST_ROWS = 16
#: Groups of a stratified sample: those with most rows.
MAX_GROUPS = 200


def _below(share: float):
    """Hash value under which this share of all keys lies."""
    return F.lit(int(-(2**63) + 2**64 * min(1.0, share)) if share < 1 else 2**63 - 1)


def sample_rows(df: DataFrame, key: str, columns: list[str], text: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list:
    """The ``rows`` rows of least key hash whose text is neither blank nor over ``chars``; the same rows on every run.

    A count of the keys sets a hash limit that lets through little more than ``rows``, so no task
    holds or sends more than its share. Where so many texts are out of bounds that too few rows
    come, the limit is raised until the sample is full or the table is used up. If no text is in
    bounds, the shortest are taken, whatever their length: a model is never fitted on nothing
    while there is text.
    """
    h = F.xxhash64(key)
    some = df.where(F.col(text).isNotNull() & (F.length(text) >= 20)).select(*columns, h.alias("_h"), F.length(text).alias("_n"))
    n = df.where(F.col(key).isNotNull()).count()
    share = 1.5 * rows / n if n > 2 * rows else 1.0
    while True:
        ok = some.where(F.col("_n") <= chars)
        got = (ok.where(F.col("_h") <= _below(share)) if share < 1 else ok).orderBy("_h").limit(rows).drop("_h", "_n").collect()
        if len(got) >= rows or share >= 1:
            return got or some.orderBy("_n", "_h").limit(SHORTEST_ROWS).drop("_h", "_n").collect()
        share = min(1.0, share * max(2.0, 1.5 * rows / max(1, len(got))))


def sample_groups(df: DataFrame, key: str, group: Column, columns: list[str], text: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list:
    """Rows of least key hash of each of the ``MAX_GROUPS`` commonest groups, an equal share of ``rows`` for each.

    A rare group gives all its rows, so what is rare in the table is not rare in the sample. Rows
    of a null group are left out. Each result row has its group in ``_g`` and, in ``_s``, how many
    rows of the table the group has.
    """
    some = df.where(F.col(text).isNotNull() & F.length(text).between(20, chars)).select(*columns, group.alias("_g"), F.xxhash64(key).alias("_h")).where("_g is not null")
    sizes = some.groupBy("_g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_g").limit(MAX_GROUPS).collect()
    if not sizes:
        return []
    per = max(1, rows // len(sizes))
    limits = {r["_g"]: int(-(2**63) + 2**64 * min(1.0, 1.5 * per / r["n"])) if r["n"] > 2 * per else 2**63 - 1 for r in sizes}
    spark = df.sparkSession
    size = {r["_g"]: r["n"] for r in sizes}
    table = spark.createDataFrame([(g, t, size[g]) for g, t in limits.items()], "_g string, _t bigint, _s bigint")  # at most MAX_GROUPS rows
    got = some.join(F.broadcast(table), "_g").where("_h <= _t").drop("_t").collect()
    out: dict[str, list] = {}
    for r in sorted(got, key=lambda r: r["_h"]):
        out.setdefault(r["_g"], []).append(r)
    return [r for g in sorted(out) for r in out[g][:per]]
