"""Joins on keys of which one may hold a large share of all rows: such a key is split into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may have to join; a larger key is split into so many parts.
HOT_ROWS = 100_000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``key, parts`` of the keys with more than ``HOT_ROWS`` rows, from their counts: at most one row per ``HOT_ROWS`` rows, so it is broadcast."""
    return counts.where(F.col(n) > HOT_ROWS).select(key, F.ceil(F.col(n) / HOT_ROWS).cast("int").alias("_parts"))


def split_rows(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """Rows with ``_salt``: the part of their key that ``by`` puts them in, 0 for other keys."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def for_each_part(side: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The side that is joined to split rows, once for each part of its key."""
    side = side.join(F.broadcast(hot), key, "left")
    return side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
