"""Equi-joins with a table of one row per key, where some keys have very many rows on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scratch import Scratch


def hot_keys(counts: DataFrame, keys: list[str], scratch: Scratch, rows: int = 256, limit: int = 200_000) -> DataFrame | None:
    """(keys, parts) of the keys of counts (keys, n) with over `rows` rows, or None; parts: the shares they are cut into.

    At most `limit` keys: where there are more, `rows` is doubled until there are not, so the list may be broadcast at
    any size of the table, and the keys left out have few rows against the whole."""
    hot = counts.where(F.col("n") > rows).select(*keys, "n")
    hot = hot if hasattr(counts, "_scratch_path") else scratch.save(hot)
    n = hot.count()
    bits = dict(hot.groupBy(F.length(F.bin("n"))).count().collect()) if n > limit else {}  # a row for each power of two
    for b in sorted(bits):
        if n <= limit:
            break
        n -= bits[b]
        rows = max(rows, (1 << b) - 1)
    return hot.where(F.col("n") > rows).select(*keys, F.ceil(F.col("n") / rows).cast("int").alias("parts")) if n else None


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner", hint: str | None = None) -> DataFrame:
    """big joined with small, which has at most one row for each of the keys; hot: what hot_keys() gives for big's rows.

    A hot key's rows are dealt over its parts by a hash of the whole row, and its row of small goes to every part: no task
    gets much more than a part of a key. Adaptive execution cannot do that where small is an aggregate by the same keys,
    as its shuffle then serves the join. Keys that are null match nothing, as in any equi-join.
    hint: how Spark is told to join with small."""
    hinted = lambda df: df.hint(hint) if hint else df
    if hot is None:
        return big.join(hinted(small), keys, how)
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in big.columns)), F.col("parts")), F.lit(0)).cast("int")
    left = big.join(hot, keys, "left").withColumn("_salt", salt).drop("parts")
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return left.join(hinted(right), [*keys, "_salt"], how).drop("_salt")


def fitting(small: DataFrame, rows: int = 100_000) -> DataFrame:
    """small, marked to be sent whole to every executor if it has at most `rows` rows. It is counted, so a written table."""
    return F.broadcast(small) if small.count() <= rows else small


def dealt_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, scratch: Scratch, how: str = "inner", rows: int = 100_000) -> DataFrame:
    """hot_join() by the rows that big has for each of the keys (counts: keys, n); no row of big moves where small (a written
    table) has at most `rows` rows. A larger one is never sent whole, however small its file: Spark would do so up to 10 MB
    of it, through the driver, and again in each round of a loop."""
    if small.count() <= rows:
        return big.join(F.broadcast(small), keys, how)
    return hot_join(big, small, keys, hot_keys(counts, keys, scratch), how, "merge")
