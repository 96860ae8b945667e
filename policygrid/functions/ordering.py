"""Deterministic orders and global ranks that don't pass all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.session import fresh_name


def seeded(seed: int, *cols: Column) -> Column:
    """md5 of the seed and the values: the order that stands for a random draw. Null counts as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def hash_rank(df: DataFrame, digest: Column, *ties: Column, name: str = "rank") -> DataFrame:
    """`df` with the 1-based rank by the hexadecimal `digest`, then `ties`, over all rows.

    Rows are ranked within the 4,096 ranges of the first three digits and offset by
    the counts of the ranges before, so only those counts meet in one task.
    """
    d, b, n = (fresh_name(df.columns, c) for c in ("_digest", "_range", "_before"))
    cut = df.withColumn(d, digest).withColumn(b, F.substring(d, 1, 3))
    counts = cut.groupBy(b).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(b), (F.sum("_n").over(W.orderBy(b).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias(n))
    ranked = cut.join(F.broadcast(before), b)  # at most 4,096 rows
    inside = F.row_number().over(W.partitionBy(b).orderBy(d, *ties))
    return ranked.withColumn(name, inside.cast("long") + F.col(n)).drop(d, b, n)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank", salt: Column | None = None, salts: int = 16) -> DataFrame:
    """The first k rows per key with their rank.

    With `salt` the rows of a key are cut to k in `salts` parts first, so a key that
    holds a large share of all rows is ranked by several tasks.
    """
    if salt is not None:
        s = fresh_name(df.columns, "_salt")
        part = W.partitionBy(*keys, s).orderBy(*order)
        df = df.withColumn(s, F.pmod(F.xxhash64(salt), F.lit(salts))).withColumn(name, F.row_number().over(part)).where(F.col(name) <= k).drop(name, s)
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
