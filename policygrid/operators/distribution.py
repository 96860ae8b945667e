"""Distributions behind the plots: shares, multi-valued shares, counts, codes, contingency, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions.text import split_sectors


def share(df: DataFrame, value: Column, name: str = "value", by: list[str] | None = None) -> DataFrame:
    """by, value, n, pct: share of each value in percent of the rows that have one (null rows don't count)."""
    by = by or []
    counts = df.select(*by, value.alias(name)).where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(*by)))


def sector_share(df: DataFrame, col: str, by: list[str] | None = None, drop: str = "Other") -> DataFrame:
    """share() over the parts of a `;` list, blank ones and `drop` left out."""
    return share(df.select(*(by or []), F.explode(split_sectors(F.col(col), drop)).alias("sector")), F.col("sector"), "sector", by)


def side_by_side(left: DataFrame, right: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join of two count or share tables on `key`; a missing side is 0."""
    a, b = left.select(key, F.col(value).alias(names[0])), right.select(key, F.col(value).alias(names[1]))
    return a.join(b, key, "full_outer").fillna(0, list(names))


def label_codes(df: DataFrame, col: str, prefix: str = "S") -> DataFrame:
    """col, code: `S01`, `S02`, ... by the order of the different labels (a vocabulary, not the rows)."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
    return distinct.withColumn("code", F.format_string(f"{prefix}%02d", F.row_number().over(W.orderBy(col))))


def contingency(df: DataFrame, rows: str, cols: str, values: list[str] | None = None) -> DataFrame:
    """Counts of `rows` by `cols`, 0 where there are none."""
    grouped = df.groupBy(rows)
    return (grouped.pivot(cols, values) if values else grouped.pivot(cols)).agg(F.count(F.lit(1))).fillna(0)


def score_histogram(df: DataFrame, score: str, by: str, bins: int = 30) -> DataFrame:
    """by, bin, lo, hi, n, density: equal bins between the least and greatest score, densities per class.

    Two passes of map-side aggregates; the range is one row. Equal scores fall into
    one bin of width 0, whose density is null.
    """
    df = df.where(F.col(score).isNotNull() & F.col(by).isNotNull()).select(by, F.col(score).cast("double").alias("_s"))
    lo, hi = df.agg(F.min("_s"), F.max("_s")).first()
    lo, width = F.lit(lo).cast("double"), F.lit(((hi or 0) - (lo or 0)) / bins)
    place = F.when(width > 0, F.least(F.floor((F.col("_s") - lo) / width), F.lit(bins - 1))).otherwise(0)
    counts = df.groupBy(by, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(by))  # at most `bins` rows per class
    return counts.select(by, "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n", F.try_divide(F.col("n").cast("double"), total * width).alias("density"))


def inverted_index(df: DataFrame, key: str, values: Column, name: str) -> DataFrame:
    """name, key of every different pair of a value in the list `values` and a key that has it: a row per entry, so a value of any number of keys is no array."""
    return df.select(F.col(key), F.explode(values).alias(name)).where(F.col(name).isNotNull() & F.col(key).isNotNull()).distinct().select(name, key)
