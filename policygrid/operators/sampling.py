"""Per-query hits from traces, balanced samples, trend labels and judge inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions.ordering import hash_rank, seeded, top_per


def query_hits(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key (nulls are keys too): what rank 1 retrieved, whether it was relevant, the first query text.

    Groups without a rank 1 are dropped. Columns other than the trace's own are ignored.
    """
    first = traces.groupBy(*keys).agg(
        F.min_by(F.struct("retrieved_doc_id", "retrieved_score", "is_relevant_doc"), F.col("retrieved_rank")).alias("x"), F.min("retrieved_rank").alias("best"),
        F.count_if(F.col("is_relevant_doc") > 0).alias("n_relevant"),
    )
    return first.where("best = 1").select(*keys, "x.*", (F.col("x.is_relevant_doc") > 0).alias("hit1"), "n_relevant")


def round_robin(pool: DataFrame, group: str, n: int, key: str, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """n rows (per `by`): the first of every group in alphabetical order, then the second of every group, and so on.

    Order within a group is the seeded one. A pool of at most n rows comes out whole.
    Each group is cut to n rows by rank before the groups meet.
    """
    by = by or []
    order = [seeded(seed, F.col(key)), F.col(key)]
    # A group can hold a large share of all rows, so it is cut to n in salted parts first.
    inside = top_per(pool, [*by, group], order, n, name="_k", salt=F.col(key))
    place = F.row_number().over(W.partitionBy(*by).orderBy("_k", group))
    return inside.withColumn("sample_no", place).where(F.col("sample_no") <= n).drop("_k")


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows in seeded order."""
    return df.orderBy(seeded(seed, F.col(key)), key).limit(n)


def with_continent(df: DataFrame, country: str, continents: DataFrame, default: str = "Other") -> DataFrame:
    """`df` with continent from a lookup of country and continent (trimmed); `default` where it has none."""
    look = continents.select(F.trim("country").alias("_country"), "continent").dropDuplicates(["_country"])
    return df.withColumn("_country", F.trim(country)).join(look, "_country", "left").withColumn("continent", F.coalesce("continent", F.lit(default))).drop("_country")


def trend_label(first: Column, last: Column) -> Column:
    """stable if the change is under 5 % of the first value, else increasing or decreasing."""
    change = last - first
    return F.when(F.abs(change) < 0.05 * (F.abs(first) + 1e-9), "stable").when(change > 0, "increasing").otherwise("decreasing")


def trends(long: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, first_value, last_value, delta, trend of each series; its ends are found by aggregates."""
    ends = long.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.col(order)).alias("first_value"), F.max_by(value, F.col(order)).alias("last_value"))
    return ends.withColumn("delta", F.col("last_value") - F.col("first_value")).withColumn("trend", trend_label(F.col("first_value"), F.col("last_value")))


def metadata_context(df: DataFrame, columns: dict[str, str], fallback: list[str]) -> Column:
    """`Label: value` lines of the columns that hold something; else those of `fallback` as a sentence."""
    shown = lambda c: F.when(~F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin("", "nan", "none"), F.trim(F.col(c).cast("string")))
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{label}: "), shown(c)) for c, label in columns.items() if c in df.columns]))
    other = F.concat_ws(", ", *[F.coalesce(F.trim(F.col(c)), F.lit("")) for c in fallback])
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(other)


def judge_input(series_text: Column, chunk_text: Column, metadata: Column) -> Column:
    """What a judge reads: the series if there is one, else the top chunk, else the metadata."""
    return F.coalesce(F.nullif(F.trim(series_text), F.lit("")), F.nullif(F.trim(chunk_text), F.lit("")), metadata)


def grid_sample(grid: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of a parameter grid without replacement, back in the order of `key`."""
    return hash_rank(grid, seeded(seed, F.col(key)), F.col(key), name="_r").where(F.col("_r") <= n).drop("_r").orderBy(key)
