"""Leakage-safe folds: group keys, grouped K-fold, region join, train and test views, held-out picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions.ordering import hash_rank, seeded
from policygrid.functions.text import strip_space
from policygrid.session import fresh_name, require_columns

#: Columns that can group the filings of a policy, the first one in use wins. Fixed values.
GROUP_COLUMNS = ("family_id", "internal_family_id", "family_title", "document_id", "doc_id")


def present_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of `wanted` that `df` has, in that order."""
    return [c for c in wanted if c in df.columns]


def first_used_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first column with any value that isn't blank, over the whole table; one row of flags reaches the driver."""
    found = present_columns(df, candidates)
    if not found:
        return None
    flags = df.agg(*[F.coalesce(F.max(strip_space(F.col(c).cast("string")) != ""), F.lit(False)).alias(c) for c in found]).first()
    return next((c for c in found if flags[c]), None)


def group_key(df: DataFrame, candidates: tuple[str, ...] = GROUP_COLUMNS, fallback: str = "UNKNOWN_FAMILY") -> Column:
    """The trimmed column that groups `df`; its blank values all fall into one group `fallback`."""
    used = first_used_column(df, list(candidates))
    return F.lit(fallback) if used is None else F.coalesce(F.nullif(strip_space(F.col(used).cast("string")), F.lit("")), F.lit(fallback))


def assign_group_folds(groups: DataFrame, key: str, n_folds: int, seed: int = 42) -> DataFrame:
    """key, fold of each different group: groups in seeded order are dealt round robin.

    Raises ValueError for fewer than two folds or more folds than groups.
    """
    if n_folds < 2:
        raise ValueError("n_folds must be at least 2")
    distinct = groups.select(key).distinct()
    if len(distinct.limit(n_folds).collect()) < n_folds:
        raise ValueError("more folds than groups")
    ranked = hash_rank(distinct, seeded(seed, F.col(key)), F.col(key), name="_place")
    return ranked.select(key, F.pmod(F.col("_place") - 1, F.lit(n_folds)).cast("int").alias("fold"))


def grouped_kfold(df: DataFrame, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """`df` with group_key and fold (an existing column `fold` is replaced)."""
    keyed = df.drop("fold").withColumn("group_key", group_key(df))
    return keyed.join(assign_group_folds(keyed, "group_key", n_folds, seed), "group_key")


def leaking_groups(df: DataFrame, key: str = "group_key", fold: str = "fold") -> DataFrame:
    """key, n_folds of groups that lie in more than one fold; empty if nothing leaks."""
    spread = df.groupBy(key).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"), F.count_distinct(fold).alias("n_folds"))
    return spread.where("lo <> hi").select(key, "n_folds")


def check_folds(df: DataFrame, n_folds: int) -> None:
    """Raise ValueError if a group leaks or a fold is empty."""
    if not leaking_groups(df).isEmpty():
        raise ValueError("a group lies in several folds")
    used = df.select("fold").distinct().count()
    if used < n_folds:
        raise ValueError(f"only {used} of {n_folds} folds hold rows")


def join_region(policies: DataFrame, regions: DataFrame, left: str, right: str, extra: list[str]) -> DataFrame:
    """Left join of region columns; unchanged if a key column is missing. Rows of `regions` with equal keys multiply."""
    if left not in policies.columns or right not in regions.columns:
        return policies
    key = fresh_name(policies.columns, "_region_key")
    wanted = regions.select(F.col(right).alias(key), *present_columns(regions, extra))
    return policies.join(wanted, policies[left] == wanted[key], "left").drop(key)


def fold_view(df: DataFrame, held_out: int, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold; with `key`, train rows whose key is also in test are left out."""
    test = df.where(F.col("fold") == held_out)
    train = df.where(F.col("fold") != held_out)
    return (train.join(test.select(key).distinct(), key, "left_anti") if key else train), test


def fold_sizes(df: DataFrame) -> DataFrame:
    """fold, n_train, n_test in one pass: train is all rows of other folds."""
    sizes = df.where("fold is not null").groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    return sizes.withColumn("n_train", F.sum("n_test").over(W.partitionBy()) - F.col("n_test")).select("fold", "n_train", "n_test")  # one row per fold


def validation_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """`df` with is_validation: the first max(1, round(n * share)) rows in seeded order, but one row always trains."""
    require_columns(df, key)
    ranked = hash_rank(df, seeded(seed, F.col(key)), F.col(key), name="_place")
    n = df.count()
    size = min(max(1, int(n * share + 0.5)), max(0, n - 1))
    return ranked.withColumn("is_validation", F.col("_place") <= size).drop("_place")


def regional_test_pick(df: DataFrame, key: str, region: str, country: str, size: int = 100, seed: int = 0) -> DataFrame:
    """A test set of `size` rows: one per country at most, regions first, topped up in seeded order.

    The first row per country in seeded order is its candidate; the first candidate
    of every region comes before all others.
    """
    order = seeded(seed, F.col(key))
    cand = df.where(F.col(country).isNotNull() & F.col(region).isNotNull()).withColumn("_o", order)
    # Candidates are one per country, picked by an aggregate; what follows is a table of countries.
    best = cand.groupBy(country).agg(F.min_by(F.struct(key, region, "_o"), F.struct("_o", key)).alias("b")).select(F.col(country), F.col(f"b.{key}").alias(key), F.col(f"b.{region}").alias(region), F.col("b._o").alias("_o"))
    lead = best.withColumn("_r", F.row_number().over(W.partitionBy(region).orderBy("_o", key)))
    return lead.orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), "_o", key).limit(size).select(key, region, country)


def held_out(df: DataFrame, folds: list[int]) -> DataFrame:
    """`df` once per held-out fold (`held`), as its train rows: those of other folds."""
    return df.withColumn("held", F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("fold"))))


def counts_per_fold(df: DataFrame, key: str, folds: list[int]) -> DataFrame:
    """fold, key, n_train, n_test for every fold and every key there is: one count, train is the total less the fold's own."""
    total = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"), F.sum("n").alias("total"))
    each = total.select(key, "own", "total", F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold")).withColumn("n_test", F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0).cast("bigint")))
    return each.select("fold", key, (F.col("total") - F.col("n_test")).alias("n_train"), "n_test")


def validation_splits(df: DataFrame, key: str, share: float, folds: list[int], seed: int = 0) -> DataFrame:
    """held, key, is_validation: validation_split() of the train rows of each held-out fold.

    Ranks are counted per fold in the ranges of hash_rank(), so no task sees all rows.
    """
    order = seeded(seed, F.col(key))
    rows = df.select(key, "fold", order.alias("_d"), F.substring(order, 1, 3).alias("_range"))
    # All folds share the order: the ranges are counted once per fold, and those of the other folds added up.
    n = rows.groupBy("_range", "fold").agg(F.count(F.lit(1)).alias("_n"))
    counts = n.groupBy("_range").agg(F.map_from_entries(F.collect_list(F.struct("fold", "_n"))).alias("_c"))
    at = counts.withColumn("held", F.explode(F.array(*[F.lit(f) for f in folds])))
    size = F.aggregate(F.map_values(F.map_filter("_c", lambda k, v: k != F.col("held"))), F.lit(0).cast("bigint"), lambda a, v: a + v)
    sized = at.select("_range", "held", size.alias("_size"))
    before = sized.withColumn("_before", F.sum("_size").over(W.partitionBy("held").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)))  # at most 4,096 rows per fold
    total = F.sum("_size").over(W.partitionBy("held"))
    before = before.select("_range", "held", F.coalesce("_before", F.lit(0)).alias("_before"), total.alias("_total"))
    ranked = held_out(rows, folds).join(F.broadcast(before), ["_range", "held"])
    place = F.row_number().over(W.partitionBy("held", "_range").orderBy("_d", key)) + F.col("_before")
    most = F.least(F.greatest(F.lit(1), F.floor(F.col("_total") * share + 0.5)), F.greatest(F.lit(0), F.col("_total") - 1))
    return ranked.select("held", key, (place <= most).alias("is_validation"))
