"""Scaling on train rows, history windows, one-hot sectors, examples and negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policygrid.functions.ordering import hash_rank, seeded
from policygrid.session import durable

#: Sector vocabulary of the one-hot vector; the order is the position. Fixed values.
SECTORS = (
    "Energy", "LULUCF", "Buildings", "Economy-wide", "Water", "Urban", "Transport", "Public Sector", "Health", "Environment", "Agriculture",
    "Industry", "Tourism", "Waste", "Coastal zones", "Cross Cutting Area", "Disaster Risk Management (Drm)", "Finance", "Rural", "Social development",
    "Adaptation", "Residential and Commercial",
)


def fit_scaler(long: DataFrame, train: Column, value: str = "value") -> DataFrame:
    """feature, mean, std of the train rows: population deviation, 1 where it is 0."""
    sums = long.where(train).groupBy("feature").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return sums.select("feature", "mean", F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("std"))


def scale(long: DataFrame, params: DataFrame, value: str = "value") -> DataFrame:
    """`value` less the mean over the deviation; a missing value counts as 0 before scaling, features without parameters are left out."""
    return long.join(params, "feature").withColumn(value, (F.coalesce(F.col(value), F.lit(0.0)) - F.col("mean")) / F.col("std")).drop("mean", "std")


def window_cells(anchors: DataFrame, panel: DataFrame, windows: list[int], features: list[str]) -> DataFrame:
    """anchor columns, window, pos, step_year, feature, value for the years [y - w + 1, y] of each anchor (country, year).

    `features` are the panel's columns. Years a country lacks come out as 0 for every
    feature. The largest window is joined once, on country, year and feature; smaller
    ones are its last positions.
    """
    most = max(windows)
    each = anchors.select("*", F.explode(F.sequence(F.col("year") - most + 1, F.col("year"))).alias("_y"))
    wanted = each.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    cells = panel.select(F.col("country"), F.col("year").alias("_y"), "feature", F.col("value"))
    joined = wanted.join(cells, ["country", "_y", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    each = joined.withColumn("window", F.explode(F.array(*[F.lit(w) for w in sorted(set(windows))]))).where(F.col("_y") > F.col("year") - F.col("window"))
    return each.withColumn("pos", (F.col("_y") - F.col("year") + F.col("window") - 1).cast("int")).withColumnRenamed("_y", "step_year")


def window_summary(anchors: DataFrame, panel: DataFrame, windows: list[int]) -> DataFrame:
    """country, year, window, feature, n_features, mean, last over the tensors of all distinct anchors (country, year).

    All features of the panel count. Only readings are joined; the years without one
    are zeros that the mean counts. The features without any reading in a window are
    one row: no feature, their number, and 0.
    """
    ws = sorted(set(windows))
    at = anchors.select("country", "year").distinct()
    steps = at.select("*", F.explode(F.sequence(F.col("year") - ws[-1] + 1, F.col("year"))).alias("_y"))
    cells = panel.select("country", F.col("year").alias("_y"), "feature", "value")
    age, v = F.col("year") - F.col("_y"), F.col("value")
    sums = [F.struct(F.lit(w).alias("window"), F.count_if(age < w).alias("n"), (F.sum(F.when(age < w, v)) / w).alias("mean")) for w in ws]
    each = steps.join(cells, ["country", "_y"]).groupBy("country", "year", "feature").agg(F.array(*sums).alias("w"), F.coalesce(F.max(F.when(age == 0, v)), F.lit(0.0)).alias("last"))
    read = durable(each.select("country", "year", "feature", F.explode("w").alias("w"), "last").where("w.n > 0").select("country", "year", "w.window", "feature", F.lit(1).cast("bigint").alias("n_features"), "w.mean", "last"), "windows")
    n = panel.select("feature").distinct().count()
    every = at.select("*", F.explode(F.array(*[F.lit(w) for w in ws])).alias("window"))
    some = read.groupBy("country", "year", "window").agg(F.count(F.lit(1)).alias("_n"))
    rest = every.join(some, ["country", "year", "window"], "left").withColumn("n_features", F.lit(n) - F.coalesce("_n", F.lit(0))).where("n_features > 0")
    zero = rest.select("country", "year", "window", F.lit(None).cast("string").alias("feature"), "n_features", F.lit(0.0).alias("mean"), F.lit(0.0).alias("last"))
    return read.unionByName(zero)


def window_tensor(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, window, tensor: rows by position, columns by feature name."""
    rows = cells.groupBy(*keys, "window", "pos").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("r"))
    return rows.groupBy(*keys, "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("r.value").alias("v")))), lambda x: x["v"]).alias("tensor"))


def top_padded(tensor: Column, window: int) -> Column:
    """A tensor (array of rows) with rows of zeros put before it until it has `window` rows; null for an empty one, whose width isn't known."""
    zeros = F.transform(F.get(tensor, F.lit(0)), lambda x: F.lit(0.0))
    return F.when(F.size(tensor) > 0, F.concat(F.array_repeat(zeros, F.greatest(F.lit(window) - F.size(tensor), F.lit(0))), tensor))


def sector_one_hot(sectors: Column, vocabulary: tuple[str, ...] = SECTORS) -> Column:
    """0/1 for each sector of the vocabulary; unknown sectors are ignored, null is all 0."""
    known = F.coalesce(sectors, F.array().cast("array<string>"))
    return F.array(*[F.array_contains(known, F.lit(s)).cast("int") for s in vocabulary])


def negative_pairs(train: DataFrame, key: str, summary: str, k: int, seed: int) -> DataFrame:
    """anchor, negative, negative_no: for each row k rows of different summaries, none twice.

    Different summaries are ranked in seeded order and stand for their smallest key;
    an anchor takes the k after its own, going round. Each join is on the rank, so
    the work grows with rows times k. An anchor with fewer other summaries takes all.
    """
    texts = train.groupBy(summary).agg(F.min(key).alias("_rep"))
    ranked = hash_rank(texts, seeded(seed, F.col(summary)), F.col(summary), name="_r")
    n = texts.count()
    steps = ranked.select(F.col(summary), "_r", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(k, n - 1))))).alias("negative_no")).where(F.lit(n > 1))
    nxt = steps.withColumn("_t", F.pmod(F.col("_r") - 1 + F.col("negative_no"), F.lit(max(1, n))) + 1)
    neg = nxt.join(ranked.select(F.col("_r").alias("_t"), F.col("_rep").alias("negative")), "_t").select(summary, "negative_no", "negative")
    return train.select(F.col(key).alias("anchor"), summary).join(neg, summary).select("anchor", "negative_no", "negative")


def fold_negatives(rows: DataFrame, key: str, summary: str, fold: str, folds: list[int], k: int, seed: int) -> DataFrame:
    """fold, anchor, negative, negative_no: negative_pairs() of the train rows of each held-out fold, with seed + fold. Rows without a fold are always train rows."""
    parts = [negative_pairs(rows.where(~F.col(fold).eqNullSafe(f)), key, summary, k, seed + f).withColumn("fold", F.lit(f)) for f in folds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def examples(policies: DataFrame, panel: DataFrame, windows: list[int], features: list[str], key: str) -> DataFrame:
    """key, window, anchor_summary, positive_time_series, positive_sector, doc_id, sector, country of each policy.

    `policies` has key, country, year, geography, family_summary, sector (a list) and document_id.
    """
    series = window_tensor(window_cells(policies.select(key, "country", "year"), panel, windows, features), [key])
    return policies.join(series, key).select(
        key, "window", F.col("family_summary").alias("anchor_summary"), F.col("tensor").alias("positive_time_series"), sector_one_hot(F.col("sector")).alias("positive_sector"),
        F.coalesce("document_id", F.lit("")).alias("doc_id"), "sector", F.trim("geography").alias("country"))


def examples_at(policies: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """examples() with tensors by place: `series` has at (country, year), window and tensor, and policies of one place and year share it; _test goes along."""
    placed = series.select("at.country", "at.year", "window", "tensor")
    return policies.join(placed.withColumnRenamed("country", "_c").withColumnRenamed("year", "_y"), (F.col("country") == F.col("_c")) & (F.col("year") == F.col("_y"))).select(
        key, "window", F.col("family_summary").alias("anchor_summary"), F.col("tensor").alias("positive_time_series"), sector_one_hot(F.col("sector")).alias("positive_sector"),
        F.coalesce("document_id", F.lit("")).alias("doc_id"), "sector", F.trim("geography").alias("country"), "_test")


def pair_records(records: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """anchor, negative_no, window and the fields of a pair: an anchor's example beside the series and sectors of each of its negatives."""
    a = records.select(F.col(key).alias("anchor"), "window", "anchor_summary", "positive_time_series", "positive_sector")
    n = records.select(F.col(key).alias("negative"), "window", F.col("positive_time_series").alias("negative_time_series"), F.col("positive_sector").alias("negative_sector"))
    return pairs.select("anchor", "negative", "negative_no").join(a, "anchor").join(n, ["negative", "window"]).drop("negative")
