"""Table selection for policies: series descriptors, Pearson, trend and semantic scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions.ordering import top_per

#: Components of a descriptor in order. Fixed values.
DESCRIPTOR = ("mean", "std", "min", "max", "slope", "delta", "q75", "last")


def series_descriptor(df: DataFrame, keys: list[str], order: str | list[str], value: str) -> DataFrame:
    """keys, n, and the eight components: mean, population deviation, min, max, slope and last-minus-first over max(|mean|, 1e-6), upper quartile, last.

    A series with fewer than two values has eight zeros.
    """
    w = W.partitionBy(*keys).orderBy(order)
    spot = df.where(F.col(value).isNotNull()).withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    v, i = F.col(value).cast("double"), F.col("_i")
    raw = spot.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.covar_pop(v, i).alias("_c"), F.var_pop(i).alias("_v"), F.min_by(v, i).alias("_first"), F.percentile(v, F.lit(0.75)).alias("q75"), F.max_by(v, i).alias("last"),
    )
    unit = F.greatest(F.abs("mean"), F.lit(1e-6))
    cols = {c: F.col(c) for c in DESCRIPTOR} | {"slope": F.try_divide("_c", "_v") / unit, "delta": (F.col("last") - F.col("_first")) / unit}
    return raw.select(*keys, "n", *[F.when(F.col("n") >= 2, cols[c]).otherwise(0.0).alias(c) for c in DESCRIPTOR])


def table_descriptor(long: DataFrame, locations: DataFrame, keys: list[str], width: int, most: int = 6) -> DataFrame:
    """keys, table_idx and the mean descriptor of a table's first `most` features over the given locations.

    `locations` has keys, country and year; values are those of the `width` years
    before the year. Series with fewer than two values don't count.
    """
    names = long.select("table_idx", "feature").distinct()
    first = names.withColumn("_r", F.row_number().over(W.partitionBy("table_idx").orderBy("feature"))).where(F.col("_r") <= most).drop("_r")
    used = long.join(first, ["table_idx", "feature"], "left_semi")
    at = locations.select(*keys, "country", F.col("year").alias("_y"))
    rows = used.join(at, "country").where(F.col("year").between(F.col("_y") - width, F.col("_y") - 1))
    each = series_descriptor(rows, [*keys, "table_idx", "country", "feature"], "year", "value").where("n >= 2")
    return each.groupBy(*keys, "table_idx").agg(*[F.avg(c).alias(c) for c in DESCRIPTOR])


def place_descriptor(long: DataFrame, spots: DataFrame, width: int, most: int = 6) -> DataFrame:
    """country, region, year, table_idx and the mean descriptor of a table's first `most` features over country, region and World.

    `spots` has country, region and year. Each distinct place and year is described
    once; a place named twice counts twice. Series with fewer than two values don't
    count. "european union" matches as a part of the country.
    """
    names = long.select("table_idx", "feature").distinct()
    first = names.withColumn("_r", F.row_number().over(W.partitionBy("table_idx").orderBy("feature"))).where(F.col("_r") <= most).drop("_r")
    union = F.lit("european union")
    at = F.when(F.contains("country", union), F.array_distinct(F.array("country", union))).otherwise(F.array("country"))
    used = long.join(first, ["table_idx", "feature"], "left_semi").withColumn("_place", F.explode(at))
    places = spots.select("country", "region", "year", F.explode(F.filter(F.array("country", "region", F.lit("world")), lambda x: x != "")).alias("_place"))
    wanted = places.select("_place", F.col("year").alias("_y")).distinct()
    rows = used.join(wanted, "_place").where(F.col("year").between(F.col("_y") - width, F.col("_y") - 1))
    each = series_descriptor(rows, ["_place", "_y", "table_idx", "feature"], ["year", "country"], "value").where("n >= 2")
    part = each.groupBy("_place", "_y", "table_idx").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in DESCRIPTOR])
    both = places.join(part.withColumnRenamed("_y", "year"), ["_place", "year"]).groupBy("country", "region", "year", "table_idx")
    return both.agg(*[(F.sum(c) / F.sum("_n")).alias(c) for c in DESCRIPTOR])


def tensor_signal(spots: DataFrame, panel: DataFrame, window: int) -> DataFrame:
    """country, year, s_<component>: the descriptor of the first row of each tensor across all features of the panel in order.

    `spots` has distinct countries and years; those the panel has no country for have
    no row, a year without readings is a row of zeros. Only readings are joined, the
    zeros of the other features are counted.
    """
    names = panel.select("feature").distinct()
    n = names.count()
    place = names.withColumn("_i", (F.row_number().over(W.orderBy("feature")) - 1).cast("double"))
    known = spots.join(panel.select("country").distinct(), "country", "left_semi").where(F.lit(n) >= 2)
    cells = panel.where("value <> 0").join(place, "feature").select("country", F.col("year").alias("_y"), "_i", "value")
    v, i = F.col("value"), F.col("_i")
    raw = known.withColumn("_y", F.col("year") - window + 1).join(cells, ["country", "_y"]).groupBy("country", "year").agg(
        F.count(v).alias("_n"), F.avg(v).alias("_avg"), F.var_pop(v).alias("_var"), F.sum(v * i).alias("_iv"), F.sum(F.when(i == 0, v)).alias("_first"),
        F.sum(F.when(i == n - 1, v)).alias("_last"), F.array_sort(F.collect_list(v)).alias("_v"))
    k, zeros = F.col("_n"), F.lit(n) - F.col("_n")
    below = F.size(F.filter("_v", lambda x: x < 0))
    at = lambda r: F.when(F.lit(r) < below, F.get("_v", F.lit(r))).when(F.lit(r) < below + zeros, 0.0).otherwise(F.get("_v", (F.lit(r) - zeros).cast("int")))
    mean = k * F.col("_avg") / n
    var = (k * F.col("_var") + k * (F.col("_avg") - mean) ** 2 + zeros * mean**2) / n
    unit = F.greatest(F.abs(mean), F.lit(1e-6))
    low, part = (n - 1) * 3 // 4, (n - 1) * 3 % 4 / 4
    first, last = F.coalesce("_first", F.lit(0.0)), F.coalesce("_last", F.lit(0.0))
    q75 = at(low) + (at(min(low + 1, n - 1)) - at(low)) * part
    slope = (F.col("_iv") / n - mean * (n - 1) / 2) / ((n * n - 1) / 12)
    least, most = F.array_min("_v"), F.array_max("_v")
    cols = {"mean": mean, "std": F.sqrt(var), "min": F.when(zeros > 0, F.least(least, F.lit(0.0))).otherwise(least), "max": F.when(zeros > 0, F.greatest(most, F.lit(0.0))).otherwise(most), "slope": slope / unit, "delta": (last - first) / unit, "q75": q75, "last": last}
    out = raw.select("country", "year", *[cols[c].alias(f"s_{c}") for c in DESCRIPTOR])
    return known.select("country", "year").join(out, ["country", "year"], "left").select("country", "year", *[F.coalesce(f"s_{c}", F.lit(0.0)).alias(f"s_{c}") for c in DESCRIPTOR])


def pearson(a: list[Column], b: list[Column]) -> Column:
    """Correlation of two vectors given by columns; -1 where it isn't defined."""
    n = len(a)
    total = lambda xs: sum(xs[1:], xs[0])
    ma, mb = total(a) / n, total(b) / n
    cov = total([(x - ma) * (y - mb) for x, y in zip(a, b, strict=True)])
    va, vb = total([(x - ma) * (x - ma) for x in a]), total([(y - mb) * (y - mb) for y in b])
    r = F.try_divide(cov, F.nullif(F.sqrt(va) * F.sqrt(vb), F.lit(0.0)))
    return F.coalesce(F.when(~F.isnan(r), r), F.lit(-1.0))


def trend_score(slope_a: Column, slope_b: Column, delta_a: Column, delta_b: Column) -> Column:
    return -F.abs(slope_a - slope_b) - 0.5 * F.abs(delta_a - delta_b)


def select_tables(signals: DataFrame, tables: DataFrame, key: str, method: str, top: int, digits: int = 6) -> DataFrame:
    """key, table_idx, score, rank: the `top` tables whose descriptor agrees best with the policy's signal.

    `signals` has key and s_<component> (null where a policy has no signal: all its
    tables score -1, or -1e9 by trend), `tables` key, table_idx and the components. Ties
    go to the lower table index.
    """
    both = signals.join(tables, key)
    if method == "pearson":
        score = pearson([F.col(f"s_{c}") for c in DESCRIPTOR], [F.col(c) for c in DESCRIPTOR])
    elif method == "linear-trend":
        score = F.coalesce(trend_score(F.col("s_slope"), F.col("slope"), F.col("s_delta"), F.col("delta")), F.lit(-1e9))
    else:
        raise ValueError(f"unknown method {method}")
    scored = both.select(key, "table_idx", F.round(score, digits).alias("score"))
    return top_per(scored, [key], [F.col("score").desc(), F.col("table_idx").asc()], top)


def selection_json(ranked: DataFrame, key: str, title: str, score: str = "score") -> DataFrame:
    """key, selected_titles, selected_scores as JSON arrays in rank order."""
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(title).alias("t"), F.col(score).alias("s")))).alias("x"))
    return rows.select(key, F.to_json(F.transform("x", lambda e: e["t"])).alias("selected_titles"), F.to_json(F.transform("x", lambda e: e["s"])).alias("selected_scores"))
