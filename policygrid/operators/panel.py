"""Indicator panels in long form: standardising, deduplication, train-only selection, grid and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.session import fresh_name, require_columns


def standardize_table(df: DataFrame, first: int, last: int) -> DataFrame:
    """`location` renamed to `country` (dropped if both are there); year as whole number within [first, last].

    Rows whose year is no number are left out. Raises ValueError without a country or year column.
    """
    if "country" not in df.columns and "location" in df.columns:
        df = df.withColumnRenamed("location", "country")
    elif "location" in df.columns:
        df = df.drop("location")
    require_columns(df, "country", "year")
    year = F.expr("try_cast(year as double)").cast("int") if df.schema["year"].dataType.typeName() == "string" else F.col("year").cast("int")
    return df.withColumn("year", year).where(F.col("year").between(first, last))


def numeric_columns(df: DataFrame, *but: str) -> list[str]:
    """Numeric columns other than `but`."""
    return [n for n, t in df.dtypes if n not in but and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]


def align_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name of two tables; numeric columns that one lacks, and nulls in them, are 0."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.fillna(0, numeric_columns(both))


def most_complete(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Per key the row with most non-null columns, ties to the smallest `tie`.

    A max over a struct, so a hot key is reduced on the map side.
    """
    others = [c for c in df.columns if c not in keys]
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    pick = fresh_name(df.columns, "_pick")
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(filled, -F.col(tie))).alias(pick))
    return best.select(*keys, *[F.col(f"{pick}.{c}").alias(c) for c in others])


def select_features(long: DataFrame, train: Column, missing: float = 0.2, threshold: float = 0.7) -> DataFrame:
    """table_idx, feature, n_values, n_rows, kept_by ('' if dropped ... 'kept') of each feature, on train rows only.

    `long` has table_idx, country, year, feature, value, one row per cell. A feature
    survives if it has two different values, is there for ceil(rows * (1 - missing))
    of its table's rows, and no earlier surviving-so-far feature of its table (also
    one that is itself dropped) correlates beyond `threshold` over the rows both
    have. Pairs are formed per table row, whose width is the table's schema.
    """
    rows = long.where(train)
    cells = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select("table_idx", "country", "year", "feature", F.col("value").cast("double").alias("value"))
    n_rows = rows.groupBy("table_idx").agg(F.count_distinct("country", "year").alias("n_rows"))
    stats = cells.groupBy("table_idx", "feature").agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = stats.join(n_rows, "table_idx").select(
        "table_idx", "feature", "n_values", "n_rows", (F.col("lo") != F.col("hi")).alias("varies"), (F.col("n_values") >= F.ceil(F.col("n_rows") * F.lit(1 - missing) - 1e-9)).alias("complete"))
    fit = state.where("varies and complete").select("table_idx", "feature")
    pairs = correlations(cells.join(fit, ["table_idx", "feature"], "left_semi")).where(F.round(F.abs("r"), 9) > threshold)
    bad = pairs.select("table_idx", F.col("right_feature").alias("feature")).distinct().withColumn("dup", F.lit(True))
    verdict = F.when(~F.col("varies"), "constant").when(~F.col("complete"), "sparse").when(F.col("dup"), "correlated").otherwise("kept")
    return state.join(bad, ["table_idx", "feature"], "left").select("table_idx", "feature", "n_values", "n_rows", verdict.alias("verdict"))


def correlations(cells: DataFrame) -> DataFrame:
    """table_idx, left_feature < right_feature, n, r: pairwise-complete Pearson correlation; null where a side doesn't vary."""
    wide = cells.groupBy("table_idx", "country", "year").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("f"))
    a = wide.select("table_idx", F.posexplode("f").alias("i", "a"), "f")
    pairs = a.select("table_idx", "a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b"))
    x, y = F.col("a.value"), F.col("b.value")
    sums = pairs.groupBy("table_idx", F.col("a.feature").alias("left_feature"), F.col("b.feature").alias("right_feature")).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return sums.select("table_idx", "left_feature", "right_feature", "n", F.try_divide("c", F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))).alias("r"))


def dense_grid(long: DataFrame, keys: list[str], first: int, last: int, time: str = "year") -> DataFrame:
    """Every key with every year of [first, last]: keys and time."""
    return long.select(*keys).distinct().withColumn(time, F.explode(F.sequence(F.lit(first), F.lit(last))))


def interpolate_linear(grid: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Gaps of `value` filled by position: linear inside, the next value before the first, the last after it.

    `grid` has one row per key and time; a key without any value stays null. The
    window runs per key over a grid of fixed length.
    """
    w = W.partitionBy(*keys).orderBy(time)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    pos = F.row_number().over(w)
    spot = grid.withColumn("_p", pos).withColumn("_k", F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v"))))
    seen = spot.withColumn("_a", F.last("_k", True).over(before)).withColumn("_b", F.first("_k", True).over(after))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_p") - F.col("_a.p")) / F.nullif(F.col("_b.p") - F.col("_a.p"), F.lit(0))
    return seen.withColumn(value, F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_b.v"))).drop("_p", "_k", "_a", "_b")


def location_slice(long: DataFrame, location: str, year: int, width: int, offset: int = 1) -> DataFrame:
    """Rows of a location in the `width` years that end `offset` before `year`; "European Union" matches as a part of the name."""
    where = F.contains(F.col("country"), F.lit(location)) if location == "European Union" else F.col("country") == location
    return long.where(where & F.col("year").between(year - offset - width + 1, year - offset))


def panel_split(keys: DataFrame, train_countries: DataFrame) -> DataFrame:
    """country, split: a country with any train policy is `train`, else `test`."""
    marked = keys.select("country").distinct().join(train_countries.select("country").distinct().withColumn("_t", F.lit(True)), "country", "left")
    return marked.select("country", F.when(F.col("_t"), "train").otherwise("test").alias("split"))


def fold_split(countries: DataFrame, policies: DataFrame, folds: list[int]) -> DataFrame:
    """fold, country, split per held-out fold: panel_split() with the policies (country, fold) of the other folds as train policies.

    Which folds a country has policies in is gathered once (a set of folds per country).
    """
    seen = policies.groupBy("country").agg(F.collect_set("fold").alias("_folds"))
    each = countries.select("country", F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold")).join(seen, "country", "left")
    train = F.coalesce(F.exists("_folds", lambda f: f != F.col("fold")), F.lit(False))
    return each.select("fold", "country", F.when(train, "train").otherwise("test").alias("split"))


def extra_columns(df: DataFrame, known: list[str]) -> list[str]:
    """The columns of `df` that aren't among `known`, in order."""
    return [c for c in df.columns if c not in set(known)]


def merge_tables(left: DataFrame, right: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer join of two wide tables on country and year; columns that both have get suffixes. Repeated keys multiply."""
    keys = ["country", "year"]
    both = set(extra_columns(left, keys)) & set(right.columns)
    a, b = (df.select(*keys, *[F.col(f"`{c}`").alias(c + s if c in both else c) for c in extra_columns(df, keys)]) for df, s in ((left, suffixes[0]), (right, suffixes[1])))
    return a.join(b, keys, "full")
