"""Paired tests across folds: means, t statistic, signed ranks, p-values without further libraries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def method_pairs(methods: list[str], mode: str, baselines: list[str] | None = None, method: str | None = None) -> list[tuple[str, str]]:
    """(baseline, candidate) pairs: one method or all methods against baselines, or all pairs of sorted methods."""
    methods = sorted(set(methods))
    base = [b for b in (baselines or []) if b in methods]
    if mode == "method-vs-baselines":
        return [(b, method) for b in base if method in methods and b != method]
    if mode == "all-vs-baselines":
        return [(b, m) for b in base for m in methods if m != b and m not in base]
    if mode == "pairwise":
        return [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    raise ValueError(f"unknown mode {mode}")


def paired_statistics(rows: DataFrame, pairs: list[tuple[str, str]], metrics: list[str], on: str = "fold") -> DataFrame:
    """baseline, candidate, metric, n, means, mean_diff, t_stat, w_stat over the folds both methods have.

    `rows` has method, `on` and metric columns. t is null for fewer than two folds or
    equal differences; w is the smaller sum of signed ranks of differences that
    aren't 0, ties sharing their mean rank.
    """
    spark = rows.sparkSession
    plan = spark.createDataFrame(pairs, "baseline string, candidate string")
    long = rows.select("method", on, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v")).where("v is not null")
    a = long.select(F.col("method").alias("baseline"), on, "metric", F.col("v").alias("b"))
    c = long.select(F.col("method").alias("candidate"), on, "metric", F.col("v").alias("c"))
    diff = plan.join(a, "baseline").join(c, ["candidate", on, "metric"]).withColumn("d", F.round(F.col("c") - F.col("b"), 12))
    keys = ["baseline", "candidate", "metric"]
    stats = diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("baseline_mean"), F.avg("c").alias("candidate_mean"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    w = W.partitionBy(*keys).orderBy(F.abs("d"))
    same = W.partitionBy(*keys, F.abs("d"))
    ranked = diff.where("d <> 0").withColumn("_n", F.row_number().over(w)).withColumn("r", F.avg("_n").over(same))
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"))
    t = F.when(F.col("n") >= 2, F.try_divide("mean_diff", F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt("n")))
    return stats.join(sums, keys, "left").select(*keys, "n", "baseline_mean", "candidate_mean", "mean_diff", t.alias("t_stat"), F.coalesce(F.least("up", "down"), F.lit(0.0)).alias("w_stat"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_test_p(diffs: list[float]) -> float:
    """Two-sided paired t-test; NaN for fewer than two or all-zero differences, 0 if they are equal but not 0."""
    n = len(diffs)
    if n < 2:
        return math.nan
    mean = sum(diffs) / n
    sd = math.sqrt(sum((d - mean) ** 2 for d in diffs) / (n - 1))
    if sd < 1e-15 * max(1.0, abs(mean)):
        return 0.0 if mean else math.nan
    t = mean / (sd / math.sqrt(n))
    nu = n - 1
    return beta_regularized(nu / 2, 0.5, nu / (nu + t * t))


def wilcoxon_p(diffs: list[float]) -> float:
    """Two-sided signed-rank test: exact where up to 20 differences without zeros and ties allow it, else normal."""
    if len(diffs) < 2:
        return math.nan
    d = [x for x in diffs if x]
    n = len(d)
    if not n:
        return math.nan
    size = sorted(abs(x) for x in d)
    rank = {s: (2 * size.index(s) + size.count(s) + 1) / 2 for s in set(size)}
    up = sum(rank[abs(x)] for x in d if x > 0)
    w = min(up, n * (n + 1) / 2 - up)
    if n <= 20 and n == len(diffs) and len(rank) == n:
        ways = [1]
        for r in range(1, n + 1):  # how many subsets of the ranks have each sum
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    ties = sum(c**3 - c for c in (size.count(s) for s in set(size)))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else math.nan


def p_values(rows: DataFrame, pairs: list[tuple[str, str]], metrics: list[str], on: str = "fold") -> DataFrame:
    """baseline, candidate, metric, p_ttest, p_wilcoxon; a group is as many numbers as there are folds."""
    spark = rows.sparkSession
    plan = spark.createDataFrame(pairs, "baseline string, candidate string")
    long = rows.select("method", on, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v")).where("v is not null")
    both = plan.join(long.select(F.col("method").alias("baseline"), on, "metric", F.col("v").alias("b")), "baseline").join(long.select(F.col("method").alias("candidate"), on, "metric", F.col("v").alias("c")), ["candidate", on, "metric"])
    grouped = both.groupBy("baseline", "candidate", "metric").agg(F.collect_list(F.round(F.col("c") - F.col("b"), 12)).alias("d"))
    p = lambda f: F.pandas_udf(lambda s: pd.Series([f([float(x) for x in d]) for d in s], dtype="float64"), "double")
    return grouped.select("baseline", "candidate", "metric", p(t_test_p)("d").alias("p_ttest"), p(wilcoxon_p)("d").alias("p_wilcoxon"))
