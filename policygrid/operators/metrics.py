"""Ranking metrics at k, their means, and aggregates of metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def precision(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / k).otherwise(0.0)


def ndcg(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / F.log2(rank + 1)).otherwise(0.0)


def mrr(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / rank).otherwise(0.0)


def any_overlap(found: Column, answers: Column) -> Column:
    """1 if any of the found ids is among the answers, else 0; nulls, also inside the lists, match nothing."""
    return F.coalesce(F.arrays_overlap(F.array_compact(found), F.array_compact(answers)).cast("int"), F.lit(0))


METRICS = {"hit": hit, "precision": precision, "ndcg": ndcg, "mrr": mrr}


def evaluate(ranks: DataFrame, cuts: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """Means of every metric at every cut over the queries of `ranks` (rank: that of the target, null if it isn't ranked).

    Columns `hit@k` and so on, and queries_evaluated; a group without queries gives
    no row, no group at all gives zeros.
    """
    cols = [F.round(F.coalesce(F.avg(f(F.col("rank"), k)), F.lit(0.0)), 6).alias(f"{m}_{k}") for m, f in METRICS.items() for k in cuts]
    aggs = [F.count(F.lit(1)).alias("queries_evaluated"), *cols]
    return ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)


def summarize(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of all metric columns of fold rows by method (or window and method, ...)."""
    names = [c for c in rows.columns if c.split("_")[0] in METRICS]
    return rows.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def metric_columns(df: DataFrame, with_mrr: bool = False) -> list[str]:
    """Names that begin with hit@, precision@, ndcg@ (and mrr@ if wanted)."""
    kinds = ("hit", "precision", "ndcg", *(("mrr",) if with_mrr else ()))
    return [c for c in df.columns if c.replace("@", "_").split("_")[0] in kinds]


def stability(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Over the runs of a group: n_runs, mean, std (sample, 0 for one run), cv_pct (0 unless the mean is positive), min, max."""
    s = rows.groupBy(*by).agg(F.count(value).alias("n_runs"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    std = F.when(F.col("n_runs") > 1, F.col("s")).otherwise(0.0)
    return s.select(
        *by, "n_runs", F.round("m", 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.when(F.col("m") > 0, std / F.col("m") * 100).otherwise(0.0), 2).alias("cv_pct"),
        F.round("lo", 6).alias("min"), F.round("hi", 6).alias("max"),
    )
