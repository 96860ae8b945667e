"""Writers: folds, chunk stores, records, manifests, caches and resumable checkpoints."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policygrid.session import file_system, write_text


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def write_folds(df: DataFrame, path: str) -> None:
    """The assignments, one folder per fold; the train rows of a fold are those of the other folders."""
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Panels by fold and split."""
    df.write.mode("overwrite").partitionBy("fold", "split").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_manifest(path: str, **values) -> None:
    """A small JSON object beside a table, in the store the table lies in."""
    write_text(path, json.dumps(values, indent=2, sort_keys=True, default=str))


def save_hparams(path: str, hparams: dict, **about) -> None:
    """The tuned parameters of a run (about: backbone, loss, val_loss, ...), to be shared by the runs of that kind."""
    write_manifest(path, hparams=hparams, **about)


def manifest_row(df: DataFrame, **aggregates) -> DataFrame:
    """One row `manifest`: the aggregates of a table as a JSON object."""
    return df.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.to_json(F.struct("*")).alias("manifest"))


def write_graph(edges: DataFrame, path: str) -> None:
    """Edges by relationship under `path/edges` and the nodes they touch by label under `path/nodes`."""
    from policygrid.operators.graph import nodes

    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")
    nodes(edges.sparkSession.read.parquet(f"{path}/edges")).write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")


def write_chunk_store(chunks: DataFrame, path: str, collection: str, model: str, rebuild: bool = False, embedder=None) -> dict:
    """Chunks by fold under `path/collection` and a manifest beside it; without `rebuild` an existing store is added to.

    With `embedder` the texts get their vectors (column embedding) on the way, Arrow batch by Arrow batch.
    """
    target = f"{path}/{collection}"
    if embedder is not None:
        from policygrid.operators.models import embed_column

        chunks = embed_column(chunks, "text", embedder)
    chunks.write.mode("overwrite" if rebuild else "append").partitionBy("fold").parquet(target)
    values = {"collection": collection, "embedding_model": model, "chunks": chunks.sparkSession.read.parquet(target).count()}
    write_manifest(f"{path}/manifest.json", **values)
    return values


def unique_path(spark: SparkSession, path: str) -> str:
    """`path`, else `path_1`, `path_2`, ... (before the suffix): the first that doesn't exist."""
    stem, dot, suffix = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
    k, out = 0, path
    while _exists(spark, out):
        k += 1
        out = f"{stem}_{k}{dot}{suffix}"
    return out


class Checkpoint:
    """An append-only table of finished keys, so a run that stopped goes on where it was."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def done(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if _exists(self.spark, self.path) else None

    def open_rows(self, df: DataFrame) -> DataFrame:
        """Rows whose key isn't finished yet."""
        done = self.done()
        return df if done is None else df.join(done.select(self.key).distinct(), self.key, "left_anti")

    def run(self, df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Apply `step` to the open rows, append its result, and give all finished rows."""
        step(self.open_rows(df)).write.mode("append").parquet(self.path)
        return self.done()


class VectorCache:
    """Vectors by text; only texts that aren't there yet are embedded."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def get(self, texts: DataFrame, text: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """text, embedding of the different texts."""
        wanted = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
        known = self.spark.read.parquet(self.path) if _exists(self.spark, self.path) else None
        fresh = wanted if known is None else wanted.join(known.select("text"), "text", "left_anti")
        embed(fresh).select("text", "embedding").write.mode("append").parquet(self.path)
        return self.spark.read.parquet(self.path).join(wanted, "text", "left_semi")
