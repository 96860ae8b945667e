"""Readers of the files that the pipeline exchanges."""

from __future__ import annotations

import csv
import json
import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policygrid.functions.text import normal_path, path_window
from policygrid.operators.panel import standardize_table
from policygrid.session import file_system, read_text

#: The names under which vector stores keep the same metadata. Fixed values.
ALIASES = {
    "document_id": ("document_id", "Document ID", "doc_id", "documentId"), "fold": ("fold", "Fold"), "source": ("source", "Source"), "geography": ("geography", "Geography"), "sector": ("sector", "Sector"),
}

RECORD = T.StructType([
    T.StructField("anchor_summary", T.StringType()), T.StructField("positive_time_series", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("positive_sector", T.ArrayType(T.IntegerType())),
    T.StructField("doc_id", T.StringType()), T.StructField("sector", T.ArrayType(T.StringType())), T.StructField("country", T.StringType()),
])
PAIR = T.StructType([*RECORD.fields[:3], T.StructField("negative_time_series", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("negative_sector", T.ArrayType(T.IntegerType()))])


def snake_case(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, rename: bool = False) -> DataFrame:
    """A CSV with header; values may span lines. With `rename` column names become lower case with underscores."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*[snake_case(c) for c in df.columns]) if rename else df


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """title, meta_path, csv_path, description of every `*.meta.json` under `folder`, in order of path.

    The title is `title`, else `dataset.title`, else the file's stem; the description
    that of `dataset` if there is one, else its own. Unreadable files count as empty.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").text(folder, wholetext=True).select(F.col("value").alias("j"), F.col("_metadata.file_path").alias("meta_path"))
    text = lambda p: F.nullif(F.trim(F.get_json_object("j", p)), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split("meta_path", "/"), -1), r"\.meta\.json$", "")
    description = F.when(F.get_json_object("j", "$.dataset").isNotNull(), F.get_json_object("j", "$.dataset.description")).otherwise(F.get_json_object("j", "$.description"))
    return raw.select(F.coalesce(text("$.title"), text("$.dataset.title"), stem).alias("title"), "meta_path", F.regexp_replace("meta_path", r"\.meta\.json$", ".csv").alias("csv_path"), description.alias("description")).orderBy("meta_path")


def discover_tables(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(title, csv path) of the sidecars whose table exists; the catalog is one row per table. Raises ValueError if there is none."""
    found = [(r["title"], r["csv_path"]) for r in sidecars(spark, folder).collect()]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [(t, p) for t, p in found if (hp := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(hp)]
    if not there:
        raise ValueError(f"no indicator tables under {folder}")
    return there


def title_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """title, meta_path: lower-case titles, of equal ones the last by path."""
    return sidecars(spark, folder).select(F.lower(F.trim("title")).alias("title"), "meta_path").groupBy("title").agg(F.max("meta_path").alias("meta_path")).orderBy("title")


def read_indicators(spark: SparkSession, tables: list[tuple[str, str]], first: int = 1970, last: int = 2024) -> DataFrame:
    """table_idx, country, year, feature, value in long form of all indicator tables; features are named `t000__column`."""
    from policygrid.functions.text import squeeze
    from policygrid.operators.panel import numeric_columns

    parts = []
    for i, (_, path) in enumerate(tables):
        df = standardize_table(read_csv(spark, path), first, last)
        cols = numeric_columns(df, "year")
        if cols:
            pairs = F.explode(F.array(*[F.struct(F.lit(f"t{i:03d}__{c}").alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols]))
            parts.append(df.select(F.lit(i).alias("table_idx"), squeeze(F.col("country")).alias("country"), "year", pairs.alias("x")).select("table_idx", "country", "year", "x.feature", "x.value"))
    if not parts:
        raise ValueError("no table has a numeric column")
    return reduce(DataFrame.unionByName, parts)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of a JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_traces(spark: SparkSession, folder: str, query: str = "query_text", doc: str = "target_doc_id", pattern: str = "*.{csv,jsonl}") -> DataFrame:
    """Rows of every CSV and JSONL under `folder` that has both columns, with trace_file and window (from the path, else `unknown`)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path").collect()  # one row per file
    parts = []
    for path in sorted(r["path"] for r in listed):
        df = read_csv(spark, path) if path.endswith(".csv") else read_jsonl(spark, path)
        if query in df.columns and doc in df.columns:
            df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
            parts.append(df.withColumn("trace_file", F.lit(path)).withColumn("window", df["window"] if "window" in df.columns else path_window(F.lit(path))))
    if not parts:
        raise ValueError(f"no traces under {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_folds(spark: SparkSession, folder: str) -> DataFrame:
    """A table written by fold, with its fold column. Raises ValueError if it has no fold."""
    df = spark.read.parquet(folder)
    if "fold" not in df.columns or df.select("fold").where("fold is not null").isEmpty():
        raise ValueError(f"no folds under {folder}")
    return df


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """text_file_path (relative to `folder`, normalised) and page_content of every text file under it."""
    df = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    root = normal_path(F.regexp_replace(F.lit(folder), "^file:", ""))
    path = normal_path(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:", ""))
    return df.select(F.replace(path, F.concat(root, F.lit("/")), F.lit("")).alias("text_file_path"), F.col("value").alias("page_content"))


def resolve_texts(rows: DataFrame, files: DataFrame, bases: list[str]) -> DataFrame:
    """row_id, path: the first of the candidates (the path itself, then under each base, then `data/` before it) that exists."""
    raw = normal_path(F.col("text_file_path"))
    tries = [raw, *[F.concat(normal_path(F.lit(b)), F.lit("/"), raw) for b in bases], F.concat(F.lit("data/"), raw)]
    cand = rows.select("row_id", F.posexplode(F.array(*tries)).alias("place", "key")).where("key is not null")
    there = cand.join(files.select(normal_path(F.col("text_file_path")).alias("key"), F.col("text_file_path").alias("path")), "key")
    return there.groupBy("row_id").agg(F.min_by("path", F.struct("place", "path")).alias("path"))


def read_manifest(path: str) -> dict:
    """A small JSON object, read through Hadoop; empty on any failure."""
    try:
        found = json.loads(read_text(path) or "")
    except (OSError, ValueError, Py4JJavaError):
        return {}
    return found if isinstance(found, dict) else {}


def load_hparams(path: str) -> dict | None:
    """The parameters save_hparams() wrote, None if there are none."""
    found = read_manifest(path).get("hparams")
    return found if isinstance(found, dict) else None


def resolve_checkpoint(spark: SparkSession, run_dir: str, explicit: str | None = None) -> str:
    """The checkpoint to evaluate: the explicit file, else that of the first final trial, else the only one of any final trial.

    Raises FileNotFoundError where there is none (or the explicit one is missing) and
    RuntimeError where several could be meant.
    """
    fs, root = file_system(spark, run_dir)
    path = lambda p: file_system(spark, p)[1]
    there = lambda p: fs.exists(path(p)) and not fs.getFileStatus(path(p)).isDirectory()
    if explicit is not None:
        if not there(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    first = f"{run_dir}/checkpoints/final/trial_001/best.ckpt"
    if there(first):
        return first
    found = sorted(str(f.getPath().toUri().getPath()) for f in fs.globStatus(path(f"{run_dir}/checkpoints/final/trial_*/best.ckpt")) or [])
    if len(found) > 1:
        raise RuntimeError(f"several checkpoints under {run_dir}; name one")
    if not found:
        raise FileNotFoundError(f"no checkpoint under {run_dir}")
    return found[0]


def keyed_records(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Records of a JSON array by `key`, of equal keys one; a file that is absent or can't be read gives no records."""
    try:
        return read_json_array(spark, path).where(F.col(key).isNotNull()).dropDuplicates([key])
    except AnalysisException:
        return spark.createDataFrame([], RECORD)


def feature_columns(spark: SparkSession, path: str, keys: tuple[str, ...] = ("country", "year")) -> list[str]:
    """The feature names of a CSV from its header alone; no row is read."""
    head = (read_text(path) or "").partition("\n")[0].strip("\ufeff\r")
    return [c for c in next(csv.reader([head]), []) if c not in keys]


def read_retrieval_traces(spark: SparkSession, folder: str) -> DataFrame:
    """read_traces() of the files named *retrieval_traces*.csv; raises ValueError where one lacks a column that every trace has."""
    found = read_traces(spark, folder, pattern="*retrieval_traces*.csv")
    missing = [c for c in ("query_text", "target_doc_id", "retrieved_doc_id") if c not in found.columns]
    if missing:
        raise ValueError(f"traces lack {missing}")
    return found


def collection_name(asked: str | None, manifest: dict, default: str = "chunks") -> str:
    """An explicit name; for none, `auto` and `manifest` that of the manifest, else the default."""
    if asked and asked.strip().lower() not in ("auto", "manifest"):
        return asked.strip()
    return str(manifest.get("collection") or manifest.get("collection_name") or default)


def search_catalog(catalog: DataFrame, keywords: list[str], exclude: list[str]) -> DataFrame:
    """Catalog tables (table, namespace, title, dimensions) with a year and a country or location that match a keyword and no excluded one; of equal tables the last version."""
    dims = F.col("dimensions")
    usable = catalog.where(F.array_contains(dims, F.lit("year")) & (F.array_contains(dims, F.lit("country")) | F.array_contains(dims, F.lit("location"))))
    text = F.lower(F.concat_ws(" ", "namespace", "title", "table"))
    if keywords:
        usable = usable.where(text.rlike("|".join(re.escape(k.lower()) for k in keywords)))
    if exclude:
        usable = usable.where(~text.rlike("|".join(re.escape(k.lower()) for k in exclude)))
    return usable.groupBy("table").agg(F.max_by(F.struct(*[c for c in usable.columns if c != "table"]), F.col("version")).alias("x")).select("table", "x.*")
