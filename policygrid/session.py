"""Session defaults, table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "policygrid", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, AQE, Arrow.

    Shuffle partitions are left to the cluster's own setting unless given, as
    they have to follow the size of the input.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in conf and not os.environ.get("SPARK_REMOTE"):
        builder = builder.master(f"local[{cores}]")
    spark = builder.config(map={**base, **conf}).getOrCreate()
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent on one machine (tests) a temporary folder is set
    for the session and removed when the process ends; on a cluster, where each
    executor would write to a disk of its own, its absence raises RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="policygrid-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found, True)
    return found


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of `path` and the path as its object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(path: str, text: str) -> None:
    """A small text file, written through Hadoop, so any store that tables can lie in will do."""
    fs, p = file_system(SparkSession.active(), path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str) -> str | None:
    """A small text file read through Hadoop, None if there is none."""
    spark = SparkSession.active()
    fs, p = file_system(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/policygrid/{label}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    It cuts the lineage, survives the loss of executors (unlike cached blocks or
    localCheckpoint) and is columnar, so later reads prune columns. The table is
    removed when the application ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/policygrid/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """`df` partitioned by keys into about as many tasks as there are groups.

    Groups that are small in bytes but take long to work off would else be put
    together into a few tasks by adaptive execution.
    """
    return df.repartition(max(1, min(groups, 20_000)), *keys)


def release(*tables: DataFrame) -> None:
    """Remove the files of tables made by durable(), once nothing reads them any more."""
    for df in tables:
        for root in {f.rsplit("/part-", 1)[0] for f in df.inputFiles()}:
            if "/policygrid/" in root:
                fs, p = file_system(df.sparkSession, root)
                fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so their Python workers needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="policygrid-ship-")
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{folder}/policygrid", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ValueError naming the columns that `df` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def fresh_name(taken: list[str], wanted: str) -> str:
    """`wanted`, with underscores put before it until no column of `taken` has that name."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted
