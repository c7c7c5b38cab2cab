"""Loading of named Parquet tables and shared-folder intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); in local mode, a temp folder where it is unset."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = os.environ.get("TIDEMARK_SHARED") or f"{tempfile.gettempdir()}/tidemark-{os.getpid()}"
    os.makedirs(root, exist_ok=True)
    return f"file://{root}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends unless ``discard`` was earlier."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of the column ``by``, and read it back: lineage ends at files all executors see."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").partitionBy(*[by] if by else []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


#: Rows of a narrow table that one task sorts.
TASK_ROWS = 200_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (cheap to count) dealt evenly to tasks of some TASK_ROWS rows: one split of a narrow table's file holds millions."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // (rows or TASK_ROWS) + 1))


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of ``cut`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path is not None:
            fs, at = _hadoop(df.sparkSession, path)
            fs.delete(at, True)


#: Rows of ids (or other narrow rows) that may be broadcast, and bytes of rows that hold texts.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows, cheap to count) with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_texts(df: DataFrame, text: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its column ``text`` and 50 bytes a row are at most ``most`` bytes."""
    size = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 50), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df
