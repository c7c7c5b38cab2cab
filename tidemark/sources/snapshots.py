"""Tolerant loads, tables as of a date, and writes that refuse to lose rows."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def load_json(spark: SparkSession, path: str, schema: StructType | str, whole: bool = True, default: list | None = None) -> DataFrame:
    """JSON documents of ``schema``; a missing path is the rows of ``default``, none unless given, unreadable documents are null rows."""
    if not exists(spark, path):
        return spark.createDataFrame(default or [], schema)
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def load_counts(spark: SparkSession, path: str, counts: list[str]) -> DataFrame:
    """CSV with a header; what is no number in ``counts`` is 0."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)) for c in counts})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and every value quoted, quotes doubled."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    """Keep ``df`` as the table's state at the end of ``day``; a day is written once."""
    df.write.parquet(f"{path}/snapshot={dt.date.fromisoformat(day)}")


def resolve(spark: SparkSession, path: str, spec: str, today: str) -> str | None:
    """The latest snapshot at or before ``spec``, a date or an age like 7d; None where there is none.

    Only the folder's names are read.
    """
    age = re.fullmatch(r"(\d+)d", spec)
    day = dt.date.fromisoformat(today) - dt.timedelta(days=int(age[1])) if age else dt.date.fromisoformat(spec)
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    days = [m[1] for s in fs.listStatus(at) if (m := re.fullmatch(r"snapshot=([\d-]+)", s.getPath().getName()))]
    return max((d for d in days if d <= day.isoformat()), default=None)


def history(spark: SparkSession, path: str, after: str | None = None) -> list[str]:
    """Days of the table's snapshots, oldest first, those after ``after`` only: names of folders, no data."""
    fs, at = _fs(spark, path)
    days = [m[1] for s in fs.listStatus(at) if (m := re.fullmatch(r"snapshot=([\d-]+)", s.getPath().getName()))] if fs.exists(at) else []
    return sorted(d for d in days if after is None or d > after)


def as_of(spark: SparkSession, path: str, spec: str, today: str) -> DataFrame:
    """The table as it was then."""
    day = resolve(spark, path, spec, today)
    if day is None:
        raise ValueError(f"no snapshot at or before {spec}")
    return spark.read.parquet(f"{path}/snapshot={day}")


def guarded_write(df: DataFrame, path: str, least_share: float = 0.5) -> int:
    """Replace the Parquet table at ``path``, unless ``df`` is empty or shrinks it below ``least_share``; its rows.

    The new table is written beside the old one before that goes, so ``df`` may read it. The
    old one is renamed aside first and deleted last: after a crash between, ``path`` is missing
    but both tables stand beside it, and the next call puts the old one back.
    """
    spark = df.sparkSession
    (fs, beside), old, aside = _fs(spark, f"{path}.new"), _fs(spark, path)[1], _fs(spark, f"{path}.old")[1]
    if fs.exists(aside) and not fs.exists(old):
        fs.rename(aside, old)
    df.write.mode("overwrite").parquet(f"{path}.new")
    rows = spark.read.parquet(f"{path}.new").count()
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    if not rows or rows < least_share * before:
        fs.delete(beside, True)
        raise ValueError(f"refused to replace {before} rows by {rows}")
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    fs.rename(beside, old)
    fs.delete(aside, True)
    return rows
