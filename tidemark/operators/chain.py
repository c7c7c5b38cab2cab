"""Folds over a chain of snapshots: since when entities and their children are known, and how many each snapshot had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.snapshots import history
from tidemark.tables import _hadoop

#: A state is kept for so many folds, so that a reader of the last one is not disturbed.
KEPT = 2


def fold_snapshots(spark: SparkSession, path: str, state: str, entity: str, child: str) -> str | None:
    """Folds the snapshots below ``path`` that the state has not seen yet; the day through which it now goes, None without any.

    The state holds a row for each entity (child null) and each of its children: first, the first
    day it was there, and at_start, whether the first snapshot of all already had it, so that
    its real beginning is not known. Beside it stand each snapshot's counts. Every new snapshot is read
    once, all in one job; what is older is not read again. A state is whole when its folder has its final name: after a crash the next
    call starts from the one before. Entities that are gone stay known; null entities are none, null children no children.
    """
    through = latest(spark, state)
    days = history(spark, path, through)
    if not days:
        return through
    start = history(spark, path)[0]
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/snapshot={d}" for d in days]).select(F.col("snapshot").cast("string").alias("day"), F.col(entity).cast("string").alias("entity"), F.col(child).cast("string").alias("child")).where("entity is not null")
    # a row for the entity itself beside each child's, added up before the shuffle
    each = rows.select("day", "entity", F.explode(F.array_distinct(F.array(F.col("child"), F.lit(None).cast("string")))).alias("child"))
    here = each.groupBy("day", "entity", "child").agg(F.count("*").alias("n"))
    first = here.groupBy("entity", "child").agg(F.min("day").alias("first"))
    if through is not None:
        first = spark.read.parquet(f"{state}/through={through}/seen").select("entity", "child", "first").union(first).groupBy("entity", "child").agg(F.min("first").alias("first"))
    new, done = f"{state}/.through={days[-1]}", f"{state}/through={days[-1]}"
    first.withColumn("at_start", F.col("first") == start).write.mode("overwrite").parquet(f"{new}/seen")
    counts = here.groupBy("day").agg(F.count_if(F.col("child").isNull()).alias("entities"), F.count_if(F.col("child").isNotNull()).alias("children"))
    if through is not None:
        counts = spark.read.parquet(f"{state}/through={through}/counts").union(counts)
    counts.write.mode("overwrite").parquet(f"{new}/counts")
    fs, at = _hadoop(spark, new)
    fs.rename(at, _hadoop(spark, done)[1])
    for old in _states(spark, state)[:-KEPT]:
        fs.delete(_hadoop(spark, f"{state}/through={old}")[1], True)
    return days[-1]


def _states(spark: SparkSession, state: str) -> list[str]:
    fs, at = _hadoop(spark, state)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removeprefix("through=") for n in names if n.startswith("through="))


def latest(spark: SparkSession, state: str) -> str | None:
    """The day through which the newest whole state goes."""
    return (_states(spark, state) or [None])[-1]


def seen(spark: SparkSession, state: str) -> DataFrame:
    """(entity, child, first, at_start) of the newest state."""
    return spark.read.parquet(f"{state}/through={latest(spark, state)}/seen")


def counts(spark: SparkSession, state: str) -> DataFrame:
    """(day, entities, children) of every snapshot folded so far; the change from one to the next is theirs to compare."""
    return spark.read.parquet(f"{state}/through={latest(spark, state)}/counts")
