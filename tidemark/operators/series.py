"""Monthly series in which a missing month is not a zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense_months(facts: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """One row per key and calendar month from first to last: the sum, 0 where the month has
    rows of other keys only, null (published false) where it has none at all."""
    sums = facts.groupBy(key, month).agg(F.sum(value).alias("total"))
    ends = facts.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    calendar = ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias(month))
    published = facts.select(month).distinct().withColumn("published", F.lit(True))
    grid = calendar.join(published, month, "left").crossJoin(facts.select(key).distinct())  # months by keys: the result's own rows
    value_or_gap = F.when(F.col("published"), F.coalesce("total", F.lit(0)))
    return grid.join(sums, [key, month], "left").select(key, month, F.coalesce("published", F.lit(False)).alias("published"), value_or_gap.alias("total"))


def trend(monthly: DataFrame, key: str, month: str, value: str, floor: Column) -> DataFrame:
    """First and last month of each key, and the change in percent unless the first is under ``floor``."""
    ends = monthly.groupBy(key).agg(F.min_by(value, month).alias("baseline"), F.max_by(value, month).alias("latest"))
    return ends.withColumn("change_pct", F.when(F.col("baseline") >= floor, F.round(100.0 * (F.col("latest") - F.col("baseline")) / F.col("baseline"), 1)))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of each key, split where ``gap_seconds`` pass without a row."""
    w = Window.partitionBy(key).orderBy(ts)
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    new = (second - F.lag(second).over(w) > gap_seconds).cast("int")
    numbered = events.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))
