"""Declarative constraints: each returns its violations as rows (severity, check_name, row_key, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def violations(df: DataFrame, check: str, key: str, bad: Column, message: str, severity: str = "FAIL") -> DataFrame:
    return df.where(bad).select(F.lit(severity).alias("severity"), F.lit(check).alias("check_name"), F.col(key).cast("string").alias("row_key"), F.lit(message).alias("message"))


def orphans(df: DataFrame, dim: DataFrame, key: str, dim_key: str, check: str, severity: str = "FAIL") -> DataFrame:
    gone = df.join(dim.select(F.col(dim_key).alias("_d")).distinct(), F.col(key) == F.col("_d"), "left_anti")
    return violations(gone, check, key, F.lit(True), f"{key} has no {dim_key}", severity)


def duplicates(df: DataFrame, key: str, check: str, severity: str = "FAIL") -> DataFrame:
    return violations(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), check, key, F.lit(True), f"{key} repeats", severity)


def not_in(df: DataFrame, key: str, column: str, allowed: list[str], check: str, severity: str = "FAIL") -> DataFrame:
    return violations(df, check, key, ~F.coalesce(F.col(column).isin(allowed), F.lit(False)), f"{column} is not a known value", severity)


def ratchet(now: DataFrame, baseline: DataFrame, key: str = "measure", value: str = "n") -> DataFrame:
    """Counts against a baseline: a rise or an unknown measure above zero fails, a fall warns."""
    old = baseline.select(F.col(key), F.col(value).alias("_old"))
    x = now.join(old, key, "full").withColumns({"_old": F.coalesce("_old", F.lit(0)), value: F.coalesce(value, F.lit(0))})
    severity = F.when(F.col(value) > F.col("_old"), "FAIL").when(F.col(value) < F.col("_old"), "WARN")
    return x.select(key, F.col("_old").alias("baseline"), F.col(value), severity.alias("severity")).where("severity is not null")


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
