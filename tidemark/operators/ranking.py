"""Top-k, dedupe and capped lists that say what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def tie_safe_top(df: DataFrame, key: str, scores: list[Column], k: int) -> DataFrame:
    """Whole tie groups in falling order of ``scores``, up to the first that would pass ``k`` rows."""
    upto = F.count("*").over(Window.partitionBy(key).orderBy(*scores).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("rows_upto", upto).where(F.col("rows_upto") <= k)


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def capped(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with shown, total and not_listed.

    Totals are counted apart, so that each task keeps no more than k rows of a key before the shuffle.
    """
    totals = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("total"))
    top = top_per_key(df, key, order, k)
    return top.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumns({
        "shown": F.least(F.col("total"), F.lit(k)), "not_listed": F.greatest(F.col("total") - k, F.lit(0)),
    })


def due(df: DataFrame, tier: str, order: list[Column], cycle: int) -> DataFrame:
    """The rows of each tier whose turn it is, with place and quota: of n rows the first ceil(n / cycle)."""
    quotas = df.groupBy(F.col(tier).alias("_tier")).agg(F.ceil(F.count("*") / float(cycle)).alias("quota"))
    most = quotas.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    return top_per_key(df, tier, order, most).join(quotas, F.col(tier).eqNullSafe(F.col("_tier"))).drop("_tier").where("place <= quota")
