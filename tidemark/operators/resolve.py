"""Entity resolution over alias tables, with an explicit outcome for every probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def resolve(probes: DataFrame, aliases: DataFrame, key: str = "key") -> DataFrame:
    """``probes`` with state (confirmed / ambiguous / unmatched), name, candidates and reason.

    aliases: (key, name). Its names are reduced per key before the join, so a key shared by
    many names stays one row.
    """
    index = aliases.where(F.col(key) != "").groupBy(key).agg(F.min("name").alias("name"), F.count_distinct("name").alias("candidates"))
    n = F.coalesce("candidates", F.lit(0))
    return probes.join(index, key, "left").select(
        *probes.columns,
        F.when(n == 1, "confirmed").when(n > 1, "ambiguous").otherwise("unmatched").alias("state"),
        F.when(n == 1, F.col("name")).alias("name"), n.cast("long").alias("candidates"),
        F.when(n == 1, "one record holds this key").when(n > 1, F.concat(n.cast("string"), F.lit(" records share this key"))).otherwise("no record holds this key").alias("reason"),
    )


def first_wins(aliases: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return aliases.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def ambiguous_keys(aliases: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    return aliases.groupBy(key).agg(F.count_distinct(name).alias("n")).where("n > 1").select(key)


def guarded_join(probes: DataFrame, records: DataFrame, key: str, probe_name: str, record_name: str) -> DataFrame:
    """Join on a key; a key that several names share needs the exact name as well."""
    shared = ambiguous_keys(records.select(F.col(key), F.col(record_name).alias("name")), key)
    marked = records.join(shared.withColumn("_shared", F.lit(True)), key, "left")
    return probes.join(marked, key).where(F.col("_shared").isNull() | (F.col(probe_name) == F.col(record_name))).drop("_shared")
