"""Notices and their relations: nested awards as rows, titles without makers, live relations, identities, and rows worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.tables import small


def award_rows(notices: DataFrame, key: str, lots: str, value: str) -> DataFrame:
    """(key, lot, supplier, value): a row for every supplier of every award of ``lots`` (array of struct<lot, value, suppliers>).

    A notice without awards and an award without suppliers keep one row; an award without a
    value has the notice's.
    """
    awards = notices.select(key, F.col(value).alias("_whole"), F.explode_outer(lots).alias("a"))
    return awards.select(key, F.col("a.lot").alias("lot"), F.explode_outer("a.suppliers").alias("supplier"), F.coalesce("a.value", "_whole").alias("value"))


def without_maker(title: Column) -> Column:
    """'class: maker, product' as 'class: product'; other titles as they are."""
    return F.regexp_replace(title, r"^([^:]+): *[^,:]+, *(.+)$", "$1: $2")


def live_relation(relations: Column, as_of: str) -> Column:
    """The first of an array of relations (end) that has not ended by ``as_of``; an open end is live."""
    return F.get(F.filter(relations, lambda r: r["end"].isNull() | (r["end"] >= F.lit(as_of).cast("date"))), F.lit(0))


def shown_rows(rows: DataFrame, group: str, good: Column, order: list[Column], k: int = 4) -> DataFrame:
    """The first k good rows of each group; a group without any has none."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.where(F.coalesce(good, F.lit(False))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def identities(stories: DataFrame, key: str, words: str, aliases: DataFrame, scope: DataFrame) -> DataFrame:
    """(key, owner, how): who a story is about.

    aliases: (owner, alias) of one or several words. A strong alias, one that a single owner
    has, decides if all its words stand in the story; else a single word that one owner alone
    has, with one of that owner's scope terms (owner, term) in the story. Several owners at a
    step leave the story without one.

    Only aliases and scope are broadcast, if they are few; by the size of their files stories would be too, and their words are far more.
    """
    each = stories.select(key, F.explode(F.array_distinct(words)).alias("w")).hint("merge")
    parts = aliases.select("owner", "alias", F.split("alias", " ").alias("ps")).distinct()
    single = parts.groupBy("alias").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"), F.first("ps").alias("ps")).where("n = 1")
    wanted = single.select("alias", "owner", F.size(F.array_distinct("ps")).alias("need"), F.explode(F.array_distinct("ps")).alias("w"))
    strong = each.join(small(wanted), "w").groupBy(key, "alias", "owner", "need").agg(F.count("*").alias("have")).where("have = need and need > 1").select(key, "owner", F.lit(0).alias("step"))
    own = parts.select("owner", F.explode("ps").alias("w")).distinct().groupBy("w").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1 and length(w) >= 4")
    near = each.join(small(own.select("w", "owner")), "w").select(key, "owner").distinct()
    weak = near.hint("merge").join(small(scope), "owner").join(each.withColumnRenamed("w", "term").hint("merge"), [key, "term"], "left_semi").select(key, "owner", F.lit(1).alias("step"))
    both = strong.union(weak).distinct().groupBy(key, "step").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"))
    best = both.groupBy(key).agg(F.min(F.struct("step", "n", "owner")).alias("b"))
    return stories.select(key).distinct().join(best.hint("merge"), key, "left").select(key, F.when(F.col("b.n") == 1, F.col("b.owner")).alias("owner"), F.when(F.col("b.n") > 1, "several").when(F.col("b.step") == 0, "alias").when(F.col("b.step") == 1, "word and scope").otherwise("none").alias("how"))
