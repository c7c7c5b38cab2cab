"""Joins with a row of facts for each key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more than one in so many of all rows is heavy: there are fewer of them than this, and their facts are broadcast.
HEAVY = 10_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, by: str) -> DataFrame:
    """``rows`` joined (inner) to ``facts``, a row for each ``key`` with ``count``, the number of rows it has among ``total``.

    Heavy keys get their facts by broadcast and go on spread by the column ``by``; the others are
    shuffled by key, of which none has more than one in HEAVY of all rows. Null keys join nothing.
    """
    values = [c for c in facts.columns if c not in (key, count)]
    of = lambda part, name: part.select(key, F.struct(*values).alias(name))
    heavy = F.broadcast(of(facts.where(F.col(count) * HEAVY > total), "_heavy"))
    # never 1, but not a constant: that would be taken out of the join's keys, and the heavy rows be dealt by key again
    none = F.when(F.col(count) < 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("_salt")
    light = facts.where(F.col(count) * HEAVY <= total).select(key, none, F.struct(*values).alias("_light"))
    salt = F.when(F.col("_heavy").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(by))
    joined = rows.join(heavy, key, "left").withColumn("_salt", salt).join(light, [key, "_salt"], "left")
    told = F.coalesce("_heavy", "_light")
    return joined.where(told.isNotNull()).select(*rows.columns, *[told.getField(v).alias(v) for v in values])
