"""Matching by tokens, names listed together, and agreement between sources of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def match_all_tokens(probes: DataFrame, targets: DataFrame) -> DataFrame:
    """(probe, target): targets that hold every token of the probe.

    probes: (probe, tokens); targets: (target, tokens); both one row a name. Each probe meets
    the targets by its rarest token only, so a word that most names hold is no join key unless
    a probe has no other. Probes without tokens match nothing.
    """
    have = targets.select("target", "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    often = have.groupBy("token").agg(F.count("*").alias("n"))
    want = probes.select("probe", F.col("tokens").alias("want"), F.explode(F.array_distinct("tokens")).alias("token"))
    rarest = want.join(often, "token", "left").groupBy("probe").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "want")).alias("r"))
    rarest = rarest.select("probe", "r.token", "r.want")
    return rarest.join(have, "token").where(F.size(F.array_except("want", "tokens")) == 0).select("probe", "target").distinct()


def split_listed(rows: DataFrame, key: str, listed: str, names: DataFrame, between: str = " and ") -> DataFrame:
    """(key, name, parts): the parts of a listed text if each is a known name, else the text itself.

    names: (name), distinct.
    """
    parts = rows.select(key, listed, F.posexplode(F.split(listed, f"\\Q{between}\\E")).alias("at", "part"))
    known = parts.join(names.withColumnRenamed("name", "part").withColumn("known", F.lit(True)), "part", "left")
    whole = known.groupBy(key, listed).agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all"), F.sort_array(F.collect_list(F.struct("at", "part"))).alias("ps"))
    out = whole.select(key, F.explode(F.when(F.col("all"), F.col("ps.part")).otherwise(F.array(listed))).alias("name"), F.when(F.col("all"), F.size("ps")).otherwise(1).alias("parts"))
    return out


def agreement(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, sources, verdict): a value that every source states; different values drop all of them."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, [p.select(key, value, F.lit(i).alias("source")) for i, p in enumerate(parts)])
    x = both.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_distinct("source").alias("sources"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    verdict = F.when(~same, "conflict").when(F.col("sources") == len(parts), "agreed").otherwise("one-sided")
    return x.select(key, F.when(same, F.col("lo")).alias(value), "sources", verdict.alias("verdict"))


def multiset_diff(base: DataFrame, head: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that occur in one table more often than in the other, with both counts. Nulls are equal."""
    tagged = base.select(*columns, F.lit(1).alias("b"), F.lit(0).alias("h")).union(head.select(*columns, F.lit(0), F.lit(1)))
    return tagged.groupBy(*columns).agg(F.sum("b").alias("in_base"), F.sum("h").alias("in_head")).where("in_base <> in_head")


def changed_fields(new: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): comma-joined names of the fields that differ from the previous capture; new keys say so."""
    before = old.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    x = new.join(before, F.col(key) == F.col("_k"), "left")
    return x.select(key, F.when(F.col("_k").isNull(), "new").otherwise(F.array_join(names, ",")).alias("changed"))


def confidence(number: Column, status: Column, note: Column) -> tuple[Column, Column]:
    """(confidence, reason) of a record: the first rule that fits."""
    level = F.when(number.isNull(), "none").when(note.isNotNull(), "probable").when(status.isNull(), "probable").otherwise("confirmed")
    reason = F.when(number.isNull(), "no number").when(note.isNotNull(), note).when(status.isNull(), "no status").otherwise("number and status known")
    return level, reason
