"""Figures through time, sweeps that resume, and events of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def restated(figures: DataFrame, keys: list[str], filed: str, value: str, tolerance: float = 0.5) -> DataFrame:
    """(keys, value, filed, superseded): of each period the latest filing's value; earlier ones that differ from it by more
    than ``tolerance`` are kept, distinct and sorted. Values that are not positive are dropped."""
    good = figures.where(F.col(value) > 0)
    w = Window.partitionBy(*keys)
    last = F.max_by(value, F.struct(filed, value)).over(w)
    x = good.withColumns({"_v": last, "_f": F.max(filed).over(w)})
    return x.groupBy(*keys, F.col("_v").alias(value), F.col("_f").alias(filed)).agg(
        F.array_sort(F.collect_set(F.when(F.abs(F.col(value) - F.col("_v")) > tolerance, F.col(value)))).alias("superseded")
    )


def year_axis(facts: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """(key, year, value): every year between a key's first and last; a year without a figure is null, not zero."""
    sums = facts.groupBy(key, year).agg(F.sum(value).alias(value))
    ends = sums.groupBy(key).agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    return ends.select(key, F.explode(F.sequence("lo", "hi")).alias(year)).join(sums, [key, year], "left")


def resumed(work: DataFrame, done: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, action): what a sweep still has to do: decided keys are skipped, unproven ones probed again, new ones probed, refused ones left."""
    x = work.select(key).distinct().join(done.select(key, outcome), key, "left")
    action = F.when(F.col(outcome).isNull(), "probe").when(F.col(outcome) == "unproven", "probe again").when(F.col(outcome) == "refused", "leave").otherwise("skip")
    return x.select(key, action.alias("action"))


def role_events(roles: DataFrame, key: str, name: str, start: str, end: str, k: int) -> DataFrame:
    """(key, day, name, event, place): appointments and resignations of each key, the newest k; a successor is never inferred."""
    come = roles.select(key, F.col(start).alias("day"), name, F.lit("appointed").alias("event"))
    gone = roles.select(key, F.col(end).alias("day"), name, F.lit("resigned").alias("event"))
    both = come.union(gone).where("day is not null").distinct()
    w = Window.partitionBy(key).orderBy(F.desc("day"), name, "event")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def refusals(attempts: DataFrame, key: str, candidate: str, code: str, order: list[str], near: Column) -> DataFrame:
    """(key, reason, tried, near_misses): the gravest code of a key's attempts by ``order`` (unknown codes last), what was tried, and how many nearly passed."""
    rank = reduce(lambda a, c: F.when(F.col(code) == c[1], c[0]).otherwise(a), reversed(list(enumerate(order))), F.lit(len(order)))
    x = attempts.groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(code).alias("c")))["c"].alias("reason"), F.array_join(F.array_sort(F.collect_set(candidate)), ",").alias("tried"), F.count_if(near).alias("near_misses"))
    return x


def rule_book(pairs: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """(keys, prompts): the prompts whose condition holds for a compared pair, in the book's order; an unknown condition does not hold."""
    held = F.filter(F.array(*[F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(prompt).alias("prompt")) for prompt, ok in rules]), lambda r: r.ok)
    return pairs.select(*keys, F.transform(held, lambda r: r.prompt).alias("prompts"))
