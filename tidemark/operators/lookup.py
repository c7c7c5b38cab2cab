"""Joins that resolve in steps: the first rule that fits decides, and every probe gets an outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.tables import small


def get_or_create(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, id, created): known ids, and for keys without one an id derived from the key itself, equal in every run."""
    wanted = rows.select(key).where(F.col(key).isNotNull()).distinct()
    x = wanted.join(known.select(key, "id"), key, "left")
    return x.select(key, F.coalesce("id", F.concat(F.lit("new-"), F.substring(F.md5(F.col(key).cast("string")), 1, 12))).alias("id"), F.col("id").isNull().alias("created"))


def two_token_match(rows: DataFrame, key: str, words: str, pairs: DataFrame) -> DataFrame:
    """(key, id): rows that hold both tokens of a pair (id, a, b); of several the smallest id.

    Rows meet pairs by the token of each that is rarer among the rows.
    """
    each = rows.select(key, F.explode(F.array_distinct(words)).alias("w"))
    often = each.groupBy("w").agg(F.count("*").alias("n"))
    rated = pairs
    for c in "ab":
        rated = rated.join(often.select(F.col("w").alias(c), F.col("n").alias(f"n{c}")), c)
    chosen = rated.select("id", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("w"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("other"))
    met = each.join(chosen, "w").select(key, "id", F.col("other").alias("w"))
    return met.join(each, [key, "w"], "left_semi").groupBy(key).agg(F.min("id").alias("id"))


def overlap_matches(a: DataFrame, b: DataFrame, key: str, tokens: str, least: int, deny: tuple[str, ...] = ()) -> DataFrame:
    """(key, other, shared): pairs of rows of two tables with at least ``least`` tokens in common, outside ``deny``."""
    words = lambda df: df.select(key, F.explode(F.array_distinct(tokens)).alias("w")).where(~F.col("w").isin(*deny) if deny else F.lit(True))
    return words(a).join(words(b).withColumnRenamed(key, "other"), "w").groupBy(key, "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def cascade(probes: DataFrame, key: str, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, id, how) for every probe: the id of the first step (name, DataFrame of key, id) that has exactly one for it.

    A step with several ids for a key refuses it and the next step is asked; how is the step's
    name, 'refused' where some step had several and none had one, else 'none'.
    """
    found = [s.groupBy(key).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).select(key, F.lit(i).alias("step"), F.lit(name).alias("how"), "id", "n") for i, (name, s) in enumerate(steps)]
    both = reduce(DataFrame.unionByName, found)
    best = both.groupBy(key).agg(F.min(F.when(F.col("n") == 1, F.struct("step", "how", "id"))).alias("b"), F.bool_or(F.col("n") > 1).alias("several"))
    return probes.select(key).distinct().join(best, key, "left").select(key, F.col("b.id").alias("id"), F.coalesce("b.how", F.when(F.col("several"), "refused"), F.lit("none")).alias("how"))


def two_way(proofs: DataFrame, records: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): proofs without record, records without proof, and values that differ; agreed ones are left out."""
    a, b = proofs.select(key, F.col(value).alias("_p"), F.lit(True).alias("_a")), records.select(key, F.col(value).alias("_r"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "proof without record").when(F.col("_a").isNull(), "record without proof").when(~F.col("_p").eqNullSafe(F.col("_r")), "differs")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status is not null")


def windows(texts: DataFrame, key: str, text: str, size: int = 60, step: int = 20) -> DataFrame:
    """(key, window): windows of ``size`` characters, one every ``step``; a shorter text is none."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1, F.lit(step))
    return texts.where(F.length(text) >= size).select(key, F.explode(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(size)))).alias("window"))


def inner_word(window: Column) -> Column:
    """The longest word of a window that blanks on both sides show to be whole; null without one."""
    words = F.slice(F.split(window, r"\s"), 2, F.greatest(F.size(F.split(window, r"\s")) - 2, F.lit(0)))
    return F.nullif(F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit(""))


def texts_with_windows(texts: DataFrame, key: str, text: str, wanted: DataFrame, size: int) -> DataFrame:
    """(key, window): the windows of ``wanted`` (window) that stand anywhere in a text.

    Texts meet windows by the longest whole word inside the window and are then searched for
    it. Windows without such a word, if there are any, meet texts at every place.
    """
    keyed = wanted.select("window", inner_word(F.col("window")).alias("w")).distinct()
    words = texts.select(key, F.explode(F.array_distinct(F.split(text, r"\s"))).alias("w"))
    met = words.join(small(keyed.where("w is not null"), 100_000), "w").select(key, "window").distinct()
    found = texts.select(key, text).join(met, key).where(F.contains(F.col(text), F.col("window"))).select(key, "window").distinct()
    rest = keyed.where("w is null").select("window")
    if rest.isEmpty():
        return found
    return found.union(windows(texts, key, text, size, 1).join(small(rest, 100_000), "window", "left_semi").select(key, "window").distinct())


def first_contained(texts: DataFrame, key: str, words: str, rules: DataFrame) -> DataFrame:
    """(key, label): of the rules (term, label, place) whose one-word term a row holds, the label of the first."""
    each = texts.select(key, F.explode(F.array_distinct(words)).alias("term"))
    return each.join(small(rules), "term").groupBy(key).agg(F.min(F.struct("place", "label"))["label"].alias("label"))


def expanded(roles: DataFrame, base: DataFrame, extras: DataFrame, key: str, item: str) -> DataFrame:
    """(key, items): every role's items, the base set first, then its own extras in order; repeated ones once."""
    common = roles.select(key).crossJoin(small(base.select(item, F.lit(0).alias("part"), "place"), 10_000))  # each role gets the base set: the result's own rows
    own = extras.select(key, item, F.lit(1).alias("part"), "place")
    first = common.union(own.select(key, item, "part", "place")).groupBy(key, item).agg(F.min(F.struct("part", "place")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col(item).alias("i")))), lambda x: x["i"]).alias("items"))


def crosswalked(a: DataFrame, crosswalk: DataFrame, key: str, column: str) -> DataFrame:
    """(key, theirs): values in the other vocabulary by a written table (ours, theirs); an absent pair is no match, never the nearest."""
    return a.join(crosswalk.withColumnRenamed("ours", column), column, "left").select(key, "theirs")


def ranked_sources(sources: list[DataFrame], key: str, host: str, deny: DataFrame, k: int) -> DataFrame:
    """(key, host, source, place): candidates by source in order, each host once, none of ``deny``, the first k."""
    both = reduce(DataFrame.unionByName, [s.select(key, host, F.lit(i).alias("source"), "score") for i, s in enumerate(sources)])
    once = both.join(deny.select(host).distinct(), host, "left_anti").groupBy(key, host).agg(F.min(F.struct("source", (-F.col("score")).alias("down"))).alias("b"))
    w = Window.partitionBy(key).orderBy("b", host)
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(key, host, F.col("b.source").alias("source"), "place")


def with_fallbacks(keys: DataFrame, levels: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """(key, value, level): the value of the first level that has the key, with the level's name; 'nothing' else."""
    out = keys.select(key)
    for i, (_, df) in enumerate(levels):
        out = out.join(df.select(key, F.col(value).alias(f"_v{i}"), F.lit(True).alias(f"_t{i}")), key, "left")
    level, found = F.lit("nothing"), F.lit(None)
    for i, (name, _) in reversed(list(enumerate(levels))):
        level, found = F.when(F.col(f"_t{i}"), name).otherwise(level), F.when(F.col(f"_t{i}"), F.col(f"_v{i}")).otherwise(found)
    return out.select(key, found.alias(value), level.alias("level"))


def stated_counts(stated: DataFrame, rows: DataFrame, key: str, n: str) -> DataFrame:
    """(key, stated, actual) where a stated count is not that of the rows."""
    actual = rows.groupBy(key).agg(F.count("*").alias("actual"))
    return stated.join(actual, key, "left").select(key, F.col(n).alias("stated"), F.coalesce("actual", F.lit(0)).alias("actual")).where("stated <> actual")
