"""Filters that say what they leave out, facets whose options follow the rows, and orders for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def unmatched_entries(entries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Entries of a suppression list that no row carries."""
    return entries.join(rows.select(key).distinct(), key, "left_anti")


def curated(auto: Column, use: Column) -> Column:
    """Not made by machine, or with a stated use."""
    return ~F.coalesce(auto, F.lit(False)) | (F.trim(F.coalesce(use, F.lit(""))) != "")


def named_person(name: Column) -> Column:
    """What keeps a contact from being a person: a department's name, a single word, or nothing; null for a person."""
    return (
        F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "empty").when(name.rlike(r"(?i)\b(team|department|office|enquiries|sales|support|desk)\b"), "department")
        .when(~F.trim(name).contains(" "), "single word")
    )


def email_shape(email: Column) -> Column:
    return email.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$")


#: What a parked page says, where (title or body).
PARKED = [("title", r"(?i)domain (is )?for sale|parked"), ("body", r"(?i)buy this domain|this domain is parked|related searches")]


def parked(title: Column, body: Column, rules: list[tuple[str, str]] = PARKED) -> Column:
    """The scope of the first rule that fits a page, null for a page in use."""
    out = F.lit(None).cast("string")
    for scope, pattern in reversed(rules):
        out = F.when((title if scope == "title" else body).rlike(pattern), scope).otherwise(out)
    return F.coalesce(out, F.lit(None).cast("string"))


def without_prefixes(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Rows whose path is no folder of another row's path of the same key: landing pages go."""
    at = F.array_remove(F.split(path, "/"), "")
    folders = rows.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(at) - 1, F.lit(0))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(at, 1, n), "/")))).alias("_folder"), F.size(at).alias("_n"))
    above = folders.where("_n > 0").select(F.col(key).alias("_key"), "_folder").distinct()
    own = F.concat(F.lit("/"), F.array_join(at, "/"))
    return rows.join(above, (F.col(key) == F.col("_key")) & (own == F.col("_folder")), "left_anti")


def refused_groups(rows: DataFrame, key: str, good: Column, floor: int) -> DataFrame:
    """(key, n, good, reason): groups of fewer than ``floor`` rows, or most of whose rows are not good."""
    x = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(good).alias("good"))
    reason = F.when(F.col("n") < floor, "too few").when(2 * F.col("good") < F.col("n"), "mostly uncategorised")
    return x.withColumn("reason", reason).where("reason is not null")


def facets(rows: DataFrame, chosen: dict[str, str], columns: list[str]) -> DataFrame:
    """(facet, value, n): options of each facet among the rows that the choices in the facets before it leave.

    One pass: a row counts for facet i if it meets the choices of all facets before i.
    """
    meets, options = F.lit(True), []
    for c in columns:
        options.append(F.when(meets, F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))))
        if c in chosen:
            meets = meets & F.coalesce(F.col(c).cast("string") == chosen[c], F.lit(False))
    x = rows.select(F.explode(F.array_compact(F.array(*options))).alias("o"))
    return x.groupBy("o.facet", "o.value").agg(F.count("*").alias("n"))


def live_first(rows: DataFrame, key: str, status: str, order: list[Column]) -> DataFrame:
    """Each key's first row without a status, else its first row."""
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col(status), F.lit("")) != "", *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_scope_first(candidates: DataFrame, key: str, in_scope: Column, order: list[Column]) -> DataFrame:
    """Each key's best candidate with out_of_scope: the scope narrows what is suggested, not what is found."""
    x = candidates.withColumn("out_of_scope", ~in_scope)
    w = Window.partitionBy(key).orderBy("out_of_scope", *order)
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def relevance_bucket(specialities: Column, mine: list[str], wide: list[str]) -> Column:
    """1 mine, 2 of the wider field, 3 the rest: an order, not a filter."""
    overlaps = lambda xs: F.arrays_overlap(specialities, F.array(*map(F.lit, xs)))
    return F.when(F.coalesce(overlaps(mine), F.lit(False)), 1).when(F.coalesce(overlaps(wide), F.lit(False)), 2).otherwise(3)


def ordered_places(rows: DataFrame, key: str, order: list[Column], k: int | None = None) -> DataFrame:
    """Rows with their place within the key; the first k if given."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out if k is None else out.where(F.col("place") <= k)


def sampled(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """A sample (the feature) of n rows that is the same in every run and engine: the least hashes of seed and key."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")
