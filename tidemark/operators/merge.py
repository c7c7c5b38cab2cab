"""Merges and diffs of record tables. Every comparison is null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.tables import cut


def _sided(df: DataFrame, key: str, side: str) -> DataFrame:
    return df.select(F.col(key), F.lit(True).alias(f"{side}__there"), *[F.col(c).alias(f"{side}__{c}") for c in df.columns if c != key])


def overlay(over: DataFrame, under: DataFrame, key: str) -> DataFrame:
    """Full outer merge of all columns of either: a non-empty value of ``over`` wins, as it stands; origin tells which sides had the key."""
    there, kinds = (set(over.columns), set(under.columns)), dict(under.dtypes) | dict(over.dtypes)
    fields = [c for c in dict.fromkeys([*under.columns, *over.columns]) if c != key]
    both = _sided(over, key, "a").join(_sided(under, key, "b"), key, "full")

    def pick(c: str) -> Column:
        own = F.when(F.trim(f"a__{c}") != "", F.col(f"a__{c}")) if c in there[0] and kinds[c] == "string" else F.col(f"a__{c}")
        return F.coalesce(*[x for x, has in ((own, c in there[0]), (F.col(f"b__{c}"), c in there[1])) if has])

    origin = F.when(F.col("a__there") & F.col("b__there"), "both").when(F.col("a__there"), "over").otherwise("under")
    return both.select(key, *[pick(c).alias(c) for c in fields], origin.alias("origin"))


def union_first_wins(sources: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """The rows of all sources by name, of each key those of the first source that has it, the first in ``order``; from_source tells which."""
    tagged = [s.withColumn("from_source", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(key).orderBy("from_source", *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def children_union(parents: list[DataFrame], key: str, child: str, order: str) -> DataFrame:
    """(key, children): each key's children of all tables (key, child, order), once each by their key, in the order of table and ``order``."""
    both = reduce(DataFrame.unionByName, [p.select(key, child, F.lit(i).alias("_t"), F.col(order).alias("_o")) for i, p in enumerate(parents)])
    once = both.where(F.col(child).isNotNull()).groupBy(key, child).agg(F.min(F.struct("_t", "_o")).alias("_at"))
    return once.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.col(child).alias("c")))), lambda x: x["c"]).alias("children"))


def feed_over_defaults(feed: DataFrame, defaults: DataFrame, key: str, field: str, held: Column) -> DataFrame:
    """(key, field, status): the feed's value over the default, rows of either alone, without feed rows that are ``held`` back."""
    live = feed.where(~held).select(key, F.col(field).alias("_f"), F.lit(True).alias("_live"))
    x = defaults.select(key, F.col(field).alias("_d"), F.lit(True).alias("_known")).join(live, key, "full")
    status = F.when(F.col("_known").isNull(), "feed only").when(F.col("_live").isNull(), "default").when(F.col("_f").isNull(), "default kept").otherwise("overlaid")
    return x.select(key, F.coalesce("_f", "_d").alias(field), status.alias("status"))


def added_range(records: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """``records`` and the rows of ``extra`` whose key they lack, with from_range; what a record states is never overridden."""
    return records.withColumn("from_range", F.lit(False)).unionByName(extra.join(records.select(*key).distinct(), key, "left_anti").withColumn("from_range", F.lit(True)))


def record_diff(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """(key, change, field, old, new): added and removed records, and each changed field as text."""
    fields = [c for c in base.columns if c != key]
    both = _sided(base, key, "a").join(_sided(head, key, "b"), key, "full")
    changes = F.array(*[
        F.struct(F.lit("changed").alias("change"), F.lit(c).alias("field"), F.col(f"a__{c}").cast("string").alias("old"), F.col(f"b__{c}").cast("string").alias("new"), (~F.col(f"a__{c}").eqNullSafe(F.col(f"b__{c}"))).alias("differs"))
        for c in fields
    ])
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("change"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(True).alias("differs")))
    rows = F.when(F.col("a__there").isNull(), whole("added")).when(F.col("b__there").isNull(), whole("removed")).otherwise(F.filter(changes, lambda x: x.differs))
    return both.select(key, F.explode(rows).alias("x")).select(key, "x.change", "x.field", "x.old", "x.new")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, field: str) -> DataFrame:
    """(key, value, status): the side that changed wins; both changed differently is a conflict without value."""
    x = _sided(base, key, "o").join(_sided(ours, key, "a"), key, "full").join(_sided(theirs, key, "b"), key, "full")
    o, a, b = (F.struct(F.col(f"{s}__there"), F.col(f"{s}__{field}")) for s in "oab")
    status = F.when(a.eqNullSafe(b), "agreed").when(a.eqNullSafe(o), "theirs").when(b.eqNullSafe(o), "ours").otherwise("conflict")
    value = F.when(status == "theirs", F.col(f"b__{field}")).when(status != "conflict", F.col(f"a__{field}"))
    gone = F.when(status == "theirs", F.col("b__there").isNull()).when(status != "conflict", F.col("a__there").isNull()).otherwise(False)
    return x.select(key, value.alias("value"), status.alias("status"), gone.alias("deleted"))


def three_way_records(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields, side): whole records of both sides, each from the side that edited it; refused as a whole where both edited one differently.

    A record counts as edited if it is not, in every field, what base has. One that neither edited is the
    same, one that only one side has stays, also if the other removed it; one that both removed is gone. Keys are distinct within each
    table. A conflict raises ValueError, which names the first few; nothing is merged then.
    """
    side = lambda df, name: df.select(F.col(key), F.struct(*fields).alias(name))
    x = side(base, "_b").join(side(ours, "_o"), key, "full").join(side(theirs, "_t"), key, "full")
    edited = lambda name: F.col(name).isNotNull() & ~F.col(name).eqNullSafe(F.col("_b"))
    x = cut(x.withColumns({"_oe": edited("_o"), "_te": edited("_t")}), "sides")
    conflicts = x.where(F.col("_oe") & F.col("_te") & ~F.col("_o").eqNullSafe(F.col("_t"))).select(F.col(key).cast("string").alias("k"))
    first = [r.k for r in conflicts.orderBy("k").limit(8).collect()]
    if first:
        raise ValueError(f"refused: {conflicts.count()} records are edited differently on both sides: {', '.join(first)}")
    there = x.where(F.col("_o").isNotNull() | F.col("_t").isNotNull())
    record = F.when(F.col("_te"), F.col("_t")).otherwise(F.coalesce("_o", "_t"))
    side_of = F.when(F.col("_te") & F.col("_oe"), "both").when(F.col("_te"), "theirs").when(F.col("_oe"), "ours").otherwise("same")
    return there.select(key, record.alias("_r"), side_of.alias("side")).select(key, *[F.col("_r").getField(c).alias(c) for c in fields], "side")


def carry_forward(new: DataFrame, previous: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``new`` with null fields filled from ``previous``; carried tells whether any was."""
    old = previous.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields])
    carried = F.lit(False)
    for f in fields:
        carried = carried | (F.col(f).isNull() & F.col(f"_{f}").isNotNull())
    x = new.join(old, key, "left").withColumn("carried", carried)
    return x.select(key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields], "carried")


def replace_by_provenance(table: DataFrame, fresh: DataFrame, column: str, source: str) -> DataFrame:
    """``table`` with all rows of one source replaced by ``fresh``."""
    return table.where(~F.col(column).eqNullSafe(F.lit(source))).unionByName(fresh)


def renamed(base: DataFrame, head: DataFrame, key: str, forms: list[Column]) -> DataFrame:
    """(old, new, form): removed records paired with added ones that share a form, one to one.

    The forms are tried in order; a form that several removed or several added records have
    pairs them by rank of key, so that no record has two partners. What is paired by an earlier
    form is not asked again.
    """
    gone, come = base.join(head.select(key), key, "left_anti"), head.join(base.select(key), key, "left_anti")
    pairs = None
    for i, form in enumerate(forms):
        ranked = lambda df: df.withColumn("_form", form).where("_form <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("_form").orderBy(key)))
        old, new = gone, come
        if pairs is not None:
            old, new = old.join(pairs.select(F.col("old").alias(key)), key, "left_anti"), new.join(pairs.select(F.col("new").alias(key)), key, "left_anti")
        found = ranked(old).select(F.col(key).alias("old"), "_form", "_n").join(ranked(new).select(F.col(key).alias("new"), "_form", "_n"), ["_form", "_n"]).select("old", "new", F.lit(i).alias("form"))
        pairs = found if pairs is None else pairs.union(found)
    return pairs


def children_diff(base: DataFrame, head: DataFrame, key: str, child: str) -> DataFrame:
    """(key, change, child): children gained and lost by keys that both tables have."""
    a, b = base.select(key, child).distinct(), head.select(key, child).distinct()
    both = a.select(key).distinct().join(b.select(key).distinct(), key)
    lost, gained = a.join(b, [key, child], "left_anti"), b.join(a, [key, child], "left_anti")
    return lost.join(both, key, "left_semi").select(key, F.lit("lost").alias("change"), child).union(gained.join(both, key, "left_semi").select(key, F.lit("gained"), child))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(value, side): values of one vocabulary only."""
    one = lambda x, y, side: x.join(y, "value", "left_anti").select("value", F.lit(side).alias("side")).distinct()
    return one(a, b, "first").union(one(b, a, "second"))


def merged_parts(parts: list[DataFrame], vocabulary: DataFrame, key: str, value: str, reason: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(merged, refusals): parts (key, value, reason) as one table, all or nothing.

    Refused are values outside the vocabulary (value), reasons under ``least`` characters, and
    keys to which parts give different values; merged has no rows if anything is refused.
    """
    rows = reduce(DataFrame.unionByName, [p.select(key, value, reason) for p in parts]).distinct()
    unknown = rows.join(vocabulary.select(F.col("value").alias(value)).distinct(), value, "left_anti").select(key, F.lit("unknown value").alias("refusal"))
    short = rows.where(F.length(F.coalesce(F.trim(reason), F.lit(""))) < least).select(key, F.lit("short reason"))
    torn = rows.groupBy(key).agg(F.count_distinct(value).alias("_n")).where("_n > 1").select(key, F.lit("contradiction"))
    refusals = unknown.union(short).union(torn).distinct()
    kept = rows.groupBy(key).agg(F.min(value).alias(value), F.min(reason).alias(reason))
    return kept.join(F.broadcast(refusals.agg(F.count("*").alias("_r"))), F.col("_r") == 0).drop("_r"), refusals


def rebuilt_worklist(fresh: DataFrame, previous: DataFrame, key: str, decision: str) -> DataFrame:
    """(key, decision, state): fresh keys with what was decided before; decided keys that are no longer listed stay, marked."""
    x = fresh.select(key, F.lit(True).alias("_f")).distinct().join(previous.select(key, decision), key, "full")
    state = F.when(F.col("_f").isNull(), F.when(F.col(decision).isNotNull(), "decided, gone")).when(F.col(decision).isNotNull(), "decided").otherwise("open")
    return x.select(key, decision, state.alias("state")).where("state is not null")


def newest_block(ours: DataFrame, theirs: DataFrame, key: str, checked: str, fields: list[str]) -> DataFrame:
    """Each key's whole row of the side checked last; ties and rows without a date are ours."""
    x = _sided(ours.select(key, checked, *fields), key, "a").join(_sided(theirs.select(key, checked, *fields), key, "b"), key, "full")
    newer = F.coalesce(F.col(f"b__{checked}") > F.col(f"a__{checked}"), F.col("a__there").isNull() | (F.col(f"a__{checked}").isNull() & F.col(f"b__{checked}").isNotNull()))
    return x.select(key, *[F.when(newer, F.col(f"b__{c}")).otherwise(F.col(f"a__{c}")).alias(c) for c in (checked, *fields)], F.when(newer, "theirs").otherwise("ours").alias("side"))


def retested(carried: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, outcome): carried records against today's index (key, n candidates): dropped where the key is now several names, folded where it is one, else kept."""
    x = carried.select(key).distinct().join(index.select(key, "n"), key, "left")
    return x.select(key, F.when(F.col("n") > 1, "dropped").when(F.col("n") == 1, "folded").otherwise("kept").alias("outcome"))


def sticky_changes(changes: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, changed): today's changed fields, else those flagged before: a flag stays until another change replaces it."""
    old = previous.select(key, F.col("changed").alias("_old"))
    return changes.join(old, key, "left").select(key, F.when(F.coalesce("changed", F.lit("")) != "", F.col("changed")).otherwise(F.coalesce("_old", F.lit(""))).alias("changed"))


def no_loss(before: DataFrame, after: DataFrame, key: str, form: str, other_forms: list[Column] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Records of ``before`` that are gone by key: renamed if another record now has their form or one of ``other_forms`` (columns of
    both tables), allowed if listed, else lost."""
    gone = before.join(after.select(key).distinct(), key, "left_anti")
    found = F.lit(False)
    for i, x in enumerate([F.col(form), *(other_forms or [])]):
        now = after.select(x.alias(f"_f{i}")).where(f"_f{i} <> ''").distinct().withColumn(f"_t{i}", F.lit(True))
        gone = gone.withColumn(f"_f{i}", x).join(now, f"_f{i}", "left")
        found = found | F.coalesce(F.col(f"_t{i}"), F.lit(False))
    outcome = F.when(found, "renamed").otherwise("lost")
    if allowed is not None:
        gone = gone.join(allowed.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
        outcome = F.when(found, "renamed").when(F.col("_ok"), "allowed").otherwise("lost")
    return gone.select(key, form, outcome.alias("outcome"))
