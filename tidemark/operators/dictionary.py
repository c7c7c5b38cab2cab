"""Dictionaries of terms found anywhere in texts, also inside words: each text is scanned once, whatever the number of terms."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.tables import cut

#: Characters of terms in an automaton, which is broadcast; longer vocabularies take a pass for each part.
CHARS = 10_000_000


class _Automata:
    """An automaton for each broadcast vocabulary, once in a Python worker."""

    made: dict[str, object] = {}

    @classmethod
    def of(cls, name: str, terms: list[str]) -> object:
        if name not in cls.made:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, term in enumerate(terms):
                automaton.add_word(term, i)
            automaton.make_automaton()
            cls.made = {name: automaton}
        return cls.made[name]


def _scanned(rows: DataFrame, text: str, vocabulary: DataFrame, fields: list[StructField], told: Callable[[set[int], list[str]], tuple], order: list[str]) -> list[DataFrame]:
    """The rows with ``told`` of the terms in each text, by their numbers in ``order``: a table for each part of the vocabulary (t, distinct, with the columns of the order)."""
    spark, size = rows.sparkSession, vocabulary.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = 1 + size // CHARS
    schema = StructType([*rows.schema.fields, *fields])
    arrow, place = to_arrow_schema(schema), rows.columns.index(text)

    def one(part: int) -> DataFrame:
        own = vocabulary.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part) if parts > 1 else vocabulary
        own = own.orderBy(*order) if order else own
        shared, made = spark.sparkContext.broadcast([r.t for r in own.select("t").collect()]), uuid.uuid4().hex  # CHARS characters, as counted

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, names = (_Automata.of(made, shared.value), shared.value) if shared.value else (None, [])
            for batch in batches:
                found = [told({v for _, v in automaton.iter(x.as_py())} if automaton is not None and x.is_valid else set(), names) for x in batch.column(place)]
                columns = [*batch.columns, *(pa.array([f[i] for f in found], arrow.field(f_.name).type) for i, f_ in enumerate(fields))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return rows.mapInArrow(scan, schema)

    return [one(p) for p in range(parts)]


def _vocabulary(terms: DataFrame, term: str, *more: str) -> DataFrame:
    return terms.select(F.col(term).alias("t"), *more).where(F.length("t") > 0).distinct()


def with_terms(rows: DataFrame, text: str, terms: DataFrame, term: str = "term", found: str = "found") -> DataFrame:
    """The rows with ``found``, the distinct terms that stand anywhere in ``text`` as plain substrings, in no order.

    An Aho-Corasick automaton of all terms reads each text once, in the task that holds it; nothing is
    shuffled. The terms' size is checked: beyond CHARS they are dealt by their hash to several automata, and rows come once for each. Null texts
    hold nothing; null and empty terms are in no text.
    """
    field = StructField(found, ArrayType(terms.schema[term].dataType))
    return reduce(DataFrame.union, _scanned(rows, text, _vocabulary(terms, term), [field], lambda met, names: ([names[v] for v in met],), []))


def contained(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, term): a row for each distinct term that a text holds, by ``with_terms``. Rows that repeat a key are texts of their own."""
    return with_terms(texts.select(key, F.col(text).alias("_text")), "_text", terms, term, "_found").select(key, F.explode("_found").alias(term))


def first_rule(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, n_terms, term, label): how many terms of the rules (term, label, place) a text holds, and the first by place.

    A term given twice counts at its first place. Texts without any term are no rows.
    """
    first = cut(rules.groupBy("term").agg(F.min(F.struct("place", "label")).alias("r")), "rules")
    # terms are numbered by place: a text's count and its first are told in its task, whatever it holds
    fields = [StructField("_n", LongType()), StructField("_term", first.schema["term"].dataType)]
    told = lambda met, names: (len(met), names[min(met)] if met else None)
    texts = texts.select(key, F.col(text).alias("_text"))
    vocabulary = _vocabulary(first.withColumn("place", F.col("r.place")), "term", "place")
    met = reduce(DataFrame.union, [x.select(key, "_n", "_term").where("_n > 0") for x in _scanned(texts, "_text", vocabulary, fields, told, ["place", "t"])])
    met = met.join(first, F.col("_term") == F.col("term"))
    return met.groupBy(key).agg(F.sum("_n").alias("n_terms"), F.min(F.struct("r.place", "term", "r.label")).alias("f")).select(key, "n_terms", "f.term", "f.label")


def same_names(ours: DataFrame, theirs: DataFrame, left: str, right: str, name: str, least: int = 2) -> DataFrame:
    """(left, right, how): pairs of names that may be one company, by the first step that holds.

    equal: the keys are; contains: either key stands within the other; joined: the same without
    blanks; words: ``least`` shared words or more. Empty and null names match nothing. Equal names are one
    name to look for; pairs meet by a step's own key (name, automaton, rarest shared words), never all with all.
    """
    named = lambda df, key: df.select(key, F.col(name).alias("n"), F.replace(F.col(name), F.lit(" "), F.lit("")).alias("j")).where(F.length("j") > 0)
    a, b = cut(named(ours, left), "names"), cut(named(theirs, right), "names")
    an, bn = a.select("n", "j").distinct(), b.select("n", "j").distinct()
    pairs = [an.select(F.col("n").alias("an")).join(bn.select(F.col("n").alias("bn")), F.col("an") == F.col("bn")).select("an", "bn", F.lit(0).alias("step"))]
    for step, c in ((1, "n"), (2, "j")):
        # the text's names hold the other side's terms; joined forms lead back to their names
        one = contained(an, "n", c, bn.select(F.col(c).alias("term"))).select(F.col("n").alias("an"), "term").join(bn.select(F.col("n").alias("bn"), F.col(c).alias("term")), "term")
        two = contained(bn, "n", c, an.select(F.col(c).alias("term"))).select(F.col("n").alias("bn"), "term").join(an.select(F.col("n").alias("an"), F.col(c).alias("term")), "term")
        pairs += [x.select("an", "bn", F.lit(step).alias("step")) for x in (one, two)]
    words = lambda df, n: df.select(F.col("n").alias(n), F.explode(F.array_distinct(F.split("n", " "))).alias("w")).where("w <> ''")
    wa, wb = words(an, "an"), words(bn, "bn")
    often = wa.select("w").union(wb.select("w")).groupBy("w").agg(F.count("*").alias("df"))
    ordered = lambda df, n: df.join(often, "w").groupBy(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x.w).alias(f"{n}s"))
    # of ``least`` shared words the rarest is not among either name's last ``least`` - 1
    prefix = lambda df, n: ordered(df, n).select(n, f"{n}s", F.explode(F.slice(f"{n}s", F.lit(1), F.greatest(F.size(f"{n}s") - (least - 1), F.lit(0)))).alias("w"))
    shared = F.array_intersect("ans", "bns")
    pairs.append(prefix(wa, "an").join(prefix(wb, "bn"), "w").where((F.get(shared, F.lit(0)) == F.col("w")) & (F.size(shared) >= least)).select("an", "bn", F.lit(3).alias("step")))
    best = reduce(DataFrame.union, pairs).groupBy("an", "bn").agg(F.min("step").alias("step"))
    how = F.element_at(F.array(*map(F.lit, ("equal", "contains", "joined", "words"))), F.col("step") + 1)
    return a.select(left, F.col("n").alias("an")).join(best, "an").join(b.select(right, F.col("n").alias("bn")), "bn").select(left, right, how.alias("how"))


def labelled_by_name(names: DataFrame, key: str, name: str, index: DataFrame) -> DataFrame:
    """(key, label): of the index (term, label, place), the label of the first term that contains the name or stands in it; others are no rows."""
    distinct = cut(names.select(F.col(name).alias("n")).where(F.length("n") > 0).distinct(), "names")
    first = cut(index.where(F.length("term") > 0).groupBy("term").agg(F.min(F.struct("place", "label")).alias("r")), "index")
    within = contained(distinct.withColumn("t", F.col("n")), "n", "t", first).select("n", "term")
    around = contained(first.withColumn("t", F.col("term")), "term", "t", distinct.select(F.col("n").alias("part")), "part").select(F.col("part").alias("n"), "term")
    best = within.union(around).join(first, "term").groupBy("n").agg(F.min("r")["label"].alias("label"))
    return names.select(key, F.col(name).alias("n")).join(best, "n").select(key, "label")


def mentions(things: DataFrame, texts: DataFrame, owner: str, thing: str, name: str, key: str, text: str) -> DataFrame:
    """(thing, key): an owner's texts that hold the first word of a thing's name, up to a blank or bracket, in any case."""
    x = things.select(owner, thing, F.lower(F.regexp_extract(name, r"^[^\s(]*", 0)).alias("term")).where("term <> ''")
    met = contained(texts.select(F.struct(owner, key).alias("k"), F.lower(text).alias("t")), "k", "t", x.select("term"))
    return x.join(met.select(F.col(f"k.{owner}").alias(owner), F.col(f"k.{key}").alias(key), "term"), [owner, "term"]).select(thing, key).distinct()
